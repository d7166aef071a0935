"""Metric and label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CHARS, strip

# What a sanitised name looks like (no leading digit, no double underscore).
METRIC_NAME = r"^(?!.*__)[A-Za-z_:\-][A-Za-z0-9_:\-]*$"
LABEL_NAME = r"^(?!.*__)[A-Za-z_\-][A-Za-z0-9_\-]*$"


def _sanitize(c: Column, pattern: str) -> Column:
    dotted = F.translate(strip(c), ".", "_")
    # The pattern's $ would also accept a line break at the end.
    return F.when(dotted.rlike(pattern) & ~dotted.contains("\n") & ~dotted.contains("\r"), dotted)


def sanitize_metric(c: Column) -> Column:
    """Trimmed name with dots as underscores; NULL if it is still not a metric name."""
    return _sanitize(c, METRIC_NAME)


def sanitize_label(c: Column) -> Column:
    """As :func:`sanitize_metric`, but a colon is not allowed either."""
    return _sanitize(c, LABEL_NAME)


def _sanitize_static(name: str, extra: str) -> str | None:
    out = name.strip(SPACE_CHARS).replace(".", "_")
    legal = out.isascii() and all(ch.isalnum() or ch in "_-" + extra for ch in out)
    return out if out and legal and not out[0].isdigit() and "__" not in out else None


def metric_name(name: str) -> str | None:
    """:func:`sanitize_metric` for a name known when the job is built."""
    return _sanitize_static(name, ":")


def label_name(name: str) -> str | None:
    """:func:`sanitize_label` for a name known when the job is built."""
    return _sanitize_static(name, "")
