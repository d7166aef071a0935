"""Declared shapes of the input, checked once on the driver before a job is built."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

# The field types a declaration may name.
FIELD_TYPES = ("null", "string", "int", "float", "bool", "datetime")

# Metric kinds; anything else counts as a gauge.
METRIC_TYPES = ("counter", "gauge")
DEFAULT_METRIC_TYPE = "gauge"

# Fixed value: the record type every long-form sample carries.
SAMPLE_TYPE = "TimeseriesRecord"


@dataclass(frozen=True)
class FieldSpec:
    """One field of a delimited line."""

    name: str
    type: str = "string"
    index: int = 0
    optional: bool = False

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a field needs a name")
        if self.type not in FIELD_TYPES:
            raise ValueError(f"field {self.name!r}: unknown type {self.type!r}, use one of {FIELD_TYPES}")
        if self.index < 0:
            raise ValueError(f"field {self.name!r}: index must not be negative")


def check_fields(fields: Iterable[FieldSpec], num_fields: int = 0) -> tuple[FieldSpec, ...]:
    """Return the fields with their positions settled, or raise ``ValueError``.

    All indexes zero means "in the order given". Otherwise every index must differ. Optional
    fields come last in the list, and names are unique because they become columns.
    ``num_fields`` (0 = highest index + 1) only bounds how many fields may be declared.
    """
    specs = tuple(fields)
    if not specs:
        raise ValueError("at least one field is needed")
    if all(f.index == 0 for f in specs):
        specs = tuple(replace(f, index=i) for i, f in enumerate(specs))
    elif len({f.index for f in specs}) < len(specs):
        raise ValueError("field indexes must be unique")
    if len({f.name for f in specs}) < len(specs):
        raise ValueError("field names must be unique")
    if len(specs) > (num_fields or max(f.index for f in specs) + 1):
        raise ValueError("more fields declared than num_fields")
    flags = [f.optional for f in specs]
    if flags != sorted(flags):
        raise ValueError("optional fields must come last")
    return specs


@dataclass(frozen=True)
class ValueSpec:
    """A measured field and its metric kind."""

    name: str
    metric_type: str = DEFAULT_METRIC_TYPE

    @classmethod
    def parse(cls, text: str) -> ValueSpec:
        """``counter:x`` or ``gauge:x`` or ``x``; only the first colon separates."""
        kind, colon, name = text.partition(":")
        if not colon:
            return cls(text)
        return cls(name, kind if kind in METRIC_TYPES else DEFAULT_METRIC_TYPE)


@dataclass(frozen=True)
class SeriesSpec:
    """How wide records become long samples.

    ``values=None`` takes every field that is not a label, the timestamp or called ``name``.
    ``timestamp=None`` stamps rows with the time of the query (of the micro-batch in a stream).
    """

    labels: tuple[str, ...]
    values: tuple[ValueSpec, ...] | None = None
    timestamp: str | None = None
    extra_labels: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "labels", tuple(self.labels))
        if not self.labels:
            raise ValueError("labels must not be empty")
        if self.values is not None:
            parsed = tuple(v if isinstance(v, ValueSpec) else ValueSpec.parse(v) for v in self.values)
            if not parsed:
                raise ValueError("values must be None or a non-empty list")
            # One kind per field: the later declaration of the same name holds.
            object.__setattr__(self, "values", tuple({v.name: v for v in parsed}.values()))
