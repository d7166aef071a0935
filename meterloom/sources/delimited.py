"""Delimited lines to typed rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import cast_field, is_missing
from ..functions.once import computed_once
from ..functions.text import split_delimited, strip, token
from ..specs import FieldSpec, check_fields
from .lines import stamp_origin


def read_delimited(
    lines: DataFrame,
    fields: Iterable[FieldSpec],
    *,
    sep: str = ",",
    num_fields: int = 0,
    line: str = "value",
    inbound: str = "delimited",
    units: bool = True,
) -> DataFrame:
    """One row per non-blank line: the typed fields, ``_inbound``, ``_raw`` and ``_error``.

    A line that breaks any rule keeps its text in ``_raw``, the first broken rule in ``_error``
    and NULL in every field; see :func:`meterloom.operators.quarantine.split_rejects`. Other
    columns of ``lines`` are passed through. ``units=False`` drops the units of numbers and
    leaves plain number columns.
    """
    specs = check_fields(fields, num_fields)
    clash = {f.name for f in specs} & (set(lines.columns) - {line})
    if clash:
        raise ValueError(f"field names already in use: {sorted(clash)}")
    kept = [F.col(f"`{c}`") for c in lines.columns if c != line]

    tokens = lines.where(strip(F.col(line)) != "").select(
        *kept, F.col(line).alias("_raw"), split_delimited(F.col(line), sep).alias("_tokens")
    )
    texts = tokens.select(
        *kept,
        "_raw",
        "_tokens",
        *[token(F.col("_tokens"), f.index).alias(f"_t{f.index}") for f in specs],
    )
    typed = texts.select(
        "*", *[cast_field(F.col(f"_t{f.index}"), f.type, stripped=True).alias(f"_v{f.index}") for f in specs]
    )
    checked = computed_once(
        typed.select(
            *kept,
            "_raw",
            *[F.col(f"_v{f.index}") for f in specs],
            _first_error(specs).alias("_error"),
        )
    )

    def column(f: FieldSpec) -> Column:
        v = F.col(f"_v{f.index}")
        if f.type in ("int", "float") and not units:
            v = v["value"]
        return F.when(F.col("_error").isNull(), v).alias(f.name)

    rows = checked.select(*kept, *[column(f) for f in specs], "_raw", "_error")
    return stamp_origin(rows, inbound)


def _first_error(specs: tuple[FieldSpec, ...]) -> Column:
    needed = max((f.index for f in specs if not f.optional), default=0) + 1
    allowed = max(f.index for f in specs) + 1
    n = F.size("_tokens")
    error = F.when(n < needed, F.format_string(f"too few fields: %d, need {needed}", n)).when(
        n > allowed, F.format_string(f"too many fields: %d, allowed {allowed}", n)
    )
    for f in specs:
        if not f.optional:
            # Blanks between quotes are a NULL rather than a missing field.
            blank = F.get("_tokens", F.lit(f.index)).rlike('^"[^"]+"')
            missing = (F.col(f"_t{f.index}") == "") & ~blank
            error = error.when(missing, F.lit(f"required field {f.name} is empty"))
    for f in specs:
        if f.type not in ("null", "string"):
            bad = is_missing(F.col(f"_v{f.index}"), f.type) & (F.col(f"_t{f.index}") != "")
            error = error.when(bad, F.lit(f"field {f.name} is not a valid {f.type}"))
    return error
