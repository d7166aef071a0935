"""Graphite lines (``metric value epoch [key=value ...]``) to typed rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import cast_field, cast_float, is_missing, parse_epoch
from ..functions.maps import last_wins_map, map_of, overlay
from ..functions.once import computed_once
from ..functions.text import NON_SPACE, SPACE, strip, value_text
from ..specs import FIELD_TYPES
from .lines import stamp_origin

# The shape of a line. Blanks between parts are spaces or tabs.
BLANK = r"[ \t]+"
FLOAT_RE = r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|infinity|inf))\z"
# Each match starts where the one before ended, so the list stops at the first malformed piece.
PAIR_RE = rf"\G[ \t]*([^=\s\x85\p{{Z}}]+)=({NON_SPACE}+)"

_NUMBERS = "map<string,struct<value:double,unit:string>>"
# What each declared type is once parsed.
_PARSED = {
    "null": T.StringType(),
    "string": T.StringType(),
    "int": T.StructType([T.StructField("value", T.LongType()), T.StructField("unit", T.StringType())]),
    "float": T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())]),
    "bool": T.BooleanType(),
    "datetime": T.TimestampType(),
}


def _plain_double(text: Column) -> Column:
    """A number without unit; the cast is laxer only in suffixes, named values and hexadecimal digits."""
    value, last = text.try_cast("double"), F.ascii(F.substring(text, -1, 1))
    plain = F.ascii(text).between(43, 57) & (last.between(48, 57) | (last == 46)) & ~text.contains("x") & ~text.contains("X")
    return F.when(plain, value).otherwise(F.when(text.rlike(FLOAT_RE), text).try_cast("double"))


def read_graphite(
    lines: DataFrame,
    attr_types: Mapping[str, str] | None = None,
    *,
    line: str = "value",
    inbound: str = "graphite",
) -> DataFrame:
    """One row per non-blank line: ``metric, value, ts, attrs, numbers, _inbound, _raw, _error``.

    ``attrs`` holds every attribute as text. ``numbers`` holds those declared ``int``, ``float``
    or ``bool`` as ``struct<value, unit>``; they count as measurements later. The attribute list
    ends at the first piece that is not ``key=value`` and a repeated key keeps its last value.
    An attribute named like the metric or ``timestamp`` replaces it if it is declared with a
    fitting type, otherwise the line is rejected. Other columns of ``lines`` are passed through.
    """
    types = dict(attr_types or {})
    unknown = {k: v for k, v in types.items() if v not in FIELD_TYPES}
    if unknown:
        raise ValueError(f"unknown attribute types: {unknown}")
    kept = [F.col(f"`{c}`") for c in lines.columns if c != line]

    part = F.split(F.col(line), BLANK, 4)
    heads = lines.where(strip(F.col(line)) != "").select(*kept, F.col(line).alias("_raw"), part.alias("_p"))
    part = [F.get("_p", F.lit(i)) for i in range(4)]
    split = heads.select(
        *kept,
        "_raw",
        part[0].alias("metric"),
        _plain_double(part[1]).alias("value"),
        F.regexp_extract(part[2], "^[0-9]+", 0).alias("_epoch"),
        # Text right after the epoch leaves no room for attributes.
        F.when(part[2].rlike(r"^[0-9]+\z"), F.coalesce(part[3], F.lit(""))).otherwise(F.lit("")).alias("_attrs"),
    )
    # each pair is matched once, then cut at its first equals sign
    pairs = split.withColumn("_pairs", F.regexp_extract_all("_attrs", F.lit(PAIR_RE), F.lit(0))).select(
        *kept,
        "_raw",
        "metric",
        "value",
        "_epoch",
        parse_epoch(F.col("_epoch")).alias("ts"),
        F.when(F.col("_attrs") == "", F.create_map().cast("map<string,string>"))
        .otherwise(
            last_wins_map(
                F.transform("_pairs", lambda x: F.ltrim(F.substring_index(x, "=", 1), F.lit(" \t"))),
                F.transform("_pairs", lambda x: F.substr(x, F.position(F.lit("="), x) + 1)),
            )
        )
        .alias("attrs"),
    )
    no_line = (F.col("metric") == "") | F.col("metric").rlike(SPACE) | F.col("value").isNull()
    error = F.when(no_line | F.coalesce(F.col("_epoch") == "", F.lit(True)), F.lit("not a metric line")).when(
        F.col("ts").isNull(), F.lit("epoch is not 10, 13, 16 or 19 digits")
    )
    attrs, value, ts = F.col("attrs"), F.col("value"), F.col("ts")
    numbers = F.create_map().cast(_NUMBERS)

    if types:
        declared = {n: f"_a{i}" for i, n in enumerate(sorted(types))}
        typed = pairs.select(
            "*", *[cast_field(F.try_element_at("attrs", F.lit(n)), types[n]).alias(c) for n, c in declared.items()]
        )
        measured = {n: cast_float(F.col(c), _PARSED[types[n]]) for n, c in declared.items()}
        measured = {n: m for n, m in measured.items() if m is not None}
        for n, c in declared.items():
            if types[n] not in ("null", "string"):
                given = F.map_contains_key("attrs", F.lit(n))
                error = error.when(given & is_missing(F.col(c), types[n]), F.lit(f"attribute {n} is not a valid {types[n]}"))
        shown = {n: value_text(F.col(c), _PARSED[types[n]]) for n, c in declared.items()}
        attrs = overlay(attrs, map_of(shown))
        if measured:
            full = F.create_map(*[x for n, m in measured.items() for x in (F.lit(n), m)])
            numbers = F.map_filter(full, lambda _, v: v.isNotNull())
        if types.get("timestamp") == "datetime":
            ts = F.coalesce(F.col(declared["timestamp"]), ts)
    else:
        typed = pairs

    if types.get("timestamp") != "datetime":
        error = error.when(
            F.map_contains_key("attrs", F.lit("timestamp")), F.lit("attribute replaces the timestamp")
        )
    same_name = F.try_element_at(numbers, F.col("metric"))["value"]
    error = error.when(
        F.map_contains_key("attrs", F.col("metric")) & same_name.isNull(), F.lit("attribute replaces the value")
    )
    value = F.coalesce(same_name, value)

    ok = F.col("_error").isNull()
    parsed = typed.select(
        *kept,
        "metric",
        value.alias("value"),
        ts.alias("ts"),
        attrs.alias("attrs"),
        numbers.alias("numbers"),
        "_raw",
        error.alias("_error"),
    )
    names = ("metric", "value", "ts", "attrs", "numbers")
    rows = computed_once(parsed).select(*kept, *[F.when(ok, F.col(n)).alias(n) for n in names], "_raw", "_error")
    return stamp_origin(rows, inbound)
