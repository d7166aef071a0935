"""Map helpers that leave the session's duplicate-key setting alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def overlay(base: Column, over: Column) -> Column:
    """``base`` with the entries of ``over`` set on top."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def without_keys(base: Column, keys: Column) -> Column:
    """``base`` without the entries named in the array ``keys``."""
    return F.map_filter(base, lambda k, _: ~F.array_contains(keys, k))


def map_of(entries: dict[str, Column]) -> Column:
    """A string map of the given columns, leaving out those that are NULL."""
    if not entries:
        return F.create_map().cast("map<string,string>")
    full = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    complete = F.lit(True)
    for v in entries.values():
        complete = complete & v.isNotNull()
    return F.when(complete, full).otherwise(F.map_filter(full, lambda _, v: v.isNotNull()))


def last_wins_map(keys: Column, values: Column) -> Column:
    """A map of two parallel arrays where a repeated key keeps its last value."""
    rk, rv = F.reverse(keys), F.reverse(values)
    different = F.array_distinct(rk)
    last = F.transform(different, lambda k: F.get(rv, F.array_position(rk, k).cast("int") - 1))
    return F.when(F.size(different) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(different, last))


def parse_map_text(c: Column) -> Column:
    """``{k=v, ...}`` as a string map; NULL unless every entry has exactly one ``=``."""
    t = strip(c)
    items = F.split(F.substr(t, F.lit(2), F.length(t) - 2), ",", -1)
    well_formed = F.forall(items, lambda x: F.size(F.split(x, "=", -1)) == 2)
    keys = F.transform(items, lambda x: strip(F.substring_index(x, "=", 1)))
    values = F.transform(items, lambda x: strip(F.substring_index(x, "=", -1)))
    framed = t.startswith("{") & t.endswith("}") & (F.length(t) >= 2)
    return F.when(framed & well_formed, last_wins_map(keys, values))


def parse_array_text(c: Column) -> Column:
    """``[a, b, ...]`` as a string array; empty items are skipped, NULL without the brackets."""
    t = strip(c)
    items = F.transform(F.split(F.substr(t, F.lit(2), F.length(t) - 2), ",", -1), strip)
    framed = t.startswith("[") & t.endswith("]") & (F.length(t) >= 2)
    return F.when(framed, F.filter(items, lambda x: x != ""))
