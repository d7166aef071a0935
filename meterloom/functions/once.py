"""Steering what the optimizer and the code generator do with parse expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows and columns, behind a generator of exactly one row.

    The optimizer moves a filter below the projection that computes its column and so computes
    that column twice, with everything it is built from. It does not move one below a generator
    whose output the filter reads. Narrow, and part of the same generated code.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def out_of_line(c: Column, parse: Callable[[Column], Column]) -> Column:
    """``parse(c)``, evaluated outside the generated code.

    For the rare branches of a parse. The JVM does not compile methods above 8000 bytes, so a
    projection that spells out every rare form runs its common forms interpreted as well.
    """
    return F.get(F.transform(F.array(c), parse), F.lit(0))
