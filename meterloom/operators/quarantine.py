"""Good rows and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..specs import SAMPLE_TYPE


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` by ``_error``; good rows lose ``_error`` and ``_raw``.

    Both come from the same input: persist it first if both are written.
    """
    good = df.where(F.col("_error").isNull()).drop("_error", "_raw")
    rejects = df.where(F.col("_error").isNotNull())
    return good, rejects.select(*[c for c in ("_inbound", "_file", "_raw", "_error") if c in df.columns])


def reject_summary(df: DataFrame) -> DataFrame:
    """Rejected rows per origin and reason."""
    return (
        df.where(F.col("_error").isNotNull())
        .groupBy("_inbound", "_error")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def keep_type(df: DataFrame, record_type: str = SAMPLE_TYPE) -> tuple[DataFrame, Observation]:
    """Rows of one record type, and an observation with ``kept`` and ``dropped`` counts.

    Rows without a type are dropped too. The counts are there once an action has run.
    """
    matches = F.coalesce(F.col("_type") == record_type, F.lit(False))
    seen = Observation()
    counted = df.observe(
        seen,
        F.count_if(matches).alias("kept"),
        F.count_if(~matches).alias("dropped"),
    )
    return counted.where(matches), seen
