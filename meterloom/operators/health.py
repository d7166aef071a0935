"""Pipeline health: latency figures per stage, freshness per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import as_timestamp

# The reported quantiles (numerator, denominator); rank is floor(n * q), from 0.
QUANTILES = {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4), "p90": (9, 10)}
LAG_WARNING_MS = 1000


def latency_counts(
    df: DataFrame, *, key: str, ts: str, elapsed_us: str, window: str = "10 seconds"
) -> DataFrame:
    """``key, window_start, ms, c, us``: rows and total microseconds per group and millisecond.

    Works on a stream with a watermark on ``ts`` too: in append mode all rows of a window come out
    in the micro-batch that closes it.
    """
    elapsed = F.col(elapsed_us).cast("bigint")
    return (
        df.where(F.col(elapsed_us).isNotNull() & F.col(ts).isNotNull())
        .groupBy(
            F.col(key).alias("key"),
            F.window(F.col(ts) if df.isStreaming else as_timestamp(df, ts), window).alias("_w"),
            F.call_function("div", elapsed, F.lit(1000)).alias("ms"),
        )
        .agg(F.count(F.lit(1)).alias("c"), F.sum(elapsed.cast("decimal(20,0)")).alias("us"))
        .select("key", F.col("_w.start").alias("window_start"), "ms", "c", "us")
    )


def latency_figures(counts: DataFrame) -> DataFrame:
    """The summary of :func:`latency_counts`: count, mean, least, greatest and quantiles in ms."""
    group = Window.partitionBy("key", "window_start")
    placed = counts.select(
        "*",
        F.sum("c").over(group.orderBy("ms")).alias("upto"),
        F.sum("c").over(group).alias("n"),
    )

    def at(num: int, den: int) -> Column:
        position = F.call_function("div", F.col("n") * num, F.lit(den))
        return F.min(F.when(F.col("upto") > position, F.col("ms")))

    return placed.groupBy("key", "window_start").agg(
        F.sum("c").alias("count"),
        F.call_function("div", F.sum("us"), F.sum("c") * 1000).alias("mean_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        *[at(*q).alias(f"{name}_ms") for name, q in QUANTILES.items()],
    )


def latency_summary(
    df: DataFrame, *, key: str, ts: str, elapsed_us: str, window: str = "10 seconds"
) -> DataFrame:
    """``key, window_start, count, mean_ms, min_ms, max_ms, p25_ms, p50_ms, p75_ms, p90_ms``.

    ``elapsed_us`` are microseconds; every figure is cut to whole milliseconds. A quantile is the
    value at position ``floor(n * q)`` of the sorted group. Rows are first counted per group and
    millisecond, which keeps the order (cutting never swaps two values): what one task sees of a
    group is at most one row per distinct millisecond, however many rows the group holds.
    """
    return latency_figures(latency_counts(df, key=key, ts=ts, elapsed_us=elapsed_us, window=window))


def freshness(df: DataFrame, *, by: str, ts: str, now: Column | None = None) -> DataFrame:
    """``by, last_ts, lag_ms, lagging``: how far each source's newest row lies behind ``now``."""
    now = F.current_timestamp() if now is None else now
    lag = F.unix_millis(now) - F.unix_millis("last_ts")
    return (
        df.groupBy(by)
        .agg(F.max(as_timestamp(df, ts)).alias("last_ts"))
        .select(by, "last_ts", lag.alias("lag_ms"), (lag > LAG_WARNING_MS).alias("lagging"))
    )


def observe_freshness(df: DataFrame, ts: str = "ts") -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its newest instant (``last_ms``) and row count (``rows``)."""
    seen = Observation()
    last = F.max(F.unix_millis(as_timestamp(df, ts)))
    return df.observe(seen, last.alias("last_ms"), F.count(F.lit(1)).alias("rows")), seen
