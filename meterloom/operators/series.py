"""Samples to series: one row per label set and period, samples in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

MAX_SAMPLES = 500_000
# Below this many rows the tables of hot groups and of their cuts are broadcast.
BROADCAST_GROUPS = 10_000


def label_pairs(name: Column, labels: Column) -> Column:
    """Label set of a series with its metric as ``__name__``, ordered by label name.

    ``__name__`` is put beside the sample's own labels; one of them called ``__name__`` stays too.
    """
    pairs = F.concat(F.map_entries(labels), F.array(F.struct(F.lit("__name__").alias("key"), name.alias("value"))))
    return F.sort_array(pairs).cast("array<struct<name:string,value:string>>")


def labels_text(pairs: Column) -> Column:
    """``a=1,b=2``"""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["value"], F.lit("null")))), ",")


def to_series_rows(samples: DataFrame) -> DataFrame:
    """``labels, timestamp (ms), value, ts`` of each sample that has all its parts."""
    complete = F.lit(True)
    for c in ("name", "metric_type", "labels", "ts", "value"):
        complete = complete & F.col(c).isNotNull()
    return samples.where(complete).select(
        label_pairs(F.col("name"), F.col("labels")).alias("labels"),
        F.unix_millis("ts").alias("timestamp"),
        "value",
        "ts",
    )


def series_row_errors(samples: DataFrame) -> DataFrame:
    """The samples with ``_error``: the part a sample lacks, NULL where none."""
    error = None
    for c in ("name", "metric_type", "labels", "ts", "value"):
        missing = F.col(c).isNull(), F.lit(f"sample without {c}")
        error = F.when(*missing) if error is None else error.when(*missing)
    return samples.withColumn("_error", error)


def assemble_series(samples: DataFrame, chunk: str = "1 day", *, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """``labels, chunk_start, part, samples``: the samples of a label set in a period.

    Repeated samples are kept. ``samples`` is read once, into a table; a group (labels, period) is gathered by
    one exchange. A group above ``max_samples`` is cut into parts that follow each other in time, so
    no array grows without bound and no part begins before the one ahead of it ends; every other group is
    part 0. Cuts come from counts per instant, summed stretch by stretch. Only an instant that alone
    exceeds half a part is dealt over several parts by hash.
    """
    if samples.isStreaming:
        raise ValueError("assemble a stream inside foreachBatch, see meterloom.streaming")
    rows = to_series_rows(samples).select(
        "labels", F.window("ts", chunk)["start"].alias("chunk_start"), "timestamp", "value"
    )
    scratch = Scratch(samples.sparkSession, "series")
    # The hash leads the grouping key: sorting compares it first, and it nearly always decides.
    rows = scratch.keep(rows.withColumn("_h", F.xxhash64("labels", "chunk_start")))
    by = ["_h", "labels", "chunk_start"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("all"), F.min("timestamp").alias("begin"), F.max("timestamp").alias("end"))
    hot = scratch.keep(sizes.where(F.col("all") > max_samples))
    if hot.isEmpty():
        return _gather(rows.withColumn("part", F.lit(0)), by)
    cuts = _cuts(rows.join(_small(hot), by), by, max(1, max_samples // 2), scratch)
    same = [rows[c] == cuts[c] for c in by]
    inside = (rows["timestamp"] >= cuts["from"]) & (rows["timestamp"] < cuts["to"])
    condition = same[0] & same[1] & same[2] & inside
    # where in its instant's share a sample falls, if that is dealt over several parts
    nth = F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.col("burst"))
    part = F.when(F.col("burst").isNull(), F.col("part")).otherwise(F.floor((F.col("start") + nth) / F.col("size")))
    placed = rows.join(_small(cuts), condition, "left").select(
        *[rows[c] for c in rows.columns], F.coalesce(part, F.lit(0)).cast("int").alias("part")
    )
    return _gather(placed, by)


def _small(table: DataFrame) -> DataFrame:
    """With a broadcast hint if the written table is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def _gather(rows: DataFrame, by: list[str]) -> DataFrame:
    samples = F.sort_array(F.collect_list(F.struct("timestamp", "value")))
    return rows.groupBy(*by, "part").agg(samples.alias("samples")).drop("_h")


def _cuts(rows: DataFrame, by: list[str], size: int, scratch: Scratch) -> DataFrame:
    """``from, to, part`` stretches of each group with about ``size`` samples, of instants ``from <= t < to``.

    An instant of more samples is a stretch of its own, with ``start`` (samples before it) and ``burst``
    (samples in it). One row for each half part of samples: two for an instant with a burst.
    """
    # a thousand stretches of equal time: their sums are added up group by group, and the rest within each
    share = (F.col("timestamp") - F.col("begin")) / F.greatest(F.col("end") - F.col("begin"), F.lit(1))
    counts = rows.groupBy(*by, F.floor(share * 1023).alias("stretch"), "timestamp").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.keep(counts)
    before = counts.groupBy(*by, "stretch").agg(F.sum("n").alias("m"))
    base = (F.sum("m").over(Window.partitionBy(*by).orderBy("stretch")) - F.col("m")).alias("base")
    before = before.select(*by, "stretch", base)
    within = F.sum("n").over(Window.partitionBy(*by, "stretch").orderBy("timestamp")) - F.col("n")
    starts = counts.withColumn("within", within).join(before, [*by, "stretch"]).withColumn("start", F.col("base") + F.col("within"))
    burst = F.when(F.col("n") > size, F.col("n"))
    pieces = starts.withColumn("part", F.floor(F.col("start") / size)).withColumn("burst", burst)
    # instants after a burst in the same part are a stretch again
    piece = pieces.groupBy(*by, "part", "burst", F.when(F.col("burst").isNotNull(), F.col("timestamp")).alias("at")).agg(
        F.min("timestamp").alias("from"), F.max("timestamp").alias("last"), F.min("start").alias("start")
    )
    return scratch.keep(piece.select(*by, "from", (F.col("last") + 1).alias("to"), "part", "start", "burst", F.lit(size).alias("size")))


def summarize_series(samples: DataFrame, scale: int | None = None) -> DataFrame:
    """One row per label set: sample count, first and last instant, least and greatest value, total.

    Totals are sums of doubles, so NaN and infinities stay in them and no value is too large or too small. With
    ``scale``, they are exact decimals of so many places, the same in any order of addition; values that
    a decimal of 38 digits cannot hold are counted in ``left_out``. Partial aggregation does
    the work before the exchange, however many samples one series has.
    """
    rows = to_series_rows(samples)
    if scale is None:
        totals = [F.sum("value").alias("total")]
    else:
        exact = F.col("value").try_cast(f"decimal(28,{scale})")
        totals = [F.sum(exact).alias("total"), F.count_if(exact.isNull()).alias("left_out")]
    return (
        rows.groupBy(F.xxhash64("labels").alias("_h"), "labels")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("first_ms"),
            F.max("timestamp").alias("last_ms"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            *totals,
        )
        .drop("_h")
    )

