"""Interleaving of sources at target weights by a proportionally fair schedule."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sources at most.
PERIOD = 4096
#: Documents of one source that follow each other.
BLOCK = 32
#: Rows that one task numbers at most, about.
NUMBERED = 20_000
#: Slots that one task turns into rows, and slots up to which the schedule is broadcast.
STRETCH, BROADCAST = 1 << 16, 1 << 18


def whole_weights(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots of each source in a period: the weights' shares rounded by largest remainder, one at least."""
    if not weights:
        return {}
    if len(weights) > period or any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError(f"needs positive, finite weights of at most {period} sources")
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    exact = {s: weights[s] / total * period for s in names}
    slots = {s: max(1, int(exact[s])) for s in names}
    while (rest := period - sum(slots.values())) > 0:
        for s in sorted(names, key=lambda s: slots[s] - exact[s])[:rest]:
            slots[s] += 1
    while sum(slots.values()) > period:
        slots[max(names, key=lambda s: (slots[s] > 1, slots[s] - exact[s]))] -= 1
    return slots


def exact_parts(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the very proportions of the weights."""
    if len(weights) > PERIOD or any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError(f"needs positive, finite weights of at most {PERIOD} sources")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def earliest_due(parts: list[int], needed: list[int] | None = None, end: int | None = None) -> Iterator[tuple[int, int]]:
    """For each slot which source and which of its blocks, without end.

    Block i (from 0) of a source of weight w = its part / all parts is released at floor(i / w) and due at
    ceil((i + 1) / w). Of the released blocks the one due first gets the slot. The weights sum to one, so
    all meet their times, and after any number of slots each source is less than one block from its share.
    With ``end``, the block that completes a source's ``needed`` ones is due by then; if that cannot be
    met, the slots break off where a block misses its time.
    """
    total = sum(parts)
    waiting = [(0, k, 0) for k in range(len(parts))]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            due = -(-(i + 1) * total // parts[k])
            heapq.heappush(ready, (min(due, end) if end is not None and i == needed[k] - 1 else due, k, i))
        due, k, i = heapq.heappop(ready)
        if due <= slot:
            if end is None:
                raise AssertionError("a block missed its deadline")
            return
        yield k, i
        slot += 1
        heapq.heappush(waiting, ((i + 1) * total // parts[k], k, i + 1))


def fair_schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """For each slot of one period (all slots together) the source and which of its blocks."""
    names = list(slots)
    return [(names[k], i) for k, i in islice(earliest_due(list(slots.values())), sum(slots.values()))]


def whole_schedule(parts: list[int], needed: list[int]) -> array:
    """The source of each slot, up to the first slot by which every source has had its ``needed`` blocks.

    A source may be up to a block ahead, so a small one need not wait until its share is a whole block: the
    earliest end that the times allow is tried first, then later ones by eighths.
    """
    total = sum(parts)
    end = max((n - 1) * total // p for p, n in zip(parts, needed)) + 1
    last = max(-(-n * total // p) for p, n in zip(parts, needed))
    while True:
        out, left = array("H"), len(parts)
        for k, i in earliest_due(parts, needed, end if end < last else None):
            out.append(k)
            left -= i + 1 == needed[k]
            if not left:
                return out
        end += -(-end // 8)


def tempered_weights(counts: Mapping[str | None, int], power: float) -> dict[str | None, float]:
    """Shares of the counts raised to a power: below 1, large sources weigh less than their size."""
    return {s: n**power for s, n in counts.items() if n > 0}


def source_counts(docs: DataFrame, source: str = "source") -> dict[str | None, int]:
    """Rows of each source; the number of sources must be small (a mixture names them one by one)."""
    rows = docs.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n")).limit(PERIOD + 1).collect()
    if len(rows) > PERIOD:
        raise ValueError(f"more than {PERIOD} sources")
    return {r["s"]: r["n"] for r in rows}


def _schedule_rows(spark: SparkSession, names: list[str | None], order: array, in_epoch: list[int]) -> DataFrame:
    """``_s, _block, mix_epoch, mix_slot``: the slots of each block of a source. The driver keeps 2 bytes a slot."""
    codes = np.frombuffer(order, np.uint16)
    cuts = range(0, len(codes), STRETCH)
    before = np.cumsum([np.zeros(len(names), np.int64)] + [np.bincount(codes[x : x + STRETCH], minlength=len(names)) for x in cuts], axis=0)
    shared = spark.sparkContext.broadcast((codes, before, np.array(in_epoch)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, before, in_epoch = shared.value
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = codes[x * STRETCH : (x + 1) * STRETCH].astype(np.int64)
                order = np.argsort(own, kind="stable")
                nth = np.empty(len(own), np.int64)
                nth[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
                nth += before[x][own]
                out = [own, nth % in_epoch[own], nth // in_epoch[own], x * STRETCH + np.arange(len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in out], names=["_code", "_block", "mix_epoch", "mix_slot"])

    rows = spark.range(0, len(cuts), 1, min(len(cuts), 256)).mapInArrow(run, "_code bigint, _block bigint, mix_epoch bigint, mix_slot bigint")
    named = spark.createDataFrame(list(enumerate(names)), "_code bigint, _s string")
    rows = rows.join(F.broadcast(named), "_code").drop("_code")
    return F.broadcast(rows) if len(codes) <= BROADCAST else rows


def mix_sources(
    docs: DataFrame, weights: Mapping[str | None, float], counts: Mapping[str | None, int], block: int = BLOCK, period: int | None = None,
    key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``docs`` with ``mix_epoch, mix_slot, mix_place``: where each row comes in the mixture.

    The rows of a source, in the order of a hash of ``key`` (and of the whole row where keys are equal),
    are cut into blocks (the last may be short), and the schedule's slots take the blocks in turn. The
    mixture ends with the first slot by which every row of every source has come. A source whose share
    is above what it holds begins again (``mix_epoch`` counts from 0), so its rows come more than once; no row
    is left out. The mixture's order is ``mix_slot``, then ``mix_place``, the place in the block.

    ``counts`` are the rows of each source. Every source must have a weight; null is a source of its own.
    An empty table gives no rows. Clashing column names are an error, other columns pass through.

    After any slot each source has had less than one block more or less than its weight's exact share, and so the
    mixture is as long as the smallest shares need to bring their blocks. ``period`` rounds the weights to
    multiples of its inverse, one at least.

    Rows are numbered in pieces of a source by ranges of the hash, whose counts are added up first, so a
    source with most rows is no single task. The schedule is made on the driver, 2 bytes for each slot (a block).
    """
    made = ["mix_epoch", "mix_slot", "mix_place"]
    if clash := {*made, "_n", "_piece", "_h", "_before", "_start", "_block", "_s"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    if missing := [s for s, n in counts.items() if n and s not in weights]:
        raise ValueError(f"no weight for {missing}")
    spark, c = docs.sparkSession, F.col
    own = {s: w for s, w in weights.items() if counts.get(s)}
    if not own:
        return docs.select("*", *[F.lit(0).cast("bigint").alias(x) for x in made]).limit(0)
    parts = exact_parts(own if period is None else whole_weights(own, period))
    names = list(parts)
    in_epoch = [-(-counts[s] // block) for s in names]
    schedule = _schedule_rows(spark, names, whole_schedule(list(parts.values()), in_epoch), in_epoch)

    pieces = max(256, sum(counts.values()) // NUMBERED)
    h = F.xxhash64(F.col(key), F.lit(2))
    rows = docs.withColumn("_h", h).withColumn("_piece", F.pmod(F.shiftright("_h", 1), F.lit(pieces)))
    sizes = docs.select(c(source).alias("_s"), F.pmod(F.shiftright(h, 1), F.lit(pieces)).alias("_p")).groupBy("_s", "_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_s", "_p", (F.sum("_c").over(Window.partitionBy("_s").orderBy("_p")) - c("_c")).alias("_before"))
    whole_row = F.xxhash64(*[F.to_json(F.struct(x)) for x in docs.columns])
    within = Window.partitionBy(source, "_piece").orderBy("_h", key, whole_row)
    return (
        rows.withColumn("_n", F.row_number().over(within) - 1)
        .join(before, c(source).eqNullSafe(c("_s")) & (c("_piece") == c("_p"))).drop("_s", "_p")
        .withColumn("_start", c("_before") + c("_n"))
        .withColumn("_block", F.floor(c("_start") / F.lit(block)))
        .join(schedule.withColumnRenamed("_block", "_b"), c(source).eqNullSafe(c("_s")) & (c("_block") == c("_b")))
        .select(*docs.columns, "mix_epoch", "mix_slot", F.pmod(c("_start"), F.lit(block)).alias("mix_place"))
    )
