"""Exact top-k by inner product through a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .vectors import BLOCK_ROWS, asked_vectors, kth_scores, matrix, one_of_each, ranked, scan_blocks, usable_vectors

#: Pivots; rings about each pivot at most; vectors that pivots and rings are fitted on at most.
PIVOTS, RINGS, SAMPLE = 16, 64, 20_000


@dataclass
class Pivots:
    """Pivots in a space of one more component, in which all rows are of length ``reach``.

    There the squared distance of a query q to a row x is |q|^2 + reach^2 - 2 q.x, so the highest inner products are the
    nearest rows, and the triangle inequality holds.
    """

    reach: float
    points: np.ndarray
    cuts: list[np.ndarray]

    def distances(self, x: np.ndarray, rows: bool) -> np.ndarray:
        last = np.sqrt(np.maximum(self.reach**2 - (x * x).sum(1), 0)) if rows else np.zeros(len(x))
        lifted = np.hstack([x, last[:, None]])
        return np.stack([np.sqrt(((lifted - p) ** 2).sum(1)) for p in self.points], 1)

    def ring(self, pivot: np.ndarray, distance: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pivot), np.int64)
        for p in np.unique(pivot):
            out[pivot == p] = np.searchsorted(self.cuts[p], distance[pivot == p])
        return out + pivot * RINGS


def choose_pivots(sample: np.ndarray, reach: float, rows: int, seed: int = 8) -> Pivots:
    """Pivots by a few rounds of k-means from far-apart starts; rings by the sample's quantiles of distance."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lifted = np.hstack([sample, np.sqrt(np.maximum(reach**2 - (sample * sample).sum(1), 0))[:, None]])
    points = lifted[rng.integers(len(lifted))][None]
    gap = ((lifted - points[0]) ** 2).sum(1)
    while len(points) < min(PIVOTS, len(lifted)) and gap.max() > 0:
        new = lifted[rng.choice(len(lifted), p=gap / gap.sum())]
        points, gap = np.vstack([points, new]), np.minimum(gap, ((lifted - new) ** 2).sum(1))
    for _ in range(5):
        near = Pivots(reach, points, []).distances(sample, rows=True).argmin(1)
        points = np.stack([lifted[near == p].mean(0) if (near == p).any() else points[p] for p in range(len(points))])
    found = Pivots(reach, points, [])
    distances = found.distances(sample, rows=True)
    near = distances.argmin(1)
    rings = int(np.clip(rows // (len(points) * BLOCK_ROWS // 2), 1, RINGS))
    for p in range(len(points)):
        own = distances[near == p, p]
        found.cuts.append(np.unique(np.quantile(own, np.arange(1, rings) / rings)) if len(own) else np.empty(0))
    return found


def integer_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact in any order: as doubles while no sum can pass 2^53."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("scores must fit into 64 bits")
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def exact_topk(df: DataFrame, query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Each query's ``k`` highest integer inner products: ``query_id, rank, vec_id, score long``.

    Components become floor(scale * x). ``query`` is a condition on the column ``id`` (the key) that chooses
    the queries; all other usable rows are candidates, see :func:`usable_vectors`; zero vectors take part.
    Fewer candidates than ``k``: all. No usable rows or queries: no result rows. Other columns are not read.

    Rows are keyed by their nearest pivot and the distance to it, and cut into rings about the pivot; only
    pivots and ring borders are fitted on a bounded sample. A query is first scored in the block where it would
    lie itself, which bounds its k-th best score and so the radius within which all better rows lie. By the triangle
    inequality these are within that radius of the query's own distance to any pivot: only rings that reach into
    that annulus are visited, and only the stretch of a ring's sorted rows that is in it is scored. Rings of many rows
    are several blocks, by a hash.
    """
    spark, c = df.sparkSession, F.col
    scratch = Scratch(spark, "topk")
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = scratch.keep(usable_vectors(df, key, vector, zeros=True).select("id", whole.alias("v")))
    distinct = scratch.keep(one_of_each(rows, k))
    squares = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    size = distinct.agg(F.count("*").alias("n"), F.max(squares).alias("m")).first()
    drawn = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    if not size["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = choose_pivots(matrix(drawn["v"]), float(np.sqrt(size["m"])), size["n"])
    shared = spark.sparkContext.broadcast(pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = shared.value.distances(matrix(batch.column("v")), rows=True)
            near = distances.argmin(1)
            own = distances[np.arange(len(near)), near]
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ring(near, own)), pa.array(own), batch.column("id"), batch.column("v")], names=["ring", "key", "id", "v"])

    index = scratch.keep(distinct.select("id", "v").mapInArrow(keyed, "ring bigint, key double, id bigint, v array<bigint>"))
    # the directory: at most PIVOTS * RINGS rows
    directory = {
        r["ring"]: (-(-r["n"] // BLOCK_ROWS), r["lo"], r["hi"])
        for r in index.groupBy("ring").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    }
    most = max(n for n, _, _ in directory.values())
    many = spark.createDataFrame([(ring, n) for ring, (n, _, _) in directory.items()], "ring bigint, blocks bigint")
    held = index.join(F.broadcast(many), "ring").select((c("ring") * most + F.pmod(F.xxhash64("id"), c("blocks"))).alias("block"), "key", "id", "v")
    wanted = asked_vectors(rows, distinct, query)
    asked = scratch.keep(distinct.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "v"))
    fields = "block bigint, key double, id bigint, v array<bigint>, low double, high double, least double"
    names = [x.split(" ")[0] for x in fields.split(", ")]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To one block of the nearest ring that there is."""
        rings = np.array(sorted(directory))
        lows, highs = np.array([directory[r][1] for r in rings]), np.array([directory[r][2] for r in rings])
        for batch in batches:
            n = batch.num_rows
            distances = shared.value.distances(matrix(batch.column("v")), rows=False)[:, rings // RINGS]
            outside = np.maximum(np.maximum(lows - distances, distances - highs), 0)
            chosen = np.lexsort((distances, outside))[:, 0] if n else np.empty(0, int)
            block = [rings[r] * most + i % directory[rings[r]][0] for i, r in zip(batch.column("id").to_pylist(), chosen)]
            ends = [pa.array(np.full(n, x)) for x in (-np.inf, np.inf, -np.inf)]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(distances[np.arange(n), chosen]), batch.column("id"), batch.column("v"), *ends], names=names)

    first = scan_blocks(held, asked.mapInArrow(home, fields), integer_products, k + 1, "bigint")
    least = kth_scores(first, k + 1)

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To every block of every ring within the radius."""
        for batch in batches:
            x = matrix(batch.column("v"))
            distances = shared.value.distances(x, rows=False)
            bound = np.nan_to_num(batch.column("least").to_numpy(zero_copy_only=False), nan=-np.inf)
            squares = (x * x).sum(1) + shared.value.reach**2
            # a little more, for what distances are rounded by; without a bound everything is inside
            radius = np.sqrt(np.maximum(squares - 2 * bound, 0)) + 1e-9 * np.sqrt(squares) + 1e-6
            for i in range(batch.num_rows):
                to = []
                for ring, (n, low, high) in directory.items():
                    d = distances[i, ring // RINGS]
                    if low <= d + radius[i] and high >= d - radius[i]:
                        to += [(ring * most + b, d, d - radius[i], d + radius[i]) for b in range(n)]
                if to:
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                    block, d, low, high = zip(*to)
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(d), one.column("id"), one.column("v"), pa.array(low), pa.array(high), pa.array(np.full(len(to), bound[i]))], names=names)

    bounded = asked.join(least, "id", "left")
    found = scan_blocks(held, bounded.mapInArrow(annuli, fields), integer_products, k + 1, "bigint")
    return ranked(found, distinct, wanted, k)
