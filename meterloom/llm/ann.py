"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .vectors import BLOCK_ROWS, asked_vectors, kth_scores, matrix, one_of_each, ranked, scan_blocks, usable_vectors

#: Trees; vectors that the forest is fitted on at most; rows a leaf; rows of the sample a leaf at least.
TREES, SAMPLE, LEAF_ROWS, LEAF_SAMPLE = 8, 20_000, 512, 8
#: Leaves that a query opens first, for a bound on what the others must offer.
FIRST = 12
#: Vectors of the sample that are searched for in it, and the share of their nearest that the opened leaves must hold.
PROBES, RECALL = 256, 0.95


@dataclass
class Forest:
    """Trees of one depth. Node i of a tree has the children 2i and 2i + 1; the root is 1.

    A row goes to the right child if its projection on the node's direction is above the threshold. Rows get
    one more component so that all are of length ``reach``, the length of the longest: then nearness
    by inner product and by angle are the same.
    """

    depth: int
    reach: float
    directions: np.ndarray  # trees, nodes, components
    thresholds: np.ndarray  # trees, nodes

    def lifted(self, x: np.ndarray, rows: bool) -> np.ndarray:
        last = np.sqrt(np.maximum(self.reach**2 - (x * x).sum(1), 0)) if rows else np.zeros(len(x))
        return np.hstack([x, last[:, None]])

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each row (already lifted)."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.directions[tree, node]) > self.thresholds[tree, node])
        return node - (1 << self.depth)

    def nearest_leaves(self, x: np.ndarray, count: int) -> list[tuple[int, int]]:
        """``(tree, leaf)`` of the leaves that one query (lifted) meets first.

        One queue for all trees holds the nodes still to be opened. A node ranks by the farthest
        that the query is on the wrong side of any threshold above it, its own side's depth counting as gain.
        """
        margins = self.directions @ x - self.thresholds
        first_leaf = 1 << self.depth
        queue = [(-np.inf, tree, 1) for tree in range(len(margins))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < count:
            wrong, tree, node = heapq.heappop(queue)
            if node >= first_leaf:
                found.append((tree, node - first_leaf))
                continue
            margin = float(margins[tree, node])
            heapq.heappush(queue, (max(wrong, margin), tree, 2 * node))
            heapq.heappush(queue, (max(wrong, -margin), tree, 2 * node + 1))
        return found


def grow(sample: np.ndarray, reach: float, rows: int, trees: int, seed: int = 4) -> Forest:
    """A forest for ``rows`` rows from a sample of them: each node splits its part of the sample at the
    median of the projection on the line through two of its vectors (or any line, if they are alike)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    depth = int(min(np.ceil(np.log2(max(1, rows / LEAF_ROWS))), np.floor(np.log2(max(1, len(sample) / LEAF_SAMPLE)))))
    forest = Forest(depth, reach, np.zeros((trees, 1 << depth, sample.shape[1] + 1)), np.zeros((trees, 1 << depth)))
    lifted = forest.lifted(sample, rows=True)
    for tree in range(trees):
        parts = {1: np.arange(len(lifted))}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            line = rng.normal(size=lifted.shape[1])
            if len(part) > 1:
                a, b = rng.choice(part, 2, replace=False)
                if (lifted[a] != lifted[b]).any():
                    line = lifted[a] - lifted[b]
            line /= np.linalg.norm(line)
            projected = lifted[part] @ line
            middle = float(np.median(projected)) if len(part) else 0.0
            forest.directions[tree, node], forest.thresholds[tree, node] = line, middle
            parts[2 * node], parts[2 * node + 1] = part[projected <= middle], part[projected > middle]
    return forest


def leaves_to_open(forest: Forest, sample: np.ndarray, rows: int, k: int) -> int:
    """Of all trees' leaves, how many a query opens: the fewest that hold a share ``RECALL`` of the nearest of ``PROBES`` vectors.

    The nearest are found in the sample by scoring all of it: as many as the sample has of a query's ``k`` (one at
    least, so with a small sample they are farther than those of all rows, which asks for more leaves).
    """
    nearest_in_sample = min(len(sample) - 1, max(1, -(-k * len(sample) // rows)))
    if nearest_in_sample < 1:
        return len(forest.directions) << forest.depth
    first_leaf = 1 << forest.depth
    lifted = forest.lifted(sample, rows=True)
    leaf = np.stack([forest.leaves(lifted, t) + t * first_leaf for t in range(len(forest.directions))])
    found = []
    for i in np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        near = np.argpartition(-scores, nearest_in_sample - 1)[:nearest_in_sample]
        # each node's farthest margin on the wrong side above it, by which nearest_leaves opens
        margins = forest.directions @ np.append(sample[i], 0.0) - forest.thresholds
        wrong = np.full((len(margins), 1), -np.inf)
        for level in range(forest.depth):
            own = margins[:, 1 << level : 2 << level]
            wrong = np.maximum(np.repeat(wrong, 2, axis=1), np.stack([own, -own], axis=2).reshape(len(margins), -1))
        place = np.empty(wrong.size, np.int64)
        place[np.argsort(wrong.ravel(), kind="stable")] = np.arange(wrong.size)
        found.append(place[leaf[:, near]].min(0))
    found = np.sort(np.concatenate(found))
    return min(int(found[int(np.ceil(RECALL * len(found))) - 1]) + 1, wrong.size)


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Summed component by component, so that a pair scores the same in any block."""
    total = np.zeros((len(queries), len(rows)))
    for d in range(queries.shape[1]):
        total += queries[:, d, None] * rows[None, :, d]
    return total


def nearest(
    df: DataFrame, query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """Each query's ``k`` nearest found: ``query_id, rank, vec_id, score``, the score by inner product.

    ``query`` is a condition on the column ``id`` (the key) that chooses the queries; all other usable rows
    are candidates. Which rows are usable, see :func:`usable_vectors`; zero vectors are not. Fewer than
    ``k`` candidates: all. No usable rows or queries: no result rows. Other columns are not read.

    The forest is fitted on at most ``sample`` vectors (the first by a hash) and so bounded; every row is
    dealt to a leaf of every tree. A leaf's rows are cut into blocks of about ``BLOCK_ROWS`` by a hash, each
    query is sent to all blocks of the leaves it opens, and scored exactly against them. From its first ``FIRST``
    leaves it has a score that rows of the others must reach, so each query gets few rows from each. How many
    it opens follows from a recall of ``RECALL`` measured on the sample, whatever the number of rows.
    """
    spark, c = df.sparkSession, F.col
    scratch = Scratch(spark, "ann")
    rows = scratch.keep(usable_vectors(df, key, vector, zeros=False))
    distinct = scratch.keep(one_of_each(rows, k))
    squares = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    size = distinct.agg(F.count("*").alias("n"), F.max(squares).alias("m")).first()
    drawn = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    if not size["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fitted = matrix(drawn["v"])
    forest = grow(fitted, float(np.sqrt(size["m"])), size["n"], trees)
    leaves = 1 << forest.depth
    shared = spark.sparkContext.broadcast(forest)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.lifted(matrix(batch.column("v")), rows=True)
            for tree in range(trees):
                leaf = shared.value.leaves(x, tree) + tree * leaves
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("id"), batch.column("v")], names=["leaf", "id", "v"])

    kind = distinct.schema["v"].dataType.simpleString()
    placed = distinct.select("id", "v").mapInArrow(dealt, f"leaf bigint, id bigint, v {kind}")
    # one count a leaf, of which there are at most trees * sample / LEAF_SAMPLE
    blocks = {r["leaf"]: -(-r["n"] // BLOCK_ROWS) for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    most = max(blocks.values())
    many = spark.createDataFrame([(x, b) for x, b in blocks.items() if b > 1], "leaf bigint, blocks bigint")
    held = placed.join(F.broadcast(many), "leaf", "left").select(
        (c("leaf") * most + F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))).alias("block"), F.lit(0.0).alias("key"), "id", "v"
    )
    wanted = asked_vectors(rows, distinct, query)
    opened = max(FIRST, leaves_to_open(forest, fitted, size["n"], k))

    def sent(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = shared.value.lifted(matrix(batch.column("v")), rows=False)
                for i in range(len(x)):
                    to = [(t * leaves + leaf) * most + b for t, leaf in shared.value.nearest_leaves(x[i], count) for b in range(blocks.get(t * leaves + leaf, 0))]
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *one.columns], names=["block", "id", "v", "least"])

        return run

    def asked(queries: DataFrame, count: int) -> DataFrame:
        dealt_out = queries.select("id", "v", "least").mapInArrow(sent(count), f"block bigint, id bigint, v {kind}, least double")
        return scan_blocks(held, dealt_out.withColumns({x: F.lit(0.0) for x in ("key", "low", "high")}), inner_products, k + 1, "double")

    queries = scratch.keep(distinct.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "v"))
    first = kth_scores(asked(queries.withColumn("least", F.lit(float("-inf"))), FIRST), k + 1)
    bounded = queries.join(first, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return ranked(asked(bounded, opened), distinct, wanted, k)
