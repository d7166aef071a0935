"""What the two vector searches share: usable rows, rows of one vector, and blockwise scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in one block at most, about; query and row pairs scored at a time.
BLOCK_ROWS, PAIRS = 4096, 1 << 20


def usable_vectors(df: DataFrame, key: str, vector: str, zeros: bool) -> DataFrame:
    """``id, v``: one row a key, of the vectors that take part.

    Rows whose key or vector is null or whose vector is empty or holds a null or non-finite component are
    left out, with ``zeros=False`` also those of zeros only. A key that comes several times counts once, with its
    least vector. If vectors differ in length, only those of the most frequent length take part (of
    equally frequent ones the shortest).
    """
    c = F.col
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = finite if zeros else finite & F.exists("v", lambda x: x != 0)
    rows = df.select(c(key).cast("bigint").alias("id"), c(vector).alias("v"))
    rows = rows.where(c("id").isNotNull() & c("v").isNotNull() & (F.size("v") > 0)).where(good).groupBy("id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def one_of_each(rows: DataFrame, k: int) -> DataFrame:
    """``id, v, ids``: each different vector once, with its ``k + 1`` smallest ids, the first as ``id``.

    Equal vectors score alike and ties go to smaller ids, so no others can be among anyone's ``k`` best.
    The numbering is cut off before the exchange, so copies of one vector don't meet in one task.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids")


def matrix(column: pa.Array) -> np.ndarray:
    """List arrays of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    at = np.arange(len(ids))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def scan_blocks(rows: DataFrame, queries: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, kind: str) -> DataFrame:
    """``query, id, score``: in each block the ``k`` best rows for each query that is sent to it.

    ``rows`` has ``block, key, id, v``, ``queries`` ``block, key, id, v, low, high, least``: only rows whose ``key`` is
    between, with scores of ``least`` or more, count. A block's rows, which must be few, come first in its task and are held; its queries
    follow in the order of their keys and stream by, any number of them. ``score`` gives the
    matrix of queries by rows.
    """
    held = rows.select("block", F.lit(0).alias("side"), "key", "id", "v", *[F.lit(0.0).alias(x) for x in ("low", "high", "least")])
    asked = queries.select("block", F.lit(1).alias("side"), "key", "id", "v", "low", "high", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ready = None, [], None
        for batch in batches:
            names, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (side[1:] != side[:-1])) + 1
            for begin, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(names)).tolist()):
                if begin == end:
                    continue
                piece = batch.slice(begin, end - begin)
                if names[begin] != block:
                    block, parts, ready = names[begin], [], None
                if not side[begin]:
                    parts.append(piece.select(["key", "id", "v"]))
                    continue
                if not parts:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(parts)
                    ready = table["key"].to_numpy(), table["id"].to_numpy(), matrix(table["v"])
                yield from _answers(piece, *ready)

    def _answers(piece: pa.RecordBatch, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // len(ids))
        for at in range(0, piece.num_rows, step):
            some = piece.slice(at, step)
            first = np.searchsorted(keys, some.column("low").to_numpy(), "left")
            last = np.searchsorted(keys, some.column("high").to_numpy(), "right")
            a, b = int(first.min()), int(last.max())
            if a >= b:
                continue
            scores = score(matrix(some.column("v")), vectors[a:b])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q, x, y, least, own in zip(some.column("id").to_numpy(), first - a, last - a, some.column("least").to_numpy(), scores):
                good = np.flatnonzero(own[x:y] >= least) + x if x < y else []
                if len(good):
                    top = good[_best(ids[a + good], own[good], k)]
                    out.append((np.full(len(top), q), ids[a + top], own[top]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["query", "id", "score"])

    both = held.union(asked).repartition("block").sortWithinPartitions("block", "side", "key", "id")
    return both.mapInArrow(run, f"query bigint, id bigint, score {kind}")


def kth_scores(found: DataFrame, k: int) -> DataFrame:
    """``id, least``: the k-th best score that each query has so far, where it has so many."""
    c = F.col
    best = Window.partitionBy("query").orderBy(c("score").desc(), "id")
    placed = found.dropDuplicates(["query", "id"]).withColumn("place", F.row_number().over(best)).where(c("place") <= k)
    return placed.where(c("place") == k).select(c("query").alias("id"), c("score").cast("double").alias("least"))


def ranked(found: DataFrame, distinct: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows but itself.

    ``found`` names vectors by their first ids, on both sides; ``distinct`` has the other ids of each,
    ``queries`` (``query_id, id``) the queries of each vector.
    """
    c = F.col
    best = Window.partitionBy("query").orderBy(c("score").desc(), "id")
    short = found.dropDuplicates(["query", "id"]).withColumn("place", F.row_number().over(best)).where(c("place") <= k + 1)
    each = short.join(distinct.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    mine = each.join(queries.select("query_id", c("id").alias("query")), "query").where(c("query_id") != c("vec_id"))
    order = Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")


def asked_vectors(rows: DataFrame, distinct: DataFrame, query: Column) -> DataFrame:
    """``query_id, id``: each row that ``query`` (over ``id``) chooses, with its vector's first id."""
    asked = rows.where(query).select(F.col("id").alias("query_id"), "v")
    return asked.join(distinct.select("v", "id"), "v").select("query_id", "id")
