"""The prefix trie of conversations: one node per distinct sequence of first turns, with subtree totals.

Nodes come from grouping: each conversation's prefixes are named by two running sums of 64-bit hashes of
(position, role, text), so equal prefixes meet in one group without any conversation's turns being copied
per depth. Subtree totals come by time-forward processing: nodes are sorted deepest level first within
shards (Spark's external sort), and each node passes its subtree total to its parent through a priority
queue keyed by the parent's place in that order; a shard's top nodes pass theirs across to the shards
of the band above, so a deep tree costs a fixed number of bands, not a round a level.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Tops of the bands of depths that are processed in turn, deepest first; depth 0, the root, comes last.
CUTS = (64, 16, 4, 1)


def rebuilt_turns(convs: DataFrame, spread: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """``conv, pos, role, text, length`` and ``conv, length``: every conversation rebuilt on the head of its family's first one.

    Turns are ordered by ``turn`` (null first), then role and text (null last); null role or text is empty.
    Conversation ``c`` takes the first ``h = crc32(decimal c) % heads`` turns of conversation ``c - c % spread``
    (all if fewer, none if absent), then its own turns after its first ``h``. ``length`` is the rebuilt
    number of turns. Rows of a null ``conv`` take no part.
    """
    c = F.col
    rows = convs.select(c("conv_id").cast("bigint").alias("conv"), "turn", F.coalesce(c("role").cast("string"), F.lit("")).alias("role"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"), c("role").isNull().alias("rn"), c("text").isNull().alias("tn"))
    rows = rows.where(c("conv").isNotNull())
    order = Window.partitionBy("conv").orderBy(c("turn").asc_nulls_first(), "rn", "role", "tn", "text")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("bigint")).select("conv", "pos", "role", "text")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("own"))
    each = sizes.select("conv", "own", (F.crc32(c("conv").cast("string")) % heads).alias("h"), (c("conv") - c("conv") % spread).alias("base"))
    base_sizes = sizes.select(c("conv").alias("base"), c("own").alias("base_own"))
    each = each.join(base_sizes, "base", "left").withColumn("head", F.least(c("h"), F.coalesce(c("base_own"), F.lit(0))))
    each = each.withColumn("length", c("head") + F.greatest(c("own") - c("h"), F.lit(0)))
    mine = rows.join(each.select("conv", "h", "head", "length"), "conv").where(c("pos") > c("h"))
    mine = mine.select("conv", (c("pos") - c("h") + c("head")).alias("pos"), "role", "text", "length")
    asked = each.where(c("head") > 0).select("conv", "base", "head", "length")
    taken = rows.select(c("conv").alias("base"), "pos", "role", "text").join(asked, "base").where(c("pos") <= c("head"))
    turns = mine.unionByName(taken.select("conv", "pos", "role", "text", "length"))
    return turns, each.select("conv", "length")


def _stream_digests(members: DataFrame) -> DataFrame:
    """``depth, node, ends_sha256`` of the ``depth, node, conv`` rows: SHA-256 of the comma-joined ascending convs.

    Rows are dealt by node and sorted within tasks; a task hashes each node's ids as they stream by, so a
    node with very many ids holds no list of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, first = None, None, True
        out_d: list[int] = []
        out_n: list[int] = []
        out_h: list[str] = []
        for batch in batches:
            for d, n, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (d, n) != key:
                    if key is not None:
                        out_d.append(key[0]), out_n.append(key[1]), out_h.append(digest.hexdigest())
                    key, digest, first = (d, n), hashlib.sha256(), True
                digest.update((b"" if first else b",") + str(conv).encode())
                first = False
            if len(out_d) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_h)], names=["depth", "node", "ends_sha256"])
                out_d, out_n, out_h = [], [], []
        if key is not None:
            out_d.append(key[0]), out_n.append(key[1]), out_h.append(digest.hexdigest())
        if out_d:
            yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_h)], names=["depth", "node", "ends_sha256"])

    dealt = members.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv")
    return dealt.mapInArrow(run, "depth bigint, node bigint, ends_sha256 string")


def _forward(nodes: DataFrame, top: int) -> DataFrame:
    """Subtree totals of a band's nodes by time-forward processing within each shard.

    ``nodes`` has ``shard, depth, node, parent, leaves, saved`` (own values plus what the band below sent),
    each shard a subtree whose top is at depth ``top``. Sorted deepest first, a node takes from the queue the
    totals its children pushed, keyed by its own place, and pushes its total keyed by its parent's place.
    Rows out: ``depth, node, parent, leaves, saved`` with subtree totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple[int, int, int, int]] = []
        shard = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            out = [[], [], [], [], []]
            for s, d, n, p, leaves, saved in zip(*cols):
                if s != shard:
                    shard, queue = s, []
                while queue and (queue[0][0], queue[0][1]) == (-d, n):
                    _, _, more_leaves, more_saved = heapq.heappop(queue)
                    leaves, saved = leaves + more_leaves, saved + more_saved
                if d > top:
                    heapq.heappush(queue, (-(d - 1), p, leaves, saved))
                for column, value in zip(out, (d, n, p, leaves, saved)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["depth", "node", "parent", "leaves", "saved"])

    dealt = nodes.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "node")
    return dealt.select("shard", "depth", "node", "parent", "leaves", "saved").mapInArrow(run, "depth bigint, node bigint, parent bigint, leaves bigint, saved bigint")


def prefix_trie(convs: DataFrame, scratch: Scratch, spread: int = 100, heads: int = 6) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node.

    Conversations are rebuilt as ``rebuilt_turns`` says. A node is a distinct sequence of first ``depth``
    turns (role, text), the root the empty one; its members are the rebuilt conversations that start with it,
    turnless ones too; ``conv_id`` is its smallest member, ``parent_conv_id`` its parent's (root: null).
    ``n_leaves`` counts the childless nodes of its subtree, itself included; ``saved_tokens`` sums, over the
    subtree, ``(n_convs - 1)`` times the code points of each node's last text (root: none). ``ends_sha256`` is
    the SHA-256 of the comma-joined ascending ids of members with exactly ``depth`` turns (none: of the empty
    string). Prefixes are named by two 64-bit hash sums, so two different ones meet with a chance of about
    2^-128. An empty table gives no node.
    """
    c = F.col
    turns, lengths = rebuilt_turns(convs, spread, heads)
    turns = scratch.keep(turns)
    lengths = scratch.keep(lengths)
    running = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.xxhash64(c("pos"), c("role"), c("text")).cast("decimal(38,0)")
    two = F.xxhash64(F.lit("trie"), c("pos"), c("role"), c("text")).cast("decimal(38,0)")
    named = turns.select("conv", c("pos").alias("depth"), "length", F.char_length("text").cast("bigint").alias("chars"), F.sum(one).over(running).alias("f1"), F.sum(two).over(running).alias("f2"))
    named = scratch.keep(named)
    groups = named.groupBy("depth", "f1", "f2").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.first("chars").alias("last_chars"))
    placed = named.join(groups, ["depth", "f1", "f2"]).select("conv", "depth", "length", "node", "n_convs", c("last_chars").alias("chars"))
    root = lengths.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")).collect()[0]
    if root["node"] is None:
        return convs.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    above = F.lag("node").over(Window.partitionBy("conv").orderBy("depth"))
    placed = scratch.keep(placed.withColumn("parent", F.coalesce(above, F.lit(root["node"]))))
    nodes = placed.where(c("conv") == c("node")).select("depth", "node", "parent", "n_convs", ((c("n_convs") - 1) * c("chars")).alias("own"))
    children = nodes.groupBy((c("depth") - 1).alias("depth"), c("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # Subtree totals, band by band from the deepest; each band's tops send theirs to their parents in the next.
    sent = None
    totals = []
    bands = [(a, b) for a, b in zip(CUTS, (None, *CUTS[:-1]))]
    for top, below in bands:
        band = nodes.where((c("depth") >= top) & ((c("depth") < below) if below else F.lit(True)))
        # a node's shard is its ancestor at the band's top: that of its smallest member
        ancestors = placed.where(c("depth") == top).select(c("conv").alias("node"), c("node").alias("shard"))
        band = band.join(ancestors, "node")
        band = band.select("shard", "depth", "node", "parent", F.when(c("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), c("own").cast("bigint").alias("saved"))
        if sent is not None:
            band = band.join(sent.select("depth", "node", c("leaves").alias("l2"), c("saved").alias("s2")), ["depth", "node"], "left")
            band = band.select("shard", "depth", "node", "parent", (c("leaves") + F.coalesce("l2", F.lit(0))).alias("leaves"), (c("saved") + F.coalesce("s2", F.lit(0))).alias("saved"))
        done = scratch.keep(_forward(band, top))
        totals.append(done)
        sent = done.where(c("depth") == top).groupBy((c("depth") - 1).alias("depth"), c("parent").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sent = scratch.keep(sent)
    from_below = sent.collect()
    root_children = nodes.where(c("depth") == 1).count()
    root_leaves = sum(r["leaves"] for r in from_below) if from_below else 1
    root_saved = sum(r["saved"] for r in from_below) if from_below else 0
    spark = convs.sparkSession
    members = placed.where(c("depth") == c("length")).select("depth", "node", "conv").unionByName(
        lengths.where(c("length") == 0).select(F.lit(0).cast("bigint").alias("depth"), F.lit(root["node"]).cast("bigint").alias("node"), "conv")
    )
    ends = _stream_digests(members)
    root_row = spark.createDataFrame(
        [(root["node"], 0, None, root["n_convs"], root_children, root_leaves, root_saved)],
        "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint",
    )
    subtree = totals[0]
    for more in totals[1:]:
        subtree = subtree.unionByName(more)
    inner = nodes.join(subtree.select("depth", "node", "leaves", "saved"), ["depth", "node"]).select(
        c("node").alias("conv_id"), "depth", c("parent").alias("parent_conv_id"), c("n_convs").cast("bigint"), c("n_children").cast("bigint"), c("leaves").alias("n_leaves"), c("saved").alias("saved_tokens")
    )
    empty = hashlib.sha256(b"").hexdigest()
    out = inner.unionByName(root_row).join(ends.select(c("node").alias("conv_id"), "depth", "ends_sha256"), ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
