"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import connected_components
from .text_hash import distinct_in_texts, mixed, shingle_hashes, small_slices, word_hashes

#: Bands and values a band. A pair of similarity 0.8 shares no band with a chance of 1.3e-7.
BANDS, ROWS = 40, 5
#: Slots in which shingles are counted, and bits (a prime) of the map of documents whose sets are wanted.
SLOTS, MARKS = 1 << 18, 16_777_213
#: Shingles hashed at a time under all permutations.
_BLOCK = 1 << 15


def signatures(hashes: np.ndarray, bounds: np.ndarray, permutations: int, seed: int = 6) -> np.ndarray:
    """Per set, the minimum under each permutation and then the maximum under each.

    Min-max hashing: both ends of one permuted set match with the sets' similarity as their chance,
    so half the permutations give a signature as long, of no bias and of lower variance.
    Sets without elements get the ends of the range.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    factor = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    low = np.full((len(bounds) - 1, permutations), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros_like(low)
    some = np.flatnonzero(np.diff(bounds))
    starts = bounds[some]
    with np.errstate(over="ignore"):
        for begin in range(0, len(hashes), _BLOCK):
            end = min(begin + _BLOCK, len(hashes))
            i, j = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end)
            cuts = np.maximum(starts[i:j] - begin, 0)
            sets, part = some[i:j], hashes[begin:end]
            for p in range(permutations):
                v = part * factor[p] + shift[p]
                low[sets, p] = np.minimum(low[sets, p], np.minimum.reduceat(v, cuts))
                high[sets, p] = np.maximum(high[sets, p], np.maximum.reduceat(v, cuts))
    return np.hstack([low, high])


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; a band's values come from different permutations."""
    keys = np.empty((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            total = np.full(len(signature), band + 1, np.uint64)
            for r in range(rows):
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + signature[:, band + r * bands])
            keys[:, band] = total
    return keys.view(np.int64)


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per row ``doc_id, n_shingles``, the set's fingerprint ``f1, f2`` and its ``bands``."""
    permutations = (bands * rows + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "text"):
                sets, bounds = distinct_in_texts(*shingle_hashes(*word_hashes(part.column("text")), shingle))
                out = [part.column("doc_id"), pa.array(np.diff(bounds))]
                for constant in (1, 2):
                    with np.errstate(over="ignore"):
                        sums = np.append(np.uint64(0), np.cumsum(mixed(sets ^ mixed(np.full(1, constant, np.uint64)))))
                        out.append(pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)))
                keys = band_keys(signatures(sets, bounds, permutations), bands, rows)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return _text(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, elements`` (sorted 64-bit hashes) of the wanted documents (``doc_id, n_shingles``).

    A bitmap of fixed size (``MARKS`` bits, by remainder of doc_id) goes to every task, so that of most other
    documents no set is made or moved; a join leaves out the rest.
    """
    slot = F.pmod("doc_id", F.lit(MARKS))
    words = wanted.select((slot / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(32)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 32 + 1, np.uint32)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("doc_id").to_numpy(zero_copy_only=False) % MARKS
            marked = shared.value[at // 32] >> (at % 32).astype(np.uint32) & 1
            for part in small_slices(batch.filter(pa.array(marked.astype(bool))), "text"):
                sets, bounds = distinct_in_texts(*shingle_hashes(*word_hashes(part.column("text")), shingle))
                offsets = pa.py_buffer((bounds * 8).astype(np.int32).tobytes())
                elements = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), elements], names=["doc_id", "n_shingles", "elements"])

    made = _text(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id bigint, n_shingles bigint, elements binary")
    return made.join(wanted, ["doc_id", "n_shingles"], "left_semi").dropDuplicates(["doc_id"])


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``element, place, doc_id, n_shingles, part`` for the rarest shingles of each set, in their order from 0.

    Two sets that are similar enough share one of their n - ceil(percent * n / 100) + 1 first elements in any
    order that is the same for all. Ordered by how often shingles occur (counted in ``SLOTS`` slots by
    hash), these are the ones that set a document apart, so passages that very many share bring nobody together.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("elements"):
                slots, n = np.unique(np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(SLOTS), return_counts=True)
                total[slots.astype(np.int64)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    slots = sets.select("elements").mapInArrow(counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare, rows, places = [], [], []
            for i, x in enumerate(batch.column("elements")):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                first = np.lexsort((x, shared.value[(x % np.uint64(SLOTS)).astype(np.int64)]))
                rare.append(x[first[: len(x) + (-percent * len(x)) // 100 + 1]])
                rows.append(np.full(len(rare[-1]), i))
                places.append(np.arange(len(rare[-1])))
            if rows:
                out = batch.select(["doc_id", "n_shingles", "part"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare).view(np.int64)), pa.array(np.concatenate(places)), *out.columns], names=["element", "place", "doc_id", "n_shingles", "part"])

    return sets.select("doc_id", "n_shingles", "part", "elements").mapInArrow(run, "element bigint, place bigint, doc_id bigint, n_shingles bigint, part bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough."""
    c = F.col
    ends = lambda x: sets.select(c("doc_id").alias(x), c("n_shingles").alias(f"n_{x}"), c("elements").alias(f"set_{x}"))
    both = (
        pairs.select("a", "b").join(ends("a"), "a").join(ends("b"), "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b", "set_a", "set_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where the intersection of their sets of ``shingle``-word shingles is at least
    ``percent`` of the union; a component is all that links connect, named by its smallest doc_id.

    Equal sets are one class with one representative, found by a pre-aggregated fingerprint, so a group
    of copies is one row of all that follows. Representatives that share a band meet as follows, each
    step over all of them and on the pairs not yet connected only: (1) each with the leader that it
    shares most bands with; (2) each with all its bands' leaders; (3) of documents in bands that still hold several
    components, every pair of different components that can be similar, by the exact rule that such sets
    share one of their rarest shingles. A group of near copies is connected by (1) and (2) in a number of
    pairs in proportion to its size, and (3) leaves out nothing.

    Texts that are null, empty or of blanks only have no shingles and are linked with nothing. Rows
    without doc_id take no part: no component, kept. Rows that repeat a doc_id are judged each by its own text.
    Other columns are not read. An empty table gives no rows.
    """
    spark, c = docs.sparkSession, F.col
    scratch = Scratch(spark, "minhash")
    rows_ = scratch.keep(sketches(docs, shingle, bands, rows))
    reps = scratch.keep(
        rows_.where(c("doc_id").isNotNull() & (c("n_shingles") > 0))
        .groupBy("n_shingles", "f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    # the leader is drawn by hash, so that a document meets different ones in its bands
    drawn = F.struct(F.xxhash64("rep", "bucket").alias("h"), c("rep").alias("leader"))
    led = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(drawn).alias("first")).where(c("n") > 1)
    shared = scratch.keep(banded.join(led.select("bucket", c("first.leader").alias("leader")), "bucket"))
    stars = scratch.keep(
        shared.where(c("rep") != c("leader")).groupBy("rep", "leader").agg(F.count("*").alias("n"))
    )
    wanted = stars.select(c("rep").alias("doc_id")).union(stars.select("leader")).distinct()
    wanted = scratch.keep(wanted.join(reps.select(c("rep").alias("doc_id"), "n_shingles"), "doc_id"))
    sets = scratch.keep(_sets_of(docs, wanted, shingle))

    best = Window.partitionBy("rep").orderBy(c("n").desc(), c("leader"))
    closest = stars.withColumn("place", F.row_number().over(best)).where("place = 1").select(c("rep").alias("a"), c("leader").alias("b"))
    links = scratch.keep(_confirmed(closest, sets, percent))
    found = scratch.keep(connected_components(links))

    def part_of(df: DataFrame, node: str, name: str) -> DataFrame:
        own_part = found.select(c("node").alias(node), c("component").alias("_part"))
        return df.join(own_part, node, "left").withColumn(name, F.coalesce("_part", node)).drop("_part")

    open_stars = part_of(part_of(stars.select(c("rep").alias("a"), c("leader").alias("b")), "a", "pa"), "b", "pb")
    more = scratch.keep(_confirmed(open_stars.where(c("pa") != c("pb")), sets, percent))
    links = links.union(more)
    found = scratch.keep(connected_components(links))

    parts = scratch.keep(part_of(shared.select("bucket", "rep"), "rep", "part"))
    mixed_buckets = parts.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where(c("lo") != c("hi")).select("bucket")
    open_docs = parts.join(mixed_buckets, "bucket", "left_semi").select(c("rep").alias("doc_id"), "part").distinct()
    rare = scratch.keep(_rare_shingles(scratch.keep(sets.join(open_docs, "doc_id")), percent))
    several = rare.groupBy("element").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where(c("lo") != c("hi")).select("element")
    sides = [
        df.select("element", c("doc_id").alias(x), c("n_shingles").alias(f"n_{x}"), (c("n_shingles") - c("place")).alias(f"rest_{x}"), c("part").alias(f"p{x}"))
        for df, x in ((rare.join(several, "element", "left_semi"), "a"), (rare, "b"))
    ]
    # before the first shared element neither set has one of the other's, so no more than the rest can be shared
    least = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (c("n_a") + c("n_b"))
    met = stars.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))
    rest = (
        sides[0].join(sides[1], "element").where((c("a") < c("b")) & (c("pa") != c("pb")) & least)
        .select("a", "b").distinct().join(met, ["a", "b"], "left_anti")
    )
    last = scratch.keep(_confirmed(rest, sets, percent))
    found = scratch.keep(connected_components(links.union(last)))
    scratch.drop_all(rows_, reps, found)
    classes = part_of(reps.select("n_shingles", "f1", "f2", "rep"), "rep", "component_id").drop("rep")
    joined = rows_.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"], "left")
    component = F.when(c("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == c("doc_id"), F.lit(True)).alias("kept"))
