"""Token ids in binary segments of directly addressable codes, and reading any of them back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text_hash import small_slices

_MAGIC = b"DAC1"
#: Bits that one entry of a rank directory stands for.
_RANKED = 512
#: A segment ends with the first document that fills it to so many ids.
SEGMENT = 1 << 20
#: Bytes of text given to an encoder at a time; what libraries keep of a token is many times its text.
ENCODED = 1 << 18


def encode_codes(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids.

    Level k holds the k-th byte of every id that has one, a bitmap of which of them go on at the
    next level, and the count of set bits before each 512 bits of the bitmap. Layout, little-endian:
    magic, u32 levels, u64 ids; per level u64 entries, the bytes, the bitmap (64-bit words), the directory (64-bit).
    """
    ids = np.ascontiguousarray(ids, np.uint32)
    out, levels, rest = [], 0, ids
    while len(rest) or not levels:
        more = rest > 255
        words = -(-len(rest) // 64)
        bits = np.zeros(words * 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        ones = np.append(0, np.cumsum(np.bitwise_count(bits.view(np.uint64)), dtype=np.uint64))
        directory = ones[:-1:8] if words else ones[:0]
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), directory.astype("<u8").tobytes()]
        rest = rest[more] >> 8
        levels += 1
    return b"".join([_MAGIC, struct.pack("<IQ", levels, len(ids)), *out])


class Codes:
    """Read access to codes made by :func:`encode_codes`; nothing is decoded but what is asked for."""

    def __init__(self, data: bytes | memoryview | pa.Buffer):
        view = memoryview(data)
        if view[:4] != _MAGIC:
            raise ValueError("not directly addressable codes")
        levels, self.size = struct.unpack_from("<IQ", view, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", view, at)
            words = -(-n // 64)
            at += 8
            chunks = np.frombuffer(view, np.uint8, n, at)
            bits = np.frombuffer(view, "<u8", words, at + n)
            ranks = np.frombuffer(view, "<u8", -(-words // 8), at + n + 8 * words)
            at += n + 8 * words + 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at // 64
        found = ranks[at // _RANKED].astype(np.int64)
        first = at // _RANKED * 8
        for k in range(_RANKED // 64 - 1):
            inside = first + k < word
            found[inside] += np.bitwise_count(bits[(first + k)[inside]])
        below = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        return found + np.bitwise_count(bits[word] & below)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each found level by level through the rank directories."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.size):
            raise IndexError("place outside the codes")
        ids = np.zeros(len(places), np.uint32)
        which, at = np.arange(len(places)), places
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(which):
                break
            ids[which] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            on = (bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            which, at = which[on], self._rank(bits, ranks, at[on])
        return ids

    def between(self, begin: int, end: int) -> np.ndarray:
        """The ids of a stretch of places."""
        ids, which = np.zeros(end - begin, np.uint32), np.arange(end - begin)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if begin >= end:
                break
            ids[which] |= chunks[begin:end].astype(np.uint32) << np.uint32(8 * level)
            on = np.unpackbits(bits[begin // 64 : -(-end // 64)].view(np.uint8), bitorder="little")[begin % 64 :][: end - begin].astype(bool)
            which = which[on]
            begin = int(self._rank(bits, ranks, np.array([begin]))[0])
            end = begin + len(which)
        return ids


def write_token_segments(
    docs: DataFrame, folder: str, encode: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int | None = None, segment: int = SEGMENT
) -> None:
    """Writes the ids of every text of ``docs`` (``doc_id, text``) under ``folder``, in order of doc_id.

    ``encode`` is called once a task and gives the function from texts to ids. Documents are dealt out
    by ranges of doc_id (rows of one doc_id by their text's hash, so that they too are split), sorted and
    encoded one slice of bounded bytes at a time; ``end_id`` ends each. A segment is one row of a Parquet
    table, which Spark commits as a whole on any store: ``part, seq`` (their order is that of the
    documents), ``doc_ids``, ``ends`` (place after each document's last id), ``n_tokens`` and ``codes``,
    stored uncompressed. Null doc_ids come first, equal ones in order of their texts. Null texts are empty.
    An empty table gives a table without rows. Other columns are not read.
    """
    c = F.col
    rows = docs.select(c("doc_id").cast("bigint").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, part, seq = encode(), TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], np.uint32)
        keys: list[int | None] = []
        ends: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def full() -> pa.RecordBatch:
            codes = encode_codes(np.concatenate(parts) if parts else end[:0])
            arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([codes], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "doc_ids", "ends", "n_tokens", "codes"])

        for batch in batches:
            for piece in small_slices(batch, "text", ENCODED):
                for key, ids in zip(piece.column("doc_id").to_pylist(), to_ids(piece.column("text").to_pylist())):
                    parts += [ids, end]
                    size += len(ids) + len(end)
                    keys.append(key)
                    ends.append(size)
                    if size >= segment:
                        yield full()
                        keys, ends, parts, size = [], [], [], 0
                        seq += 1
        if keys:
            yield full()

    made = ordered.select("doc_id", "text").mapInArrow(run, "part int, seq int, doc_ids array<bigint>, ends array<bigint>, n_tokens bigint, codes binary")
    made.write.option("compression", "uncompressed").parquet(folder)


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``part, seq, first``: how many ids the segments before each one hold."""
    c = F.col
    sizes = spark.read.parquet(folder).select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a written partition; the segments within are summed partition by partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - c("n")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - c("n_tokens")
    return sizes.withColumn("inner", inner).join(before, "part").select("part", "seq", (c("before") + c("inner")).alias("first"))


def read_token_documents(spark: SparkSession, folder: str, checksum: bool = False) -> DataFrame:
    """Per document ``doc_id, start, n_tokens`` and its ``ids``, or with ``checksum`` their ``ids_crc32``."""
    last = "ids_crc32 bigint" if checksum else "ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = Codes(batch.column("codes")[row].as_buffer())
                ends = np.asarray(batch.column("ends")[row].values, np.int64)
                begins = np.append(0, ends[:-1])
                # the whole segment in one pass over its levels, then cut at the documents' ends
                ids = codes.between(0, codes.size)
                if checksum:
                    whole = memoryview(ids.astype("<u4").tobytes())
                    values = pa.array([zlib.crc32(whole[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())], pa.int64())
                else:
                    values = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()).cast(pa.int32()), pa.array(ids.astype(np.int64)))
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("part")[row].as_py(), np.int32)), pa.array(np.full(n, batch.column("seq")[row].as_py(), np.int32)), batch.column("doc_ids")[row].values, pa.array(begins), pa.array(ends - begins), values],
                    names=["part", "seq", "doc_id", "inner", "n_tokens", last.split(" ")[0]],
                )

    found = spark.read.parquet(folder).select("part", "seq", "doc_ids", "ends", "codes").mapInArrow(run, f"part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, {last}")
    starts = segment_starts(spark, folder)
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", last.split(" ")[0])


def tokens_at(spark: SparkSession, folder: str, places: DataFrame, span: int = SEGMENT) -> DataFrame:
    """``place, id`` for each different ``place`` (bigint, over all ids) that the segments hold.

    Each place meets its segment by a join on stretches of ``span`` places; a segment's codes are read in
    place for the places that fall in it, at most as many as it has ids.
    """
    c = F.col
    starts = segment_starts(spark, folder).join(spark.read.parquet(folder).select("part", "seq", "n_tokens"), ["part", "seq"])
    reach = starts.where(c("n_tokens") > 0).select("part", "seq", "first", "n_tokens", F.explode(F.sequence(F.floor(c("first") / span), F.floor((c("first") + c("n_tokens") - 1) / span))).alias("stretch"))
    wanted = places.select(c("place").cast("bigint").alias("place")).where("place is not null").distinct()
    inside = (c("place") >= c("first")) & (c("place") < c("first") + c("n_tokens"))
    met = wanted.withColumn("stretch", F.floor(c("place") / span)).join(reach, "stretch").where(inside).select("part", "seq", "place", (c("place") - c("first")).alias("inner"))

    def look(segment, inner):
        ids = Codes(segment["codes"].iloc[0]).at(inner["inner"].to_numpy()) if len(inner) else np.empty(0, np.uint32)
        return inner[["place"]].assign(id=ids.astype(np.int64))

    stored = spark.read.parquet(folder).select("part", "seq", "codes")
    return stored.groupBy("part", "seq").cogroup(met.groupBy("part", "seq")).applyInPandas(look, "place bigint, id bigint")
