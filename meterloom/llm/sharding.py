"""Placement of keys on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table (a prime); about a hundred a shard keep the shards' shares within one percent.
SLOTS = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard.

    Each shard prefers the slots in the order of its own permutation (offset, offset + skip, ... modulo the
    prime). The shards take turns, and each claims the first slot in its order that is free. So
    shares differ by one slot at most, and a shard that comes or goes moves few of the others' slots.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("needs different shards, no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(f"offset {s}") % slots for s in shards]
    skip = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    left = slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def assign_shards(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``.

    The slot is a hash of the key's text (null as the empty text), so equal keys share a shard. The table
    has ``slots`` rows whatever the data are, and is broadcast; nothing else moves. Columns that are called
    slot or shard already are an error, other columns pass through. An empty table gives no rows.
    """
    if clash := {"slot", "shard"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    table = docs.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot bigint, shard string")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots))
    return docs.withColumn("slot", slot).join(F.broadcast(table), "slot").select(*docs.columns, "slot", "shard")


def write_shards(docs: DataFrame, folder: str, shards: Sequence[str], rows_a_file: int = 1_000_000, key: str = "doc_id", slots: int = SLOTS) -> None:
    """Writes ``docs`` as Parquet with a folder for each shard and about ``rows_a_file`` rows a file.

    A shard's rows are dealt to several files by slot, and those of one slot (a key that very many rows
    share) by a hash of the row, so no task writes a whole shard.
    """
    placed = assign_shards(docs, shards, key, slots)
    files = max(1, -(-docs.count() // (rows_a_file * len(shards))))
    piece = F.pmod(F.xxhash64("slot", *[F.to_json(F.struct(x)) for x in docs.columns]), F.lit(files))
    dealt = placed.withColumn("_piece", piece).repartition(files * len(shards), "shard", "_piece").drop("_piece")
    dealt.write.partitionBy("shard").parquet(folder)
