"""Removal of passages of lines that occurred before, anywhere in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicate_lines(docs: DataFrame, window: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what is left as ``text``, and ``n_lines`` (before) and ``n_removed``.

    Lines end at ``\\n``. Every overlapping window of ``window`` consecutive lines is hashed (two 64-bit
    hashes of different beginnings). Of the windows of one hash the first in the order of ``key`` (null
    last), then place, stays; the lines that any later one covers go. So each different line
    stays in at least one place. Texts of fewer lines have no window and stay as they are. Null texts stay
    null, with no lines. Rows that repeat both key and text are one document and all come out alike; rows
    that repeat the key alone count in the order of their texts' hash. Other columns pass through; some that are
    called n_lines or n_removed already, or begin with two underscores, are an error. An empty table gives no rows.

    Window rows are narrow and hold no text. They meet by hash: firsts by a pre-aggregated minimum, later
    ones by a join, which adaptive execution splits where one passage is in very many documents.
    Only the places of lines that go are joined back to the documents.
    """
    if clash := [x for x in docs.columns if x in ("n_lines", "n_removed") or x.startswith("__")]:
        raise ValueError(f"columns {clash} are there already")
    c = F.col
    rows = docs.withColumn("__t", c(text).cast("string")).withColumn("__h", F.xxhash64("__t"))
    narrow = rows.select(c(key).alias("k"), c("__t").alias("t"), c("__h").alias("h"))
    lines = F.split("t", "\n", -1)
    shifted = [F.slice(lines, i + 1, F.size(lines)).alias(f"l{i}") for i in range(window)]
    each = narrow.where(c("t").contains("\n")).select("k", "h", F.posexplode(F.arrays_zip(*shifted)).alias("place", "w"))
    parts = [c(f"w.l{i}") for i in range(window)]
    windows = each.where(parts[-1].isNotNull()).select(
        "k", "h", "place", F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(window), *parts).alias("b")
    )
    here = F.struct(c("k").isNull().alias("null_key"), "k", "h", "place")
    firsts = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1").drop("n")
    later = windows.join(firsts, ["a", "b"]).where(here > c("first")).select("k", "h", "place")
    covered = (
        later.groupBy("k", "h").agg(F.collect_set("place").alias("places"))
        .select(c("k").alias("__k2"), c("h").alias("__h2"), F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (window - 1))))).alias("__gone"))
    )
    joined = rows.join(covered, c(key).eqNullSafe(c("__k2")) & (c("__h") == c("__h2")), "left").withColumn("__lines", F.split("__t", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    left = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    size = lambda x: F.when(c(x).isNull(), 0).otherwise(F.size(x)).cast("bigint")
    out = joined.select(
        *[c(x) for x in docs.columns if x != text],
        F.when(c("__gone").isNull(), c("__t")).otherwise(left).alias(text), size("__lines").alias("n_lines"), size("__gone").alias("n_removed"),
    )
    return out.select(*docs.columns, "n_lines", "n_removed")
