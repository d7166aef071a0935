"""From raw documents to the ids of a mixed corpus, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.bpe import encode_documents
from meterloom.llm.line_dedup import deduplicate_lines
from meterloom.llm.minhash import near_duplicates
from meterloom.llm.mixing import mix_sources, source_counts, tempered_weights
from meterloom.llm.queries import TEMPER, TOKENIZER
from meterloom.llm.toxicity import train_toxicity, with_toxicity
from meterloom.scratch import Scratch

#: The classifier and the tokenizer are not expressible in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic (a score of 0.5 or more) go."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_toxicity(docs, model, score="__score").where(F.col("__score") < 0.5).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of three lines go; documents of which nothing is left go with them."""
    left = deduplicate_lines(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Five-word shingles, similarity 0.8. Of rows that repeat a doc_id and a text one stays; rows that share a
    doc_id alone stay if one of them does.
    """
    kept = near_duplicates(docs, shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return left.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of a mixture of sources weighted by the 0.9th power of their size.

    Every document is in it; those of smaller sources come again until the largest source's share is met.
    The files hold the mixture's blocks in order.
    """
    counts = source_counts(docs)
    mixed = mix_sources(docs, tempered_weights(counts, TEMPER), counts)
    return mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_place").select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text that they decode to."""
    found = encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is a table in the shared folder, read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES):
            docs = scratch.keep(docs)
    return docs
