"""One query for each operator, over the whole of its table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, scratch_folder
from .ann import nearest
from .chat_format import conversation_tree, format_conversations, read_back
from .bpe import encoding_digests, library_encoder
from .dac import read_token_documents, write_token_segments
from .exact_topk import exact_topk
from .line_dedup import deduplicate_lines
from .minhash import near_duplicates
from .prefix_trie import prefix_trie
from .mixing import mix_sources, source_counts, tempered_weights
from .sharding import assign_shards
from .toxicity import train_toxicity, with_toxicity
from .url_filter import judge_urls
from .whitening import whiten

#: The tokenizer file of the token queries; its place is a parameter of their operators.
TOKENIZER = "word_bpe_49k.json"
#: The id that ends a document.
END_ID = 2
#: Power of a source's size in its weight.
TEMPER = 0.9
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: host, path, verdict
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document exactly and decodes the ids again."""
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document comes in a mixture in which large sources weigh less than their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    counts = source_counts(docs)
    return mix_sources(docs, tempered_weights(counts, TEMPER), counts)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as directly addressable codes and reads them back."""
    folder = scratch_folder(spark, "tokens")
    write_token_segments(table(spark, sf_dir, "documents"), folder, library_encoder(public_tokenizers.path(TOKENIZER)), END_ID)
    return read_token_documents(spark, folder, checksum=True)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that passages of three lines repeat."""
    return deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over two-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products for every hundredth vector."""
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model of labelled documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return with_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The text of both turns of the conversation added to the formatting query: control strings of the template.
TRICKY = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back from the written rows."""
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    written = format_conversations(conversation_tree(convs.unionByName(extra)), Scratch(spark, "chat"))
    return read_back(written).select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the head of the first of its hundred."""
    return prefix_trie(table(spark, sf_dir, "conversations"), Scratch(spark, "trie"), spread=100, heads=6)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight principal components of all usable embeddings, and every row whitened on them."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", count=8, scale=1024, offset=100000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_token_output": op3_token_output,
    "op4_ann": op4_ann,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash": op6_minhash,
    "op7_sharding": op7_sharding,
    "op8_exact_topk": op8_exact_topk,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_chat_format": op11_chat_format,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}
