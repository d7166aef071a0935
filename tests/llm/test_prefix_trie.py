"""The conversation prefix trie against plain Python."""

import random

from pyspark.sql import functions as F

from meterloom.llm.prefix_trie import prefix_trie
from meterloom.scratch import Scratch

from .trie_brute import brute_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = prefix_trie(df, Scratch(spark, "t")).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0]))


def test_small_families_with_edge_rows(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "bye"), (1, 0, "user", "hi"), (1, 1, "assistant", "other"),
            (2, None, "user", "x"), (2, 0, None, None), (3, 5, "user", "hi"), (3, 5, "user", "hi"), (100, 0, "system", ""), (101, 0, "user", "ü" * 50),
            (150, 1, "user", "hi"), (7, 0, "user", "a" * 10000), (None, 0, "user", "gone"), (5, 0, "user", "hi"), (5, 1, "assistant", "hello")]
    assert run(spark, rows) == brute_trie(rows)


def test_random_trees(spark):
    rng = random.Random(7)
    rows = []
    for conv in rng.sample(range(0, 900), 200):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30, 90])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "c"]) if turn < 6 else f"t{rng.randrange(3)}"))
    assert run(spark, rows) == brute_trie(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
