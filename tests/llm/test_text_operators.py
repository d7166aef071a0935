"""BPE, token segments, line and near duplicates on small inputs with all edge cases."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterloom.llm import bpe, dac, minhash, text_hash
from meterloom.llm.components import connected_components
from meterloom.llm.line_dedup import deduplicate_lines
from meterloom.llm.bpe import library_encoder
from meterloom.llm.queries import TOKENIZER
from meterloom.scratch import scratch_folder

PATH = public_tokenizers.path(TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " ", "\n\t", "One plain line.", "one PLAIN line.", "É́ẞİΣσ ﬁ 一二 x\x85y\xa0z\x1cw", "a" * 3000, "th" * 2000 + "!?" * 50,
    "x<|endoftext|>y <|startoftext|><|endoftext|>é́<|ENDOFTEXT|>", "it's I'LL '''s 1234 ½", "same\nsame\nsame\nsame", "\x00a\x00",
    "l1\nl2\nl3\nl4\nl5", "q\nl2\nl3\nl4\nz", "one plain line.",
]
SCHEMA = "doc_id bigint, text string, n_chars string, score string, bands string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None, "b") for i, t in enumerate(TEXTS)] + [(None, "l1\nl2\nl3", "y", None, "b"), (3, "\n\t", "z", None, "b"), (4, "another text of one id", "z", None, "b")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abeinrst'<|>ÀÿſΣİ é\n1²"), st.characters(codec="utf-8")), max_size=60))
def test_prefix_encoder_is_the_library(text):
    tokens = bpe.encoder(PATH)
    ids = tokens.encode(text)
    assert ids.tolist() == ids_of(text)
    assert tokens.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_prefix_encoder_survives_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 7)
    tokens = bpe.PrefixEncoder(PATH)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 9))) for _ in range(400))
    assert tokens.encode(text).tolist() == ids_of(text)


def test_encode_documents(spark, docs):
    rows = bpe.encode_documents(docs, PATH).collect()
    want = [(r["doc_id"], ids_of(r["text"])) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=key) == sorted(want, key=key)
    assert all(r["decoded"] == LIBRARY.decode(r["ids"], skip_special_tokens=False) for r in rows)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 2**32 - 1])
def test_codes_any_place(top):
    rng = np.random.Generator(np.random.PCG64(top))
    ids = rng.integers(0, top, 3000, endpoint=True, dtype=np.uint32)
    ids[rng.random(3000) < 0.5] //= 1000
    codes = dac.Codes(dac.encode_codes(ids))
    places = rng.integers(0, 3000, 500)
    assert (codes.at(places) == ids[places]).all()
    for begin, end in [(0, 3000), (0, 0), (5, 6), (63, 65), (511, 1025), (2999, 3000)]:
        assert (codes.between(begin, end) == ids[begin:end]).all()
    with pytest.raises(IndexError):
        codes.at(np.array([3000]))
    assert dac.Codes(dac.encode_codes(ids[:0])).size == 0


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_token_segments_round_trip(spark, docs, segment):
    folder = scratch_folder(spark, "segments")
    dac.write_token_segments(docs, folder, library_encoder(PATH), end_id=2, segment=segment)
    rows = dac.read_token_documents(spark, folder).orderBy("start").collect()
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in rows) == sorted((r["doc_id"] or -1, ids_of(r["text"]) + [2]) for r in docs.collect())
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)
    stream, start = [], 0
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        stream += r["ids"]
        start += r["n_tokens"]
    places = [0, 1, len(stream) - 1, 17, 17, None, len(stream), -4]
    got = dac.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in places], "place bigint"), span=64)
    assert {r["place"]: r["id"] for r in got.collect()} == {p: stream[p] for p in (0, 1, 17, len(stream) - 1)}
    assert got.count() == 4


def test_token_segments_of_no_documents(spark, docs):
    folder = scratch_folder(spark, "segments")
    dac.write_token_segments(docs.limit(0), folder, library_encoder(PATH), end_id=2)
    assert dac.read_token_documents(spark, folder).count() == 0


def plain_lines(rows):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines, gone = (text or "").split("\n"), set()
        for i in range(len(lines) - 2):
            passage = tuple(lines[i : i + 3])
            gone |= {i, i + 1, i + 2} if passage in seen else set()
            seen.add(passage)
        out[key] = (text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "l1\nl2\nl3")]
    rows += [(100 + i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(80)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, place int").repartition(5)
    got = deduplicate_lines(df)
    assert got.columns == ["doc_id", "text", "place", "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == plain_lines(rows)
    assert deduplicate_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        deduplicate_lines(df.withColumn("n_lines", F.lit(1)))


def test_line_dedup_of_repeated_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "a\nb\nc")]
    got = deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "")]


def test_word_and_shingle_hashes():
    texts = ["A b\tC", None, "", " x ", "a B c", "é\xa0É", "b c"]
    words, first = text_hash.word_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [3, 0, 0, 1, 3, 1, 2]
    assert words[:3].tolist() == words[4:7].tolist() and words[8:].tolist() == words[1:3].tolist()
    shingles, bounds = text_hash.shingle_hashes(words, first, 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 2, 1, 1] and shingles[1] == shingles[-1]


def test_word_hashes_across_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["w" * 50]
    whole = text_hash.word_hashes(pa.array(texts))
    monkeypatch.setattr(text_hash, "STEP", 16)
    pieces = text_hash.word_hashes(pa.array(texts))
    assert all((a == b).all() for a, b in zip(whole, pieces))
    assert np.diff(whole[1]).tolist() == [len(t.split()) for t in texts]


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain_components(rows, k, percent):
    sets = {i: sets_of(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 30)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(70):  # a family whose members differ in up to a fifth of their words
        words = [w if rng.random() > rng.choice([0.02, 0.05, 0.1, 0.15]) else f"new{rng.randint(0, 999)}" for w in base]
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(base)) for i in range(40)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in [*rows, (None, " ".join(base))]], "doc_id bigint, text string, n_shingles int, rep string").repartition(4)
    for k in (2, 5):
        got = minhash.near_duplicates(df, shingle=k).collect()
        want = plain_components(rows, k, 80)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want
        assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
        assert len(got) == len(rows) + 1
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_halves_estimate_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    pool = text_hash.mixed(np.arange(3000, dtype=np.uint64))
    a, b = pool[:2000], pool[1000:]
    both = np.concatenate([np.sort(a), np.sort(b)])
    s = minhash.signatures(both, np.array([0, 2000, 4000, 4000]), 400)
    for half in (s[:, :400], s[:, 400:]):
        assert abs((half[0] == half[1]).mean() - 1 / 3) < 0.1
    assert s.shape == (3, 800) and rng is not None


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(900, x) for x in range(901, 990)] + [(5, 5), (None, 3), (7, None)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0
    assert Counter(got.values())[900] == 90
