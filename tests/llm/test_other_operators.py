"""Mixing, sharding, vector searches, URL rules, toxicity and the pipeline on small inputs with all edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterloom.llm import exact_topk, mixing, sharding, toxicity
from meterloom.llm.ann import nearest
from meterloom.llm.exact_topk import exact_topk as topk
from meterloom.llm.oracles import ORACLES
from meterloom.llm.queries import QUERIES
from meterloom.llm.url_filter import judge_urls
from meterloom.scratch import scratch_folder

from ..compare import connect, differences


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, None: 1}, {"a": 5, "b": 0.3, "c": 1e-9, "d": 2.2}])
def test_schedule_deviates_less_than_a_block(weights):
    slots = mixing.whole_weights(weights, 256)
    assert sum(slots.values()) == 256 and min(slots.values()) >= 1
    assert all(abs(slots[s] - w / sum(weights.values()) * 256) < 1 + len(weights) for s, w in weights.items())
    done = Counter()
    for slot, (s, nth) in enumerate(mixing.fair_schedule(slots), 1):
        assert nth == done[s]
        done[s] += 1
        assert all(abs(done[x] - slots[x] / 256 * slot) < 1 for x in slots)
    assert done == slots


def test_weights_that_cannot_be():
    for bad in ({"a": 0}, {"a": -1}, {"a": float("inf")}, {"a": float("nan")}, dict.fromkeys(map(str, range(300)), 1)):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad, 256)


def test_mix_sources(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}" if i % 21 else None, "x") for i in range(2000)] + [(5, "s1", "again"), (5, "s1", "again"), (None, "s2", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    counts = mixing.source_counts(docs)
    weights = mixing.tempered_weights(counts, 0.5)
    mixed = mixing.mix_sources(docs, weights, counts, block=8, period=512).collect()
    once = [(r["doc_id"], r["source"], r["text"]) for r in mixed if r["mix_epoch"] == 0]
    assert Counter(once) == Counter(rows)
    slots = defaultdict(list)
    for r in mixed:
        slots[r["mix_slot"]].append(r)
    assert sorted(slots) == list(range(max(slots) + 1))
    done = Counter()
    whole = mixing.whole_weights(weights, 512)
    for slot in sorted(slots):
        assert len({(r["source"], r["mix_epoch"]) for r in slots[slot]}) == 1
        assert sorted(r["mix_place"] for r in slots[slot]) == list(range(len(slots[slot])))
        done[slots[slot][0]["source"]] += 1
        assert all(abs(done[s] - whole[s] / 512 * (slot + 1)) < 1 for s in whole)
    epochs = Counter((r["source"], r["mix_epoch"]) for r in mixed)
    for s, e in epochs:
        if (s, e + 1) in epochs:
            assert epochs[s, e] == counts[s]
    assert mixing.mix_sources(docs.limit(0), {}, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs.withColumn("mix_slot", F.lit(1)), weights, counts)
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"hot": 1.0}, counts)


def test_lookup_table():
    shards = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    share = Counter(table)
    assert len(share) == 7 and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.1 * 1009
    # every slot was claimed in turn by the shard that reached it first
    number = lambda t: int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
    free, want = set(range(1009)), {}
    order = {s: [(number(f"offset {s}") + i * (number(f"skip {s}") % 1008 + 1)) % 1009 for i in range(1009)] for s in shards}
    while free:
        for k, s in enumerate(shards):
            if free:
                slot = next(x for x in order[s] if x in free)
                free.discard(slot)
                want[slot] = k
    assert [want[i] for i in range(1009)] == table
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_assign_and_write_shards(spark):
    rows = [(i, "t") for i in range(500)] + [(7, "t"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.assign_shards(docs, ["a", "b", "c"])
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(rows)
    assert got.where("doc_id = 7").select("shard").distinct().count() == 1
    folder = scratch_folder(spark, "shards")
    sharding.write_shards(docs, folder, ["a", "b", "c"], rows_a_file=50)
    assert Counter((r["doc_id"], r["text"]) for r in spark.read.parquet(folder).collect()) == Counter(rows)
    assert sharding.assign_shards(docs.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs.withColumn("slot", F.lit(1)), ["a"])


VECTORS = "vec_id bigint, embedding array<float>, id int, v string"


def vector_rows(n=600, dim=8, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + rng.normal(size=dim) * 0.7).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(80)] + [(3, rows[3][1]), (3, rows[3][1])]
    rows += [(5000, None), (5020, []), (5040, [0.0] * dim), (5060, [float("nan")] + [1.0] * (dim - 1)), (5080, [float("inf")] * dim), (5100, [None] + [1.0] * (dim - 1)), (5120, [1.0] * (dim + 1)), (None, [1.0] * dim)]
    return rows


def plain_search(rows, step, k, zeros, score):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and (zeros or any(v)):
            good[i] = min(good.get(i, v), v)
    out = {}
    for q in good:
        if q % step == 0:
            found = sorted((-score(good[q], v), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def by_query(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 16)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(4)
    whole = lambda v: [int(np.floor(1024 * float(x))) for x in v]
    want = plain_search(rows, 20, 10, True, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b))))
    assert by_query(topk(df, F.col("id") % 20 == 0, 10)) == want
    few = df.where("vec_id < 4")
    assert {q: len(x) for q, x in by_query(topk(few, F.col("id") == 0, 10)).items()} == {0: 3}
    assert topk(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert topk(df.where("vec_id = 1"), F.col("id") % 20 == 0).count() == 0


def test_nearest(spark):
    rows = vector_rows(3000)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(4)
    want = plain_search(rows, 20, 20, False, lambda a, b: sum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, b)))
    got = by_query(nearest(df, F.col("id") % 20 == 0, 20))
    assert got.keys() == want.keys()
    scores = [({i for i, _ in want[q]}, dict(got[q])) for q in want]
    assert sum(len(w & g.keys()) for w, g in scores) >= 0.9 * sum(len(w) for w, _ in scores)
    assert all(len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) for q in got)
    few = df.where("vec_id < 4")
    assert {q: len(x) for q, x in by_query(nearest(few, F.col("id") == 0, 20)).items()} == {0: 3}
    assert nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_judge_urls(spark):
    link = '<LINK href="{}" rel="canonical">'
    fresh = "<meta http-equiv='refresh' content='0; URL={}'>"
    pages = [
        (1, "http://a.test/1?x=1#f", link.format("https://bad.test/b/1")),
        (2, "https://BAD.test/b/1", ""),
        (3, "https://sub.bad.test/b/2#z", None),
        (4, "https://bad.test/ok/1", fresh.format("http://a.test/1?x=1")),
        (5, "http://c.test", fresh.format("/d")),
        (6, "http://c.test/d", link.format("http://e.test/")),
        (7, None, link.format("https://bad.test/b/1")),
        (8, "no scheme", link.format("https://bad.test/b/1")),
        (9, "http://notbad.test/b/1", ""),
        (9, "http://notbad.test/b/1", ""),
        (10, "http://f.test/", ""),
    ]
    rules = [("bad.test", "/b/", "block"), ("bad.test", "/ok/", "allow"), ("test", "/never", "block")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, host string")
    redirects = spark.createDataFrame([("http://f.test/", "http://g.test/"), ("http://g.test/", "http://bad.test/b/9"), (None, "x")], "a string, b string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["by_alias"]) for r in judge_urls(df, rules, redirects).collect()}
    assert got == {
        1: ("a.test", "/1", None, "block", True),
        2: ("bad.test", "/b/1", "bad.test/b/", "block", False),
        3: ("sub.bad.test", "/b/2", "bad.test/b/", "block", False),
        4: ("bad.test", "/ok/1", "bad.test/ok/", "allow", False),
        5: ("c.test", "", None, "allow", False),
        6: ("c.test", "/d", None, "allow", False),
        7: ("", "", None, "allow", False),
        8: ("", "", None, "allow", False),
        9: ("notbad.test", "/b/1", None, "allow", False),
        10: ("f.test", "/", None, "block", True),
    }
    assert judge_urls(df, rules).count() == len(pages)
    assert judge_urls(df.limit(0), rules).count() == 0


def labelled(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdlmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["grumpface", "dungheap", "wretch", "grumpfaced", "dungheaps"])
        out.append((i, " ".join(text), toxic))
    return out


def test_toxicity_learns_subwords(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, ""), (5001, "", ""), (None, "!!!", "")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (9999, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert 0 <= got[5000] == got[5001] == got[None] < 0.5
    unseen = model.scores(pa.array(["bala grumpfacing dora", "the wretchedly lame dungheaped", "bala dora lame"]))
    assert unseen[0] > 0.5 and unseen[1] > 0.5 and unseen[2] < 0.5
    # a few words count as much in a long text
    long = " ".join(t for _, t, y in rows if not y)[:60_000]
    assert model.scores(pa.array([long + " grumpface " + " wretch "]))[0] > model.scores(pa.array([long]))[0]


def test_toxicity_without_classes(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id bigint, text string")
    for labels, low in (([], True), ([(i, 0) for i in range(9)], True), ([(i, 1) for i in range(9)], False)):
        model = toxicity.train_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert all((r["score"] < 0.5) == low for r in toxicity.with_toxicity(docs, model).collect())
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0


def test_window_deal():
    texts = ["", None, "a", "ab cd", " ".join(["word"] * 25), "é" * 3]
    b = toxicity.bags(pa.array(texts))
    per_window = np.diff(b.windows)
    assert np.diff(b.texts).tolist() == [0, 0, 1, 1, 3, 1]
    assert per_window.sum() == len(b.words) - 1 == 1 + 2 + 25 + 1 and per_window.max() <= toxicity.WINDOW
    assert (np.diff(b.words) > 0).all() and len(b.buckets) == b.words[-1]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, con, data, name):
    assert differences(spark, con, name, QUERIES[name], ORACLES[name], data) is None


def test_pipeline_stages(spark, data):
    """Each stage against plain Python over what the stage before kept."""
    import re

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        folder = scratch_folder(spark, name)
        stage(spark, docs, data).write.parquet(folder)
        docs = spark.read.parquet(folder)
        after[name] = docs.toPandas()
        if name != "bpe":
            assert docs.columns == columns
    start = spark.read.parquet(f"{data}/documents.parquet").toPandas().set_index("doc_id")
    clean = after["toxicity"].set_index("doc_id")
    assert (start.loc[clean.index].text == clean.text).all() and 0.75 * len(start) < len(clean) < len(start)

    seen, left = set(), {}
    for key, text in sorted(clean.text.items()):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            gone |= {i, i + 1, i + 2} if tuple(lines[i : i + 3]) in seen else set()
            seen.add(tuple(lines[i : i + 3]))
        if len(gone) < len(lines):
            left[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    unlined = after["line_dedup"].set_index("doc_id")
    assert unlined.text.to_dict() == left
    assert (unlined.n_chars == unlined.text.str.len()).all()

    sets, kept = {}, set()
    for key, text in left.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    kept = {k for k, r in root.items() if r == k}
    assert sorted(after["near_dedup"].doc_id) == sorted(kept)

    mixed = after["mixing"]
    assert set(mixed.doc_id) == kept
    assert Counter(zip(mixed.doc_id, mixed.text)).keys() == {(k, left[k]) for k in kept}
    from .test_text_operators import LIBRARY, ids_of

    encoded = after["bpe"]
    assert Counter(encoded.doc_id) == Counter(mixed.doc_id)
    for r in encoded.itertuples():
        ids = ids_of(left[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
