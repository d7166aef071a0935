"""The mixture against the weights as they are asked for, not rounded ones."""

from collections import Counter

import pytest

from meterloom.llm import mixing


@pytest.mark.parametrize(
    "counts", [{"huge": 10_000_000, "tiny": 10}, {"huge": 3_000_000, "a": 40, "b": 900, None: 33}, {str(i): 60_000 for i in range(20)}], ids=["one tiny", "several", "twenty"]
)
def test_slots_follow_the_real_weights(counts):
    weights = mixing.tempered_weights(counts, 0.9)
    parts = list(mixing.exact_parts(weights).values())
    needed = [-(-n // 32) for n in counts.values()]
    order = mixing.whole_schedule(parts, needed)
    share, done = [w / sum(weights.values()) for w in weights.values()], [0] * len(counts)
    for slot, k in enumerate(order, 1):
        done[k] += 1
        assert abs(done[k] - share[k] * slot) < 1 + 1e-6
        if slot % 1000 == 0:
            assert all(abs(x - w * slot) < 1 + 1e-6 for x, w in zip(done, share))
    assert all(x >= n for x, n in zip(done, needed))
    assert all(abs(x - w * len(order)) < 1 + 1e-6 for x, w in zip(done, share))


def test_tiny_source_is_not_repeated(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 1000)
    counts = {"huge": 400_000, "tiny": 3}
    docs = spark.range(400_003).selectExpr("id AS doc_id", "CASE WHEN id < 3 THEN 'tiny' ELSE 'huge' END AS source")
    weights = mixing.tempered_weights(counts, 0.9)
    for most in (mixing.BROADCAST, 1):
        monkeypatch.setattr(mixing, "BROADCAST", most)
        mixed = mixing.mix_sources(docs, weights, counts)
        assert Counter({r["doc_id"]: r["count"] for r in mixed.where("source = 'tiny'").groupBy("doc_id").count().collect()}) == {0: 1, 1: 1, 2: 1}
        assert mixed.where("mix_epoch = 0").select("doc_id").distinct().count() == mixed.where("mix_epoch = 0").count() == 400_003
        slots = mixed.selectExpr("count(DISTINCT mix_slot) AS n", "max(mix_slot) + 1 AS m").first()
        assert slots["n"] == slots["m"]
