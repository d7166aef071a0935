"""Recall of the approximate search on vectors that do not cluster, where few leaves hold few of the nearest."""

import numpy as np
from pyspark.sql import functions as F

from meterloom.llm import ann


def test_recall_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    x = np.random.Generator(np.random.PCG64(8)).normal(size=(16_000, 128)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df, F.col("id") % 400 == 0, 20, sample=4000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = x.astype(np.float64)
    held = 0
    for q in range(0, 16_000, 400):
        scores = exact @ exact[q]
        scores[q] = -np.inf
        held += len(got[q] & set(np.argpartition(-scores, 19)[:20].tolist()))
    assert len(got) == 40 and held >= 0.9 * 20 * 40
