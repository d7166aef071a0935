"""Whitening against numpy's symmetric eigensolver on small tables with all edge cases."""

import math

import numpy as np

from meterloom.llm.whitening import components, one_sided_jacobi, pivoted_cholesky, whiten

SCHEMA = "vec_id bigint, embedding array<float>, x string, w double"


def brute(rows, count):
    ids = [i for i, v, *_ in rows if v is not None and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for i, v, *_ in rows if i in ids or (i is None and v is not None and all(c is not None and math.isfinite(c) for c in v))])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    return x, n, s, values[order], vectors[:, order], centred


def test_against_eigh_with_edge_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 4)) * [0.5, 0.2, 0.1, 0.05]
    rows = [(i, [float(c) for c in v], "clash", 1.0) for i, v in enumerate(base)]
    rows += [(100, None, None, None), (101, [1.0, None, 0.0, 0.0], None, None), (102, [float("nan"), 0.0, 0.0, 0.0], None, None),
             (103, [float("inf"), 0.0, 0.0, 0.0], None, None), (104, [], None, None), (3, rows[3][1], "again", 2.0), (None, rows[5][1], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = whiten(df.withColumnRenamed("x", "w_") , count=3).toPandas()
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 4 and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in r[1]] for r in kept])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:3]
    values, vectors = values[order], vectors[:, order]
    assert len(got) == 3 * len(kept) == 3 * 62
    assert set(got["n"]) == {62}
    assert got["component"].value_counts().to_dict() == {1: 62, 2: 62, 3: 62}
    assert got["vec_id"].isna().sum() == 3
    shares = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values / np.trace(cov), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for k in range(3):
        want = centred @ vectors[:, k] / math.sqrt(values[k])
        mine = got[got["component"] == k + 1].sort_values(["vec_id", "deviation"], na_position="first")
        order_rows = sorted(range(len(kept)), key=lambda j: (kept[j][0] is not None, kept[j][0] if kept[j][0] is not None else 0, ((n * x[j] - s) ** 2).sum()))
        w = want[order_rows]
        assert min(np.abs(mine["whitened"].to_numpy() - w).max(), np.abs(mine["whitened"].to_numpy() + w).max()) < 1e-9
    dev = sorted(int(((n * row - s) ** 2).sum()) for row in x)
    assert sorted(got[got["component"] == 1]["deviation"]) == dev


def test_empty_single_and_equal_rows(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4], None, None)], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [0.1, 0.2], None, None), (2, [0.1, 0.2], None, None)], SCHEMA)).count() == 0
    two = whiten(spark.createDataFrame([(1, [0.1, 0.2], None, None), (2, [0.3, 0.2], None, None)], SCHEMA)).collect()
    assert [(r["vec_id"], r["component"]) for r in sorted(two, key=lambda r: r["vec_id"])] == [(1, 1), (2, 1)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 and r["explained"] == 1.0 for r in two)


def test_factor_and_rotations_on_rank_deficient_matrix():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(7, 3))
    cov = a @ a.T
    factor = pivoted_cholesky(cov, 1e-12 * np.trace(cov))
    assert factor.shape == (7, 3) and np.allclose(factor @ factor.T, cov)
    norms, vectors = one_sided_jacobi(factor)
    assert np.allclose(vectors.T @ vectors, np.eye(3))
    values, comp = components(cov, 8)
    want = np.sort(np.linalg.eigvalsh(cov))[::-1][:3]
    assert len(values) == 3 and np.allclose(values, want)
    assert np.allclose(cov @ comp, comp * values)
