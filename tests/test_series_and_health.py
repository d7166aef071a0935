import datetime as dt
import math
import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.operators.conform import conform
from meterloom.operators.health import freshness, latency_summary
from meterloom.operators.series import assemble_series, series_row_errors, summarize_series, to_series_rows

T0 = dt.datetime(2024, 1, 1)
SAMPLE = "name string, metric_type string, ts timestamp, value double, labels map<string,string>"


def sample(name="m", second=0, value=1.0, **labels):
    return (name, "gauge", T0 + dt.timedelta(seconds=second), value, labels)


def test_one_sample_has_its_name_among_sorted_labels(spark):
    row = assemble_series(spark.createDataFrame([sample("test_metric", 0, 42.0, host="localhost", env="test")], SAMPLE)).first()
    assert [(p.name, p.value) for p in row.labels] == [("__name__", "test_metric"), ("env", "test"), ("host", "localhost")]
    assert [(s.timestamp, s.value) for s in row.samples] == [(1704067200000, 42.0)]


def test_same_labels_merge_in_time_order_and_keep_repeats(spark):
    rows = [sample("a", 2, 43.0), sample("a", 1, 42.0), sample("a", 1, 42.0), sample("b", 1, 7.0)]
    got = assemble_series(spark.createDataFrame(rows, SAMPLE)).collect()
    values = {r.labels[0].value: [s.value for s in r.samples] for r in got}
    assert values == {"a": [42.0, 42.0, 43.0], "b": [7.0]}
    assert assemble_series(spark.createDataFrame([], SAMPLE)).count() == 0


def test_incomplete_samples_say_what_they_lack(spark):
    rows = [sample(), ("m", None, T0, 1.0, {}), ("m", "gauge", T0, None, {})]
    df = spark.createDataFrame(rows, SAMPLE)
    assert [r["_error"] for r in series_row_errors(df).collect()] == [None, "sample without metric_type", "sample without value"]
    assert to_series_rows(df).count() == 1


def test_hot_groups_are_dealt_without_loss(spark):
    # A third of all rows are copies of one sample; another third share an instant.
    rows = [sample("hot", 5, 1.0)] * 100 + [sample("hot", 6, float(i)) for i in range(100)]
    rows += [sample(f"cold{i}", i, 2.0) for i in range(100)]
    got = assemble_series(spark.createDataFrame(rows, SAMPLE), max_samples=20).collect()
    seen = Counter((r.labels[0].value, s.timestamp, s.value) for r in got for s in r.samples)
    want = Counter((n, int((t.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000), v) for n, _, t, v, _ in rows)
    assert seen == want
    hot = [len(r.samples) for r in got if r.labels[0].value == "hot"]
    assert len(hot) > 5 and max(hot) < 80
    assert all(r.part == 0 for r in got if r.labels[0].value != "hot")
    spans = sorted((r.part, r.samples[0].timestamp, r.samples[-1].timestamp) for r in got if r.labels[0].value == "hot")
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_hot_groups_are_cut_in_time_order(spark):
    rng = random.Random(3)
    rows = [sample("hot", int(rng.random() ** 3 * 5000), float(i)) for i in range(3000)] + [sample("cold", 1, 1.0)]
    got = assemble_series(spark.createDataFrame(rows, SAMPLE), max_samples=100).collect()
    hot = sorted((r for r in got if r.labels[0].value == "hot"), key=lambda r: r.part)
    assert sorted(s.value for r in hot for s in r.samples) == [float(i) for i in range(3000)]
    assert all(len(r.samples) <= 100 for r in hot) and len({r.part for r in hot}) == len(hot)
    assert all(a.samples[-1].timestamp <= b.samples[0].timestamp for a, b in zip(hot, hot[1:]))


def test_assembly_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([sample("hot", i, 1.0) for i in range(50)], SAMPLE).write.parquet(path)
    got = assemble_series(spark.read.parquet(path), max_samples=10)
    assert "tmp_path" not in got._jdf.queryExecution().toString() and path not in got._jdf.queryExecution().toString()


def test_summary_of_odd_values(spark):
    rows = [sample(n, i, v) for n, vs in {"big": [1e23, 1e23], "nan": [1.0, float("nan")], "inf": [1.0, float("inf")], "small": [4e-7, 4e-7], "tiny": [1e-9]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SAMPLE)
    got = {r.labels[0].value: r.total for r in summarize_series(df).collect()}
    assert got["big"] == 2e23 and math.isnan(got["nan"]) and got["inf"] == math.inf and got["small"] == 8e-7 and got["tiny"] == 1e-9
    exact = {r.labels[0].value: (r.total, r.left_out) for r in summarize_series(df, scale=2).collect()}
    assert exact["nan"][1] == 1 and exact["inf"][1] == 1 and float(exact["inf"][0]) == 1.0
    # what is beyond 28 digits is left out and counted, not an error
    exact = {r.labels[0].value: (r.total, r.left_out) for r in summarize_series(df, scale=6).collect()}
    assert exact["big"] == (None, 2)


def test_latency_ranks_and_truncation(spark):
    # n = 4: the median is the third value. 1999 us is 1 ms.
    rows = [("k", T0, us) for us in (1000, 2000, 3000, 4000)] + [("j", T0, 1999)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, us bigint")
    got = {r.key: r for r in latency_summary(df, key="key", ts="ts", elapsed_us="us").collect()}
    k = got["k"]
    assert (k["count"], k.mean_ms, k.min_ms, k.max_ms, k.p25_ms, k.p50_ms, k.p75_ms, k.p90_ms) == (4, 2, 1, 4, 2, 3, 4, 4)
    assert (got["j"].mean_ms, got["j"].p90_ms) == (1, 1)


def test_freshness_warns_above_a_second(spark):
    df = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(seconds=2))], "src string, ts timestamp")
    got = freshness(df, by="src", ts="ts", now=F.lit(T0 + dt.timedelta(seconds=1)))
    assert {r.src: (r.lag_ms, r.lagging) for r in got.collect()} == {"a": (1000, False), "b": (3000, True)}


def test_conform_by_type(spark):
    df = spark.sql(
        "select 1 i, 2.5D d, true b, timestamp'1970-01-01 00:00:01' t, named_struct('value', 3D, 'unit', 'W') n, "
        "array('x', null) a, map('k', 1.5D, 'z', cast(null as double)) m, named_struct('p', 1, 'q', 'y') s"
    )
    row = conform(
        df, "i double, d double, b string, t bigint, n double, a array<string>, m map<string,string>, "
        "s struct<q: string, r: int>, extra string, d2 bigint"
    ).first()
    assert row.i is None  # a whole number is no real number here
    assert (row.d, row.b, row.t, row.n, row.a) == (2.5, "true", 1000, 3.0, ["x", "null"])
    assert row.m == {"k": "1.5", "z": "null"} and row.s == ("y", None) and row.extra is None
    assert conform(df, T.StructType().add("n", "string")).first().n == "3 W"
