import datetime as dt
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterloom.operators.annotate import annotate
from meterloom.operators.quarantine import split_rejects
from meterloom.operators.samples import to_samples
from meterloom.operators.series import assemble_series
from meterloom.plans.decode import _write_request, decoded_series
from meterloom.sinks import remote_write as rw
from meterloom.sinks.files import check_codec, to_json_records, write_parquet
from meterloom.sources.delimited import read_delimited
from meterloom.sources.lines import stream_lines, stream_lines_after_header
from meterloom.specs import FieldSpec, SeriesSpec
from meterloom.streaming.pipeline import (
    append_control,
    parquet_sink,
    read_control,
    remote_write_sink,
    start_pipeline,
    stream_latency,
)

T0 = dt.datetime(2024, 1, 1)
SAMPLE = "name string, metric_type string, ts timestamp, value double, labels map<string,string>"


def samples(spark, n=6):
    rows = [(f"m{i % 2}", "gauge", T0 + dt.timedelta(seconds=i), float(i), {"host": "é" * 100}) for i in range(n)]
    return spark.createDataFrame(rows, SAMPLE)


def test_messages_equal_the_protobuf_library():
    stamps = np.array([0, 1, 127, 128, -1, 1704067200000, 2**62], np.int64)
    values = np.array([0.0, -1.5, float("inf"), 1e300, 5e-324, 42.0, -0.0])
    labels = [{"name": "__name__", "value": "m"}, {"name": "host", "value": "é" * 100}]
    rows = [{"timestamp": int(t), "value": float(v)} for t, v in zip(stamps, values)]
    batch = pa.RecordBatch.from_pylist([{"labels": labels, "samples": rows}, {"labels": labels, "samples": rows[:1]}])
    body = b"".join(m for m, _, _ in rw._series_messages(batch))
    got = _write_request().FromString(body)
    assert [(p.name, p.value) for p in got.timeseries[0].labels] == [("__name__", "m"), ("host", "é" * 100)]
    assert [s.timestamp for s in got.timeseries[0].samples] == stamps.tolist()
    assert [s.value for s in got.timeseries[0].samples] == values.tolist()
    assert len(got.timeseries) == 2 and len(got.timeseries[1].samples) == 1


def test_a_long_series_is_cut_into_requests(spark):
    series = assemble_series(samples(spark, 400), "1 day").coalesce(1)
    got = rw.remote_write_payloads(series, max_samples=30).collect()
    assert sum(r.n_samples for r in got) == 400 and max(r.n_samples for r in got) <= 30


def test_requests_stay_below_the_sample_limit(spark):
    series = assemble_series(samples(spark, 40), "10 seconds").coalesce(1)
    got = rw.remote_write_payloads(series, max_samples=10).collect()
    assert sum(r.n_samples for r in got) == 40 and all(r.n_samples <= 10 for r in got)
    assert max(r.last_ms for r in got) == 1704067200000 + 39_000


def test_remote_write_sends_and_retries_by_failing(spark, tmp_path):
    rw.register(spark)
    series = assemble_series(samples(spark))
    writer = series.write.format("remote_write").mode("append").option("address", "http://example.invalid/")
    writer.option("auth", "bearer").option("token", str(tmp_path)).option("post", "tests.fake_post:accept").save()
    sent = [json.loads(p.read_text()) for p in tmp_path.glob("*.json")]
    assert {s["url"] for s in sent} == {"http://example.invalid/api/v1/write"}
    assert sent[0]["headers"]["Content-Encoding"] == "snappy"
    with pytest.raises(Exception, match="status 400"):
        series.write.format("remote_write").mode("append").option("address", "http://example.invalid").option(
            "post", "tests.fake_post:refuse"
        ).save()


def test_auth_headers():
    assert rw.auth_headers({}) == {}
    basic = rw.auth_headers({"auth": "basic", "username": "u", "password": "p"})
    assert basic == {"Authorization": "Basic dTpw"}
    with pytest.raises(ValueError):
        rw.auth_headers({"auth": "digest"})


def test_codecs(spark, tmp_path):
    for bad in ("lzo", "brotli", "zip"):
        with pytest.raises(ValueError):
            check_codec(bad)
    write_parquet(samples(spark).withColumn("_inbound", F.lit("x")), str(tmp_path / "p"), codec="none", epoch_millis=True)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert dict(back.dtypes)["ts"] == "bigint" and "_inbound" not in back.columns and back.count() == 6


def test_json_special_values(spark):
    df = spark.sql("select double('NaN') a, double('-Infinity') b, named_struct('value', 2L, 'unit', 'W') n, 'T' _type, 'e' _error")
    assert json.loads(to_json_records(df).first().json) == {"a": None, "b": "-Infinity", "n": 2, "__type__": "T"}


def test_control_stream_then_data_stream(spark, tmp_path):
    lines, control, data, out = (str(tmp_path / n) for n in ("lines", "control", "data", "out"))
    spark.createDataFrame([("set,phase,warm",), ("nonsense",)], "value string").coalesce(1).write.text(lines)
    later = F.when(F.col("value").startswith("clear"), F.lit(T0 + dt.timedelta(hours=1))).otherwise(F.lit(T0))

    def take_control():
        stream = spark.readStream.text(lines).withColumn("ts", later).withColumn("seq", F.lit(0).cast("bigint"))
        append_control(stream, control, str(tmp_path / "c1")).awaitTermination()

    take_control()
    assert [(r.action, r.name, r.value) for r in read_control(spark, control).collect()] == [("set", "phase", "warm")]

    def run():
        source = spark.readStream.schema(SAMPLE).parquet(data)
        start_pipeline(source, [parquet_sink(out), parquet_sink(out + "2")], str(tmp_path / "c2"), control_path=control).awaitTermination()

    samples(spark).write.parquet(data)
    run()
    got = {r.ts: r.labels.get("phase") for r in spark.read.parquet(out).collect()}
    assert got[T0] is None and got[T0 + dt.timedelta(seconds=1)] == "warm"
    # A line appended to the control table counts from the next batch on.
    spark.createDataFrame([("clear,all",)], "value string").coalesce(1).write.mode("append").text(lines)
    take_control()
    late = [("m0", "gauge", T0 + dt.timedelta(hours=2), 1.0, {"host": "h"})]
    spark.createDataFrame(late, SAMPLE).write.mode("append").parquet(data)
    run()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 7 and {r.ts: dict(r.labels) for r in rows}[T0 + dt.timedelta(hours=2)] == {"host": "h"}
    assert spark.read.parquet(out + "2").count() == 7


def test_stream_latency_emits_closed_windows(spark, tmp_path):
    rows = [("k", T0 + dt.timedelta(seconds=s), 1000 * s) for s in (1, 2, 3, 60)]
    spark.createDataFrame(rows, "key string, ts timestamp, us bigint").coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("key string, ts timestamp, us bigint").parquet(str(tmp_path / "d"))
    query = stream_latency(
        stream, parquet_sink(str(tmp_path / "o")), str(tmp_path / "c"), key="key", ts="ts", elapsed_us="us"
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert [(r["count"], r.p50_ms) for r in got] == [(3, 2)]


def test_control_lines_as_plain_text_over_restarts(spark, tmp_path):
    lines, control = str(tmp_path / "lines"), str(tmp_path / "control")

    def arrive(*rows):
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(lines)
        append_control(stream_lines(spark, lines), control, str(tmp_path / "c")).awaitTermination()
        return [(r.action, r.name, r.value) for r in read_control(spark, control).orderBy("ts", "seq").collect()]

    first = [("set", "a", "1"), ("unset", "a", None), ("set", "a", "2")]
    assert arrive("set,a,1", "unset,a", "nonsense", "set,a,2") == first
    assert arrive("delete,b", "clear,all") == first + [("delete", "b", None), ("clear", "all", None)]
    assert arrive(",,") == first + [("delete", "b", None), ("clear", "all", None)]
    rejects = spark.read.parquet(control + "-rejects").collect()
    assert sorted(r.line for r in rejects) == [",,", "nonsense"] and all(r.error for r in rejects)
    data = [(1, dt.datetime.now() + dt.timedelta(days=1), {"a": "own"})]
    got = annotate(spark.createDataFrame(data, "id int, ts timestamp, labels map<string,string>"), read_control(spark, control)).first()
    assert got.labels == {"a": "own"}


def test_header_file_stream_to_both_sinks(spark, tmp_path):
    """Header files and control lines in, annotated samples out to Parquet and remote write."""
    rw.register(spark)
    files, lines, control, out, sent = (tmp_path / n for n in ("files", "lines", "control", "out", "sent"))
    for folder in (files, lines, sent):
        folder.mkdir()
    (lines / "a.txt").write_text("set,phase,warm\n")
    stream = stream_lines(spark, str(lines)).withColumn("ts", F.lit(T0))
    append_control(stream, str(control), str(tmp_path / "c1")).awaitTermination()
    fields = [FieldSpec("host"), FieldSpec("at", "datetime"), FieldSpec("load", "float"), FieldSpec("temp", "float", optional=True)]
    spec = SeriesSpec(labels=["host"], values=["load", "temp"], timestamp="at")
    reports = []

    def run(number, *rows):
        (files / f"{number}.csv").write_text("host,at,load,temp\n" + "".join(r + "\n" for r in rows))
        good, _ = split_rejects(read_delimited(stream_lines_after_header(spark, str(files)), fields, units=False))
        samples = to_samples(good, spec)
        remote = remote_write_sink(
            rejects=parquet_sink(str(tmp_path / "bad")), report=reports.append,
            address="http://example.invalid", auth="bearer", token=str(sent), post="tests.fake_post:accept",
        )
        start_pipeline(samples, [parquet_sink(str(out)), remote], str(tmp_path / "c2"), control_path=str(control)).awaitTermination()

    run(1, "n1,2024-01-01 00:00:05,1.5,20", "n2,2024-01-01 00:00:06,nan,", "bad line")
    run(2, "n1,2024-01-01 00:00:07,2.5,21")
    rows = spark.read.parquet(str(out)).collect()
    assert {(r.name, r.labels["host"], r.labels["phase"]) for r in rows} == {("load", "n1", "warm"), ("temp", "n1", "warm"), ("load", "n2", "warm")}
    bodies = spark.createDataFrame([(p.read_bytes(),) for p in sent.glob("*.bin")], "payload binary")
    assert decoded_series(bodies).agg(F.sum("n")).first()[0] == len(rows) == 5
    assert [r["kept"] for r in reports] == [3, 2] and all(r["lagging"] and not r["incomplete"] for r in reports)


def test_remote_write_keeps_one_type(spark, tmp_path):
    rw.register(spark)
    df = samples(spark).withColumn("_type", F.when(F.col("value") != 3, "TimeseriesRecord").otherwise("Other"))
    df = df.withColumn("metric_type", F.when(F.col("value") != 4, F.col("metric_type")))
    reports, (bad, sent) = [], (tmp_path / "bad", tmp_path / "sent")
    sent.mkdir()
    remote_write_sink(
        rejects=parquet_sink(str(bad)), report=reports.append, address="http://x.invalid", auth="bearer", token=str(sent), post="tests.fake_post:accept"
    )(df, 7)
    assert (reports[0]["kept"], reports[0]["dropped"], reports[0]["incomplete"], reports[0]["last_ms"]) == (5, 1, 1, 1704067205000)
    assert [r.error for r in spark.read.parquet(str(bad)).collect()] == ["sample without metric_type"]


def test_fifty_batches_leave_no_more_folders_than_one(spark, tmp_path):
    from meterloom import scratch

    data, control = str(tmp_path / "d"), str(tmp_path / "control")
    spark.createDataFrame([(T0, 1, "set", "phase", "warm")], "ts timestamp, seq long, action string, name string, value string").write.parquet(f"{control}/batch=0")
    for i in range(50):
        spark.createDataFrame([("m0", "gauge", T0 + dt.timedelta(seconds=i + 1), float(i), {"host": "h"})], SAMPLE).coalesce(1).write.parquet(f"{data}/{i:03d}")
    owner = f"{scratch.shared_base(spark)}/{scratch.OWNER}"
    path = spark._jvm.org.apache.hadoop.fs.Path(owner)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def folders():
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    before = folders()
    source = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(data)
    query = start_pipeline(source, [parquet_sink(str(tmp_path / "o"))], str(tmp_path / "c"), control_path=control)
    query.awaitTermination()
    assert len(query.recentProgress) >= 10 and query.lastProgress["batchId"] == 49
    assert folders() == before or set(folders()) - set(before) <= {scratch.MARK}
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(got) == 50 and all(r.labels["phase"] == "warm" for r in got)


def test_sweep_removes_owners_whose_mark_is_old(spark):
    from meterloom import scratch

    base = scratch.shared_base(spark)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    old, fresh = f"{base}/owner-dead-{T0.microsecond}", f"{base}/owner-alive-{T0.microsecond}"
    for owner in (old, fresh):
        spark.range(3).write.mode("overwrite").parquet(f"{owner}/annotate-1")
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{owner}/{scratch.MARK}"), True).close()
    fs.setTimes(jvm.org.apache.hadoop.fs.Path(f"{old}/{scratch.MARK}"), 0, -1)
    gone = scratch.sweep_orphans(spark, stale_after_s=3600)
    assert any(g.endswith(old.rsplit("/", 1)[1]) for g in gone)
    assert not fs.exists(jvm.org.apache.hadoop.fs.Path(old)) and fs.exists(jvm.org.apache.hadoop.fs.Path(fresh))
    assert fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{scratch.OWNER}")) or not gone is None
    fs.delete(jvm.org.apache.hadoop.fs.Path(fresh), True)


def test_a_failing_sink_makes_no_other_sink_see_a_batch_twice(spark, tmp_path):
    data = str(tmp_path / "d")
    for i in range(3):
        samples(spark, 2).coalesce(1).write.parquet(f"{data}/{i}")
    seen = {"first": [], "second": []}
    fail = {"once": True}

    def first(batch, batch_id):
        seen["first"].append(batch_id)

    def second(batch, batch_id):
        if batch_id == 1 and fail["once"]:
            fail["once"] = False
            raise RuntimeError("sink down")
        seen["second"].append((batch_id, batch.count()))

    def run():
        source = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(data)
        start_pipeline(source, [first, second], str(tmp_path / "c")).awaitTermination()

    with pytest.raises(Exception):
        run()
    run()
    assert seen["first"] == [0, 1, 2]
    assert seen["second"] == [(0, 2), (1, 2), (2, 2)]


def test_a_source_of_one_piece_is_dealt_to_all_cores(spark, tmp_path):
    control, data = str(tmp_path / "control"), str(tmp_path / "data")
    spark.createDataFrame([(T0, 0, "set", "phase", "warm")], "ts timestamp, seq long, action string, name string, value string").write.parquet(control)
    samples(spark, 400).coalesce(1).write.parquet(data)
    seen = []
    sink = lambda batch, _: seen.append((batch.rdd.getNumPartitions(), sorted(r.value for r in batch.collect())))
    stream = spark.readStream.schema(SAMPLE).parquet(data)
    start_pipeline(stream, [sink], str(tmp_path / "c"), control_path=control).awaitTermination()
    assert seen == [(spark.sparkContext.defaultParallelism, [float(i) for i in range(400)])]


def test_pieces_and_windows_change_no_request(spark, monkeypatch):
    # seven samples a piece, eleven a window: cuts fall inside pieces, windows and requests
    series = assemble_series(samples(spark, 400), "2 minutes").coalesce(1)
    whole = [r for b in [series.toArrow().combine_chunks()] for r in rw._requests(iter(b.to_batches()), 30)]
    pieces = rw.sample_pieces(series, 7)
    assert pieces.selectExpr("max(size(samples))").first()[0] == 7
    monkeypatch.setattr(rw, "WINDOW_SAMPLES", 11)
    cut = list(rw._requests(iter(pieces.toArrow().to_batches(max_chunksize=5)), 30))
    assert cut == whole and sum(r.n_samples for r in cut) == 400


def test_encoding_memory_does_not_follow_the_batch():
    import tracemalloc

    peaks = []
    for n in (400_000, 1_600_000):
        flat = pa.StructArray.from_arrays([pa.array(np.arange(n)), pa.array(np.ones(n))], names=["timestamp", "value"])
        lists = pa.ListArray.from_arrays(pa.array([0, n // 2, n], pa.int32()), flat)
        labels = pa.array([[{"name": "a", "value": str(i)}] for i in range(2)])
        batch = pa.RecordBatch.from_arrays([labels, lists], names=["labels", "samples"])
        tracemalloc.start()
        assert sum(r.n_samples for r in rw._requests(iter([batch]), 1000)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
