"""Streams: annotated samples to one or more sinks, and the control table they read.

The control table is the durable state of the annotation. Its own query appends to it; the data
query reads it afresh for every micro-batch, because a file list taken once would go stale.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotate import annotate
from ..operators.health import LAG_WARNING_MS, latency_counts, latency_figures
from ..operators.quarantine import keep_type, split_rejects
from ..operators.series import assemble_series, series_row_errors
from ..schemas import CONTROL_SCHEMA
from ..scratch import _exists, _touch, lease, sweep_orphans, written
from ..sinks.files import check_codec, file_rows
from ..sources.delimited import read_delimited
from ..sources.lines import spread
from ..specs import SAMPLE_TYPE, FieldSpec

# The fields of a control line. A ``clear`` line needs some name as well.
CONTROL_FIELDS = (
    FieldSpec("action", "string"),
    FieldSpec("name", "string"),
    FieldSpec("value", "string", optional=True),
)

Sink = Callable[[DataFrame, int], None]


def control_rows(lines: DataFrame, *, line: str = "value", sep: str = ",") -> DataFrame:
    """Control lines as rows of the control table; rejected lines are left out, see :func:`split_control`."""
    return split_control(lines, line=line, sep=sep)[0]


def split_control(lines: DataFrame, *, line: str = "value", sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """``(rows of the control table, rejected lines)`` of a batch of control lines.

    ``ts`` and ``seq`` columns of the input are kept. Without them a line counts from the time of
    its (micro-)batch, in the order of its file's name and its place in the file.
    """
    kept = [c for c in ("ts", "seq") if c in lines.columns]
    if "seq" not in kept:
        order = ["_file"] if "_file" in lines.columns else []
        placed = lines.withColumn("_place", F.monotonically_increasing_id())
        lines = placed.orderBy(*order, "_place").withColumn("seq", F.monotonically_increasing_id()).drop("_place")
    good, bad = split_rejects(read_delimited(lines, CONTROL_FIELDS, sep=sep, line=line, inbound="control"))
    if "ts" not in kept:
        good = good.withColumn("ts", F.current_timestamp())
    return good.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTROL_SCHEMA]), bad


def read_control(spark: SparkSession, path: str) -> DataFrame:
    """The control table as it is now.

    It has a folder for each micro-batch of :func:`append_control`; files that something else puts beside them count too.
    """
    return spark.read.schema(CONTROL_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def append_control(
    lines: DataFrame, path: str, checkpoint: str, *, rejects: Sink | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Start the query that appends arriving control lines to the control table.

    A micro-batch that is run again replaces its own folder. Lines of later micro-batches come later in order.
    Rejected lines go to ``rejects``, by default to a folder beside the table.
    """
    rejects = rejects or parquet_sink(f"{path.rstrip('/')}-rejects")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows, bad = split_control(batch)
            if "seq" not in batch.columns:
                rows = rows.withColumn("seq", F.lit(batch_id).cast("bigint") * (1 << 44) + F.col("seq"))
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            rejects(bad.withColumnsRenamed({"_raw": "line", "_error": "error", "_file": "file"}), batch_id)
        finally:
            batch.unpersist()

    return (
        lines.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def parquet_sink(path: str, *, codec: str = "snappy", epoch_millis: bool = False) -> Sink:
    """A sink that writes each micro-batch to its own folder, so a replayed one replaces itself."""
    codec = check_codec(codec)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = file_rows(batch, epoch_millis=epoch_millis)
        rows.write.mode("overwrite").option("compression", codec).parquet(f"{path}/batch={batch_id}")

    return write


def remote_write_sink(
    chunk: str = "1 day",
    *,
    record_type: str = SAMPLE_TYPE,
    rejects: Sink | None = None,
    report: Callable[[dict], None] | None = None,
    **options: str,
) -> Sink:
    """A sink that assembles each micro-batch and sends it; options as for the data source.

    Only rows of ``record_type`` are sent. Those that lack a part of a sample go to ``rejects`` with ``error``. ``report``
    is told what happened: ``batch_id``, rows ``kept`` and ``dropped`` by type, ``incomplete`` rows, the newest
    instant sent (``last_ms``), how far it lies behind (``lag_ms``) and whether that is too far (``lagging``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..sinks.remote_write import sample_pieces

        typed, by_type = keep_type(batch, record_type)
        judged = series_row_errors(typed)
        error = F.col("_error")
        seen = Observation()
        newest = F.max(F.when(error.isNull(), F.unix_millis("ts")))
        judged = judged.observe(seen, F.count_if(error.isNotNull()).alias("incomplete"), newest.alias("last_ms"))
        # one table: assembly, rejects and counts all come from the same reading
        table = written(judged, "remote-write")
        good = table.where(error.isNull()).drop("_error")
        sample_pieces(assemble_series(good, chunk)).write.format("remote_write").options(**options).mode("append").save()
        if rejects is not None:
            rejects(table.where(error.isNotNull()).withColumnRenamed("_error", "error"), batch_id)
        if report is not None:
            last = seen.get["last_ms"]
            lag = None if last is None else int(time.time() * 1000) - last
            report({"batch_id": batch_id, **by_type.get, **seen.get, "lag_ms": lag, "lagging": lag is not None and lag > LAG_WARNING_MS})

    return write


def fan_out(batch: DataFrame, batch_id: int, sinks: Sequence[Sink], marks: str | None = None) -> None:
    """Write one micro-batch to every sink, computing it once.

    With ``marks`` (a folder in the shared store) each sink that has written the batch leaves a mark
    ``{marks}/sink={n}/batch={batch_id}``, ``n`` its place in ``sinks``; when the batch is run again after a
    failure, the sinks that have it are skipped, so a failing sink makes no other sink see a batch twice.
    """
    spark = batch.sparkSession
    batch.persist()
    try:
        for n, sink in enumerate(sinks):
            mark = f"{marks}/sink={n}/batch={batch_id}" if marks else None
            if mark and _exists(spark, mark):
                continue
            sink(batch, batch_id)
            if mark:
                _touch(spark, mark)
    finally:
        batch.unpersist()


def start_pipeline(
    samples: DataFrame,
    sinks: Sequence[Sink],
    checkpoint: str,
    *,
    control_path: str | None = None,
    trigger: dict | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Annotate a stream of samples and write it to all sinks.

    ``trigger`` is passed on, for example ``{"processingTime": "5 seconds"}``; the default takes
    what is there and stops. A sink that has written a micro-batch does not see it again when the batch is run
    anew after a failure (sinks are known by their place in ``sinks``). The intermediate tables of
    a micro-batch are removed once all sinks have written it; those that dead drivers left are swept first.
    """
    if not sinks:
        raise ValueError("at least one sink is needed")
    # which sink has written which batch, beside the stream's own checkpoint
    marks = f"{checkpoint.rstrip('/')}/sinks"

    def each(batch: DataFrame, batch_id: int) -> None:
        # the batch's intermediate tables live until all its sinks have written it
        # (annotate reads its input twice, so it is kept in memory for that; a source of few pieces is dealt to all
        # cores first, as annotation and sinks stay in its partitions)
        with lease(batch.sparkSession):
            if control_path is None:
                fan_out(batch, batch_id, sinks, marks)
                return
            rows = spread(batch).persist()
            try:
                fan_out(annotate(rows, read_control(batch.sparkSession, control_path)), batch_id, sinks, marks)
            finally:
                rows.unpersist()

    sweep_orphans(samples.sparkSession)

    writer = samples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_latency(
    df: DataFrame,
    sink: Sink,
    checkpoint: str,
    *,
    key: str,
    ts: str,
    elapsed_us: str,
    window: str = "10 seconds",
    watermark: str = "10 seconds",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Latency figures of every window once the watermark has passed it."""
    counts = latency_counts(df.withWatermark(ts, watermark), key=key, ts=ts, elapsed_us=elapsed_us, window=window)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(latency_figures(batch), batch_id)

    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
