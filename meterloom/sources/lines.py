"""Where text lines come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file as origin; breaks are LF, CR or CRLF."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))


def stream_lines(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """As :func:`read_lines` for files that keep arriving; the rate limit caps a micro-batch."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("_file"))


def kafka_lines(df: DataFrame) -> DataFrame:
    """Lines of a DataFrame loaded from Kafka (batch or stream)."""
    return df.select(F.col("value").cast("string").alias("value"))


def read_lines_after_header(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_lines` without the first line of each file.

    The CSV scan drops the header and leaves every other line whole: a line that holds the separator, which
    text hardly ever does, comes as the record that does not fit one column.
    """
    return _after_header(spark.read).csv(path).select(F.coalesce("_whole", "value").alias("value"), F.col("_metadata.file_path").alias("_file"))


def stream_lines_after_header(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """As :func:`read_lines_after_header` for files that keep arriving, each whole when it does."""
    reader = _after_header(spark.readStream)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path).select(F.coalesce("_whole", "value").alias("value"), F.col("_metadata.file_path").alias("_file"))


def _after_header(reader):
    options = {
        "header": True, "enforceSchema": True, "sep": "\x01", "quote": "", "escape": "", "comment": "", "mode": "PERMISSIVE",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "columnNameOfCorruptRecord": "_whole", "maxCharsPerColumn": -1,
        "nullValue": "\x01", "emptyValue": "",
    }
    return reader.options(**options).schema("value string, _whole string")


def stamp_origin(df: DataFrame, tag: str) -> DataFrame:
    """Set ``_inbound`` to ``inbound:<tag>`` where no earlier origin is known."""
    origin = F.lit(f"inbound:{tag}")
    if "_inbound" in df.columns:
        origin = F.coalesce("_inbound", origin)
    return df.withColumn("_inbound", origin)


def fan_in(*inputs: DataFrame) -> DataFrame:
    """All rows of several inputs; columns missing on one side are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, where their source gives fewer: few files, or large row groups.

    For what is narrow from here on, and would run on as many cores as the source has pieces.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
