"""Parquet and JSON output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.text import datetime_text, is_number_struct, ntz_as_utc

# Codecs a stock Spark can write, and those it knows but has no library for.
CODECS = ("snappy", "gzip", "zstd", "none")
MISSING_CODECS = ("lzo", "brotli")

MAX_RECORDS_PER_FILE = 5_000_000


def check_codec(codec: str) -> str:
    codec = codec.lower()
    if codec in MISSING_CODECS:
        raise ValueError(f"codec {codec!r} needs a library that Spark does not ship; use one of {CODECS}")
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}; use one of {CODECS}")
    return codec


def file_rows(df: DataFrame, *, epoch_millis: bool = False) -> DataFrame:
    """What goes into a file: without bookkeeping columns, instants as milliseconds if asked."""
    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if epoch_millis and isinstance(f.dataType, T.TimestampType):
            c = F.unix_millis(c)
        elif epoch_millis and isinstance(f.dataType, T.TimestampNTZType):
            c = F.unix_millis(ntz_as_utc(c))
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema if not f.name.startswith("_")])


def write_parquet(
    df: DataFrame,
    path: str,
    *,
    codec: str = "snappy",
    mode: str = "append",
    partition_by: Sequence[str] = (),
    epoch_millis: bool = False,
    max_records_per_file: int = MAX_RECORDS_PER_FILE,
) -> None:
    """Write Parquet files under ``path``.

    With ``partition_by`` rows are not shuffled first: a hot partition value would then land in
    one task. Each task writes the values it holds.
    """
    writer = (
        file_rows(df, epoch_millis=epoch_millis)
        .write.mode(mode)
        .option("compression", check_codec(codec))
        .option("maxRecordsPerFile", max_records_per_file)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def stream_parquet(
    df: DataFrame, path: str, checkpoint: str, *, codec: str = "snappy", epoch_millis: bool = False
) -> DataStreamWriter:
    """A stream writer of Parquet files; set a trigger and start it."""
    return (
        file_rows(df, epoch_millis=epoch_millis)
        .writeStream.format("parquet")
        .option("path", path)
        .option("compression", check_codec(codec))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


# Bookkeeping columns and the keys they take in a JSON record.
ATTRIBUTE_KEYS = {"_id": "__id__", "_inbound": "__inbound__", "_type": "__type__"}


def to_json_records(df: DataFrame, *, column: str = "json") -> DataFrame:
    """Each row as a JSON object in one text column.

    NaN is null, infinities are text, instants are their display text and units are dropped.
    NULL fields are written as null.
    """
    fields = []
    for f in df.schema:
        if f.name.startswith("_") and f.name not in ATTRIBUTE_KEYS:
            continue
        fields.append(_json_value(F.col(f"`{f.name}`"), f.dataType).alias(ATTRIBUTE_KEYS.get(f.name, f.name)))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))


def _json_value(c: Column, dt: T.DataType) -> Column:
    if is_number_struct(dt):
        return _json_value(c["value"], dt["value"].dataType)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dt, T.TimestampType):
        return datetime_text(c)
    if isinstance(dt, T.TimestampNTZType):
        return datetime_text(ntz_as_utc(c))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _json_value(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _, v: _json_value(v, dt.valueType))
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_json_value(c[f.name], f.dataType).alias(f.name) for f in dt]))
    return c
