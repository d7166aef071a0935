"""Row shapes shared by the operators."""

from pyspark.sql import types as T

SAMPLE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("metric_type", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_inbound", T.StringType()),
    T.StructField("_type", T.StringType()),
])

CONTROL_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])
