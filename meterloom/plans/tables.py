"""The given tables, and the telemetry that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ntz_as_utc
from ..operators.samples import to_samples
from ..operators.series import label_pairs, labels_text
from ..sources.lines import spread
from ..specs import SeriesSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, with its zone-less times read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: ntz_as_utc(F.col(c)) for c in times})


def ms(c: Column | str) -> Column:
    return F.unix_millis(c)


def cents(c: Column | str) -> Column:
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("bigint")


def events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wide telemetry: labels user_id and event_type, values value and k."""
    return wide(table(spark, sf_dir, "events"))


def wide(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


EVENT_SPEC = SeriesSpec(labels=["user_id", "event_type"], values=["value", "counter:k"], timestamp="ts")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_samples(events_wide(spark, sf_dir), EVENT_SPEC)


LINE_SPEC = SeriesSpec(
    labels=["l_returnflag", "l_linestatus"], values=["l_extendedprice"], timestamp="l_shipdate"
)


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_samples(table(spark, sf_dir, "lineitem"), LINE_SPEC)


def map_text(labels: str = "labels") -> Column:
    """A label map as ``a=1,b=2``."""
    return labels_text(F.sort_array(F.map_entries(labels)).cast("array<struct<name:string,value:string>>"))


def order_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a control action on the day it was placed.

    The label is the order's priority, or one the line items carry themselves; very large orders
    clear everything.
    """
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.when(price > 499_000, "clear")
        .when(price > 490_000, "rename")
        .when(F.col("o_orderstatus") == "F", "set")
        .when(F.col("o_orderstatus") == "O", F.when(price < 150_000, "unset").otherwise("undelete"))
        .otherwise(F.when(price < 100_000, "delete").otherwise("set"))
        .alias("action"),
        F.when(price > 480_000, F.lit(None).cast("string"))
        .when(price < 20_000, "l_returnflag")
        .otherwise(F.col("o_orderpriority"))
        .alias("name"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.when(price > 50_000, F.col("o_orderstatus")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("value"),
    )


def event_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a control action at its own time; the label is its type."""
    k = F.col("k")
    return wide(spread(table(spark, sf_dir, "events"))).select(
        "ts",
        F.col("event_id").alias("seq"),
        F.when(k < 50, "set").when(k < 65, "unset").when(k < 80, "delete").when(k < 95, "undelete")
        .otherwise("clear").alias("action"),
        F.when(F.col("event_type") == "error", "event_type").otherwise(F.col("event_type")).alias("name"),
        k.cast("string").alias("value"),
    )


def many_names_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order sets a label of its own, unsets it a day later, and deletes another name for good."""
    orders = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.make_dt_interval(F.lit(1))
    actions = F.array(
        F.struct(F.col("o_orderdate").alias("ts"), (3 * key).alias("seq"), F.lit("set").alias("action"), F.concat(F.lit("o"), key).alias("name"), F.col("o_custkey").cast("string").alias("value")),
        F.struct((F.col("o_orderdate") + day).alias("ts"), (3 * key + 1).alias("seq"), F.lit("unset").alias("action"), F.concat(F.lit("o"), key).alias("name"), F.lit(None).cast("string").alias("value")),
        F.struct(F.col("o_orderdate").alias("ts"), (3 * key + 2).alias("seq"), F.lit("delete").alias("action"), F.concat(F.lit("d"), key).alias("name"), F.lit(None).cast("string").alias("value")),
    )
    return orders.select(F.inline(actions))
