"""The driver's tables, and their rows in the engine's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Whole milliseconds since the epoch of a timestamp with or without zone (session time zone UTC)."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def event_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as item writes: item_key (user_id), ts (ms), seq (event_id), value and k (props.k)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("item_key"),
        millis("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_type",
    )


def daily_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as five items: the cumulative count of each event type by day, one write a day."""
    from pyspark.sql import Window

    daily = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("item_key"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = Window.partitionBy("item_key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ts = F.unix_millis("day")
    return daily.select("item_key", ts.alias("ts"), ts.alias("seq"), F.sum("n").over(running).cast("double").alias("value"))


def hourly_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as five items: the count of each event type in each 6 h step."""
    step = F.lit(6 * 3_600_000)
    start = (F.floor(millis("ts") / step) * step).cast("long")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("item_key"), start.alias("ts"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .withColumn("seq", F.col("ts"))
    )


#: lineitem has no unique order of its own within (date, part): these columns together are unique.
TIE_BREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def lineitem_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as snapshots in long form: ts (ms of the ship date), item_id, price, quantity; the last row of an item and date wins."""
    order = F.struct(*TIE_BREAK)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(millis("l_shipdate").alias("ts"), F.col("l_partkey").alias("item_id"))
        .agg(F.max(order).alias("last"))
        .select("ts", "item_id", F.col("last.l_extendedprice").alias("price"), F.col("last.l_quantity").alias("quantity"))
    )


def order_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as keyed upserts: key (o_custkey), ts, seq (o_orderkey), price, status and priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"),
        millis("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
