"""Ranks over all rows without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.sources.workspace import materialize


def ranked(distinct: DataFrame, column: str, name: str, first: int = 0) -> DataFrame:
    """column with its place (long, from first) in ascending order among the distinct values.

    Values are dealt by range and ranked within ranges; ranks are shifted by what lies in earlier ranges, whose number is
    that of the shuffle's partitions.
    """
    placed = distinct.select(column).repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    held = materialize(placed, "ranges")
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return held.withColumn("_r", within).join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_r") + first).cast("long").alias(name))


def placed(rows: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """rows with their place (long, from 0) among those of their group, in an order that tells all of them apart.

    Rows are dealt by range of group and order, so one large group lies in many ranges; what is gathered is a count for
    each range and group.
    """
    by = [group, *order]
    held = materialize(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "placed-ranges")
    sizes = held.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1
    out = held.withColumn("_r", within).join(before, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.select(*rows.columns, (F.col("_before") + F.col("_r")).cast("long").alias(name))
