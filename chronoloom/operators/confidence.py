"""Accuracy of signals from outcomes: totals, recent accuracy, calibration and flags with hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import scope

CORRECT = ("followed_success", "ignored_validated")
RECENT = 50


def judged(outcomes: DataFrame) -> DataFrame:
    """Outcomes (insight_id, insight_type, target, result, ts, seq) with scope and correct."""
    return outcomes.withColumns({"scope": scope(F.col("target")), "correct": F.col("result").isin(*CORRECT).cast("int")})


def accuracy_by_scope(outcomes: DataFrame) -> DataFrame:
    """total, correct, accuracy and calibration of each type and scope."""
    sums = judged(outcomes).groupBy("insight_type", "scope").agg(F.count(F.lit(1)).alias("total"), F.sum("correct").alias("correct"))
    accuracy = F.col("correct") / F.col("total")
    return sums.withColumns({"accuracy": accuracy, "calibration": F.least(F.lit(1.0), accuracy * 1.1)})


def recent_accuracy(outcomes: DataFrame, most: int = RECENT) -> DataFrame:
    """Accuracy over the last outcomes of each type and scope, in the order of each insight's first outcome and then of time."""
    first = F.min(F.struct("ts", "seq")).over(Window.partitionBy("insight_id"))
    rows = judged(outcomes).withColumn("first", first)
    newest = Window.partitionBy("insight_type", "scope").orderBy(F.desc("first"), F.desc("ts"), F.desc("seq"))
    kept = rows.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= most)
    return kept.groupBy("insight_type", "scope").agg(F.avg("correct").alias("recent_accuracy"), F.count(F.lit(1)).alias("n"))


def flag_history(outcomes: DataFrame) -> DataFrame:
    """After each outcome: total, accuracy, disabled and high_reliability of its type and scope.

    A flag keeps its state between the threshold that sets it and the one that clears it.
    """
    upto = Window.partitionBy("insight_type", "scope").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged(outcomes).withColumn("total", F.count(F.lit(1)).over(upto)).withColumn("accuracy", F.avg("correct").over(upto))
    off = F.when((F.col("accuracy") < 0.3) & (F.col("total") >= 10), True).when(F.col("accuracy") >= 0.5, False)
    sure = F.when((F.col("accuracy") > 0.95) & (F.col("total") > 50), True).when(F.col("accuracy") <= 0.9, False)
    rows = rows.withColumns({"_off": off, "_sure": sure})
    return rows.select(
        "insight_type", "scope", "ts", "seq", "total", "accuracy",
        F.coalesce(F.last("_off", ignorenulls=True).over(upto), F.lit(False)).alias("disabled"),
        F.coalesce(F.last("_sure", ignorenulls=True).over(upto), F.lit(False)).alias("high_reliability"),
    )


def confidence_flags(outcomes: DataFrame) -> DataFrame:
    """The flags of each type and scope after its last outcome."""
    at = F.struct("ts", "seq")
    state = F.struct("total", "accuracy", "disabled", "high_reliability")
    return flag_history(outcomes).groupBy("insight_type", "scope").agg(F.max_by(state, at).alias("s")).select("insight_type", "scope", "s.*")


def confidence(outcomes: DataFrame) -> DataFrame:
    """All of the above, a row a type and scope."""
    keys = ["insight_type", "scope"]
    flags = confidence_flags(outcomes).select(*keys, "disabled", "high_reliability")
    return accuracy_by_scope(outcomes).join(recent_accuracy(outcomes).select(*keys, "recent_accuracy"), keys).join(flags, keys)
