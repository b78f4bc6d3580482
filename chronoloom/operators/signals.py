"""Anomalies, forecasts and recommendations from behaviour and trends.

Ids are digests of what a signal is about, so that running again gives the same ids and duplicates can be found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import scalar
from chronoloom.operators.behavior import trend_history

Z_THRESHOLD = 2.0
TTL_MS = 24 * scalar.HOUR_MS
HISTORY_CAP = 1000
#: What an outcome of each type of recommendation counts for.
OUTCOME_TYPES = {"alert": "anomaly", "promote": "recommendation", "demote": "recommendation", "investigate": "recommendation"}


def anomalies(writes: DataFrame, fields: list[str], key: str = "item_key", threshold: float = Z_THRESHOLD) -> DataFrame:
    """Writes whose field's z-score, that write included, reaches the threshold: key, field, ts, seq, expected, actual, z_score, severity."""
    return (
        trend_history(writes, fields, key)
        .where(F.abs("z_score") >= threshold)
        .select(key, "field", "ts", "seq", F.col("ema").alias("expected"), F.col("last").alias("actual"), "z_score", scalar.severity(F.col("z_score")).alias("severity"))
    )


def anomalies_per_write(writes: DataFrame, fields: list[str], key: str = "item_key", threshold: float = Z_THRESHOLD) -> DataFrame:
    """As anomalies, with fields that a write does not hold judged by their trend so far, as each write re-reports them: actual is then the average."""
    from pyspark.sql import Window

    history = trend_history(writes, fields, key)
    every = writes.select(key, "ts", "seq", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    upto = Window.partitionBy(key, "field").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = every.join(history.select(key, "field", "ts", "seq", "last", F.struct("ema", "z_score").alias("t")), [key, "field", "ts", "seq"], "left")
    held = joined.withColumn("t", F.last("t", ignorenulls=True).over(upto)).where(F.abs("t.z_score") >= threshold)
    return held.select(
        key, "field", "ts", "seq", F.col("t.ema").alias("expected"), F.coalesce("last", "t.ema").alias("actual"), F.col("t.z_score").alias("z_score"),
        scalar.severity(F.col("t.z_score")).alias("severity"),
    )


def latest_anomalies(found: DataFrame, since: int | None = None, cap: int = HISTORY_CAP) -> DataFrame:
    """The newest anomalies, cap at most, as the history report shows them."""
    if since is not None:
        found = found.where(F.col("ts") >= since)
    return found.orderBy(F.desc("ts"), F.desc("seq"), "field").limit(cap)


def _signal(df: DataFrame, kind: str, key: str, confidence, basis, message, extra: list[str] | None = None) -> DataFrame:
    at = F.col("last_ts") if "last_ts" in df.columns else F.col("ts")
    named = F.concat_ws("|", key, at.cast("string"), F.lit(kind), basis)
    return df.select(
        F.sha2(named, 256).alias("insight_id"), F.col(key).alias("target"), F.lit(kind).alias("type"), confidence.cast("double").alias("confidence"),
        basis.alias("basis"), message.alias("message"), at.alias("ts"), (at + TTL_MS).alias("expires_at"), *(extra or []),
    )


def alerts(found: DataFrame, key: str = "item_key") -> DataFrame:
    """An alert for each anomaly."""
    z = F.col("z_score")
    out = _signal(
        found, "alert", key, F.least(F.lit(1.0), F.abs(z) / 5), F.concat(F.lit("anomaly."), F.col("field")),
        F.format_string('Anomaly on field "%s": z-score %.2f, severity %s', F.col("field"), z, F.col("severity")), ["field", "seq", key],
    )
    return out


def behavior_recommendations(behavior: DataFrame, key: str = "item_key", extra: list[str] | None = None) -> DataFrame:
    """promote, demote and investigate by lifecycle, velocity and streak; extra columns come along."""
    v, streak = F.col("velocity"), F.col("streak")
    lifecycle = F.col("lifecycle")
    rules = [
        (lifecycle.eqNullSafe("active") & (v > 2), "promote", F.least(F.lit(1.0), v / 5), "lifecycle.active", F.format_string("High velocity: %.2f writes an hour", v)),
        (lifecycle.eqNullSafe("declining"), "demote", F.lit(0.6), "lifecycle.declining", F.lit("Declining activity")),
        (lifecycle.eqNullSafe("resurrected"), "investigate", F.lit(0.8), "lifecycle.resurrected", F.lit("Active again after a long silence")),
        (F.abs(streak) >= 5, "investigate", F.least(F.lit(1.0), F.abs(streak) / 20.0), "streak", F.format_string("Streak of %d changes", streak)),
    ]
    # one pass over behaviour: each row explodes into the rules it meets
    met = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(k).alias("type"), p.cast("double").alias("confidence"), F.lit(b).alias("basis"), m.alias("message"))) for c, k, p, b, m in rules])
    )
    at = F.col("last_ts")
    return behavior.select(key, at, *(extra or []), F.explode(met).alias("r")).select(
        F.sha2(F.concat_ws("|", key, at.cast("string"), "r.type", "r.basis"), 256).alias("insight_id"),
        F.col(key).alias("target"), "r.type", "r.confidence", "r.basis", "r.message", at.alias("ts"), (at + TTL_MS).alias("expires_at"), *(extra or []),
    )


def recommendations(writes: DataFrame, fields: list[str], behavior: DataFrame, key: str = "item_key") -> DataFrame:
    """Alerts and behaviour recommendations together."""
    common = ["insight_id", "target", "type", "confidence", "basis", "message", "ts", "expires_at"]
    parts = [alerts(anomalies(writes, fields, key), key).select(*common), behavior_recommendations(behavior, key).select(*common)]
    return reduce(DataFrame.unionByName, parts)


def select_recommendations(recs: DataFrame, as_of: int | None = None, type_is: str | None = None, target: str | None = None) -> DataFrame:
    """Those that have not expired at as_of, by filter, most confident first."""
    if as_of is not None:
        recs = recs.where(F.col("expires_at") >= as_of)
    if type_is is not None:
        recs = recs.where(F.col("type") == type_is)
    if target is not None:
        recs = recs.where(F.col("target") == target)
    return recs.orderBy(F.desc("confidence"), "insight_id")


def forecast(trends: DataFrame, horizon: int = 5, key: str = "item_key") -> DataFrame:
    """Each field's value horizon steps on, with a confidence that decays."""
    h = F.lit(horizon)
    return trends.select(
        key, "field", F.col("ema").alias("current_value"),
        scalar.forecast(F.col("ema"), F.col("direction"), F.col("magnitude"), F.col("min"), F.col("max"), h).alias("projected_value"),
        h.alias("horizon"), scalar.forecast_confidence(F.col("min"), F.col("max"), h).alias("confidence"), F.lit("ema").alias("basis"),
    )


def outcomes_with_recommendations(outcomes: DataFrame, recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes joined with what they answer (insight_type, target), and outcomes of unknown ids."""
    pairs = [F.lit(x) for pair in OUTCOME_TYPES.items() for x in pair]
    known = recs.select("insight_id", "target", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("type")), F.lit("recommendation")).alias("insight_type"))
    return outcomes.join(known, "insight_id"), outcomes.join(known, "insight_id", "left_anti")
