"""Queries of per-item behaviour, trends and signals over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import behavior, persistence, signals
from chronoloom.plans.registry import WRITES_SQL, query
from chronoloom.sources.tables import event_writes

FIELDS = ["value", "k"]
#: Averages of short decimals often lie exactly between two roundings; a nudge on both sides makes the last bit not matter.
NUDGE = 1e-10
#: A moment ten days after the first event: some items have been silent since.
AS_OF = 1_704_067_200_000 + 100 * 86_400_000

#: The fold in SQL is a list reduced in order, independent of the weighted sums on the Spark side.
BEHAVIOR_SQL = f"""
WITH {WRITES_SQL}
g AS (SELECT *, row_number() OVER o AS place, CASE WHEN lag(ts) OVER o IS NOT NULL THEN greatest(1, ts - lag(ts) OVER o) END AS dt,
             coalesce(value - lag(value) OVER o, 0) + coalesce(k - lag(k) OVER o, 0) AS delta
      FROM w WINDOW o AS (PARTITION BY item_key ORDER BY ts, seq)),
nz AS (SELECT *, CAST(sign(delta) AS INT) AS s, row_number() OVER (PARTITION BY item_key ORDER BY ts, seq) AS i,
              row_number() OVER (PARTITION BY item_key ORDER BY ts DESC, seq DESC) AS back
       FROM g WHERE delta <> 0),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY item_key, s ORDER BY ts, seq) AS island FROM nz),
lengths AS (SELECT item_key, s, island, count(*) AS len, min(back) AS back FROM runs GROUP BY ALL),
streaks AS (SELECT item_key, max(len) AS streak_record, min_by(s * len, back) AS streak FROM lengths GROUP BY item_key),
ent AS (SELECT item_key, count(*) FILTER (s > 0) AS up, count(*) FILTER (s < 0) AS down FROM nz WHERE back <= 32 GROUP BY item_key),
v AS (SELECT item_key, count(*) AS write_count, min(ts) AS first_ts, max(ts) AS last_ts, max_by(dt, place) AS gap,
             list_reduce(list(CASE WHEN place = 1 THEN CAST(1 AS DOUBLE) ELSE 3600000 / CAST(dt AS DOUBLE) END ORDER BY ts, seq),
                         lambda a, x: CAST(0.35 AS DOUBLE) * x + CAST(0.65 AS DOUBLE) * a) AS velocity,
             coalesce(stddev_samp(dt), 0) AS volatility
      FROM g GROUP BY item_key),
b AS (SELECT v.*, coalesce(streak, 0) AS streak, coalesce(streak_record, 0) AS streak_record,
             CASE WHEN up > 0 AND down > 0 THEN -(up / (up + down)) * log2(up / (up + down)) - (down / (up + down)) * log2(down / (up + down)) ELSE 0 END AS entropy
      FROM v LEFT JOIN streaks USING (item_key) LEFT JOIN ent USING (item_key))
"""
CLASS_SQL = """CASE WHEN {inactive} > 30 * 86400000::BIGINT THEN 'dead' WHEN {inactive} > 7 * 86400000::BIGINT THEN 'dormant'
  WHEN velocity > 0.5 THEN CASE WHEN {n} < 10 THEN 'emerging' ELSE 'active' END WHEN velocity < 0.05 THEN 'declining' ELSE 'stable' END"""
LIFECYCLE_SQL = f"CASE WHEN write_count = 1 THEN 'emerging' WHEN gap > 30 * 86400000::BIGINT THEN 'resurrected' ELSE {CLASS_SQL.format(inactive='0', n='write_count')} END"


def _behavior(spark: SparkSession, sf_dir: str, as_of: int | None = None) -> DataFrame:
    return behavior.item_behavior(event_writes(spark, sf_dir), FIELDS, as_of=as_of)


@query(
    BEHAVIOR_SQL
    + f"""SELECT item_key, write_count, first_ts, last_ts, round(velocity, 4) AS velocity, round(volatility, 3) AS volatility,
       round(entropy, 6) AS entropy, streak, streak_record, {LIFECYCLE_SQL} AS lifecycle FROM b"""
)
def item_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behavior(spark, sf_dir).withColumns(
        {"velocity": F.round("velocity", 4), "volatility": F.round("volatility", 3), "entropy": F.round("entropy", 6)}
    )


@query(BEHAVIOR_SQL + "SELECT item_key, round(velocity, 4) AS velocity FROM b")
def item_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behavior(spark, sf_dir).select("item_key", F.round("velocity", 4).alias("velocity"))


@query(BEHAVIOR_SQL + "SELECT item_key, round(volatility, 3) AS volatility FROM b")
def item_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behavior(spark, sf_dir).select("item_key", F.round("volatility", 3).alias("volatility"))


@query(BEHAVIOR_SQL + "SELECT item_key, round(entropy, 6) AS entropy FROM b")
def item_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behavior(spark, sf_dir).select("item_key", F.round("entropy", 6).alias("entropy"))


@query(BEHAVIOR_SQL + "SELECT item_key, streak, streak_record FROM b")
def item_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behavior(spark, sf_dir).select("item_key", "streak", "streak_record")


@query(BEHAVIOR_SQL + f"SELECT item_key, {CLASS_SQL.format(inactive=f'({AS_OF} - last_ts)', n='write_count')} AS lifecycle FROM b")
def item_lifecycle_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behavior(spark, sf_dir, AS_OF).select("item_key", "lifecycle")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with the place that their order gives them, as a report numbers its lines."""
    marked = rows.withColumn("_m", F.monotonically_increasing_id())
    return marked.withColumn("place", F.row_number().over(Window.orderBy("_m"))).drop("_m")


@query(
    BEHAVIOR_SQL
    + f"""SELECT item_key, last_ts, write_count, CAST(row_number() OVER (ORDER BY last_ts DESC, item_key) AS INT) AS place FROM b
      WHERE {LIFECYCLE_SQL} = 'stable' AND last_ts >= {AS_OF - 90 * 86_400_000}"""
)
def insights_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = behavior.insights(_behavior(spark, sf_dir), lifecycle_is="stable", since=AS_OF - 90 * 86_400_000)
    return _placed(found.select("item_key", "last_ts", "write_count"))


@query(BEHAVIOR_SQL + f"SELECT '_insight/behavior/' || item_key AS key, write_count, round(velocity, 4) AS velocity, {LIFECYCLE_SQL} AS lifecycle FROM b")
def insight_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _behavior(spark, sf_dir)
    records = persistence.to_records(found, "behavior")
    back = persistence.from_records(records, "behavior", found)  # what is written comes back whole
    named = F.concat(F.lit("_insight/behavior/"), F.col("item_key")).alias("key")
    return back.select(named, "write_count", F.round("velocity", 4).alias("velocity"), "lifecycle")


HISTORY_SQL = f"""
WITH {WRITES_SQL}
x AS (SELECT item_key, ts, seq, 'value' AS field, value AS x FROM w WHERE value IS NOT NULL
      UNION ALL SELECT item_key, ts, seq, 'k', k FROM w WHERE k IS NOT NULL),
r AS (SELECT item_key, field, ts, seq, x AS last, count(*) OVER o AS n, avg(x) OVER o AS mean, stddev_samp(x) OVER o AS sd,
             min(x) OVER o AS lo, max(x) OVER o AS hi,
             list_reduce(list(x) OVER o, lambda a, b: CAST(0.3 AS DOUBLE) * b + CAST(0.7 AS DOUBLE) * a) AS ema
      FROM x WINDOW o AS (PARTITION BY item_key, field ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT item_key, field, ts, seq, n, last, ema, lo AS min, hi AS max,
             CASE WHEN sd > 0 THEN (last - mean) / sd ELSE 0 END AS z_score,
             CASE WHEN last > ema * 1.005 THEN 'up' WHEN last < ema * 0.995 THEN 'down' ELSE 'flat' END AS direction,
             CASE WHEN hi > lo THEN abs(last - ema) / (hi - lo) ELSE 0 END AS magnitude
      FROM r),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY item_key, field ORDER BY ts DESC, seq DESC) = 1)
"""
TREND_COLUMNS = "n, last, round(ema + 1e-10, 6) AS ema, min, max, round(z_score + 1e-10, 6) AS z_score, direction, round(magnitude + 1e-10, 6) AS magnitude"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + NUDGE, 6) for c in columns})


@query(HISTORY_SQL + f"SELECT item_key, field, {TREND_COLUMNS} FROM f")
def field_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(behavior.field_trends(event_writes(spark, sf_dir), FIELDS), "ema", "z_score", "magnitude")


@query(HISTORY_SQL + f"SELECT item_key, field, ts, seq, {TREND_COLUMNS} FROM h")
def trend_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(behavior.trend_history(event_writes(spark, sf_dir), FIELDS), "ema", "z_score", "magnitude")


SEVERITY_SQL = "CASE WHEN abs(z_score) >= 4 THEN 'critical' WHEN abs(z_score) >= 3 THEN 'high' WHEN abs(z_score) >= 2.5 THEN 'medium' ELSE 'low' END"


@query(
    HISTORY_SQL
    + f"""SELECT item_key, field, ts, seq, round(ema + 1e-10, 6) AS expected, last AS actual, round(z_score + 1e-10, 6) AS z_score, {SEVERITY_SQL} AS severity
      FROM h WHERE abs(z_score) >= 2"""
)
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.anomalies(event_writes(spark, sf_dir), FIELDS)
    return _rounded(found, "expected", "z_score")


@query(
    HISTORY_SQL
    + """SELECT item_key, field, seq, 'alert' AS type, round(least(1, abs(z_score) / 5) + 1e-10, 6) AS confidence, ts + 86400000 AS expires_at
      FROM h WHERE abs(z_score) >= 2"""
)
def anomaly_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.alerts(signals.anomalies(event_writes(spark, sf_dir), FIELDS))
    return _rounded(found.select("item_key", "field", "seq", "type", "confidence", "expires_at"), "confidence")


@query(
    HISTORY_SQL
    + """SELECT item_key, field, round(ema + 1e-10, 6) AS current_value,
      round(ema + CASE direction WHEN 'up' THEN magnitude WHEN 'down' THEN -magnitude ELSE 0 END * (max - min) * 5 + 1e-10, 6) AS projected_value,
      5 AS horizon, round(CASE WHEN max <> min THEN 0.8 ELSE 0.3 END * exp(-0.5) + 1e-10, 6) AS confidence, 'ema' AS basis FROM f"""
)
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    trends = behavior.field_trends(event_writes(spark, sf_dir), FIELDS)
    return _rounded(signals.forecast(trends, 5), "current_value", "projected_value", "confidence")


RECOMMEND_SQL = (
    BEHAVIOR_SQL
    + f""", s AS (SELECT *, {LIFECYCLE_SQL} AS lifecycle FROM b)
SELECT item_key AS target, 'promote' AS type, round(least(1, velocity / 5) + 1e-10, 6) AS confidence, 'lifecycle.active' AS basis FROM s WHERE lifecycle = 'active' AND velocity > 2
UNION ALL SELECT item_key, 'demote', round(0.6 + 1e-10, 6), 'lifecycle.declining' FROM s WHERE lifecycle = 'declining'
UNION ALL SELECT item_key, 'investigate', round(0.8 + 1e-10, 6), 'lifecycle.resurrected' FROM s WHERE lifecycle = 'resurrected'
UNION ALL SELECT item_key, 'investigate', round(least(1, abs(streak) / 20) + 1e-10, 6), 'streak' FROM s WHERE abs(streak) >= 5"""
)


@query(RECOMMEND_SQL)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.behavior_recommendations(_behavior(spark, sf_dir))
    return _rounded(found.select("target", "type", "confidence", "basis"), "confidence")


@query(
    f"""WITH {WRITES_SQL}
g AS (SELECT *, row_number() OVER o AS place, CASE WHEN lag(ts) OVER o IS NOT NULL THEN greatest(1, ts - lag(ts) OVER o) END AS dt
      FROM w WINDOW o AS (PARTITION BY item_key ORDER BY ts, seq)),
v AS (SELECT *, list_reduce(list(CASE WHEN place = 1 THEN CAST(1 AS DOUBLE) ELSE 3600000 / CAST(dt AS DOUBLE) END) OVER o,
                            lambda a, x: CAST(0.35 AS DOUBLE) * x + CAST(0.65 AS DOUBLE) * a) AS velocity
      FROM g WINDOW o AS (PARTITION BY item_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, CASE WHEN place = 1 THEN 'emerging' WHEN dt > 30 * 86400000::BIGINT THEN 'resurrected' ELSE {CLASS_SQL.format(inactive='0', n='place')} END AS lifecycle FROM v),
p AS (SELECT *, lag(lifecycle) OVER (PARTITION BY item_key ORDER BY ts, seq) AS from_state FROM l)
SELECT item_key, ts, seq, from_state, lifecycle AS to_state FROM p WHERE from_state <> lifecycle"""
)
def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.lifecycle_transitions(event_writes(spark, sf_dir))


@query(
    f"""WITH {WRITES_SQL}
g AS (SELECT *, row_number() OVER o AS place, CASE WHEN lag(ts) OVER o IS NOT NULL THEN greatest(1, ts - lag(ts) OVER o) END AS dt
      FROM w WHERE event_type = 'view' WINDOW o AS (PARTITION BY item_key ORDER BY ts, seq))
SELECT item_key, count(*) AS read_count, max(ts) AS last_read,
       round(list_reduce(list(CASE WHEN place = 1 THEN CAST(1 AS DOUBLE) ELSE 3600000 / CAST(dt AS DOUBLE) END ORDER BY ts, seq),
             lambda a, x: CAST(0.35 AS DOUBLE) * x + CAST(0.65 AS DOUBLE) * a, CAST(0 AS DOUBLE)), 4) AS access_frequency
FROM g GROUP BY item_key"""
)
def access_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = event_writes(spark, sf_dir).where("event_type = 'view'")
    return behavior.access_frequency(reads).withColumn("access_frequency", F.round("access_frequency", 4))
