"""Queries of archives, the keyed store, confidence and schema inference over lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom import model
from chronoloom.operators import blocks, confidence, store
from chronoloom.plans.registry import WRITES_SQL, query
from chronoloom.sources import archive
from chronoloom.sources.tables import event_writes, lineitem_snapshots, order_writes, table
from chronoloom.sources.workspace import materialize, work_path

SNAPSHOTS_SQL = """
li AS (SELECT epoch_us(l_shipdate) // 1000 AS ts, l_partkey AS item_id, l_extendedprice AS price, l_quantity AS quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_shipdate, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1),
sn AS (SELECT dense_rank() OVER (ORDER BY ts) - 1 AS snapshot_seq, * FROM li)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.with_snapshot_seq(lineitem_snapshots(spark, sf_dir))


_KEPT: dict[tuple[str, str], archive.Archive] = {}


def archived(spark: SparkSession, sf_dir: str) -> archive.Archive:
    """The archive of a folder's lineitem: written once an application, then queried, as archives are."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _KEPT:
        _KEPT[at] = new_archive(spark, sf_dir)
    return _KEPT[at]


def new_archive(spark: SparkSession, sf_dir: str) -> archive.Archive:
    """lineitem's snapshots, written as an archive in two batches."""
    rows = materialize(snapshots(spark, sf_dir), "snapshots")
    a = archive.Archive(spark, work_path(spark, "archive"))
    middle = 1200
    a.append(rows.where(F.col("snapshot_seq") < middle))
    a.append(rows.where(F.col("snapshot_seq") >= middle))
    return a


@query(f"WITH {SNAPSHOTS_SQL} SELECT snapshot_seq, ts, item_id, price, quantity FROM sn")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, check and read: the whole way, anew."""
    return new_archive(spark, sf_dir).rows().select("snapshot_seq", "ts", "item_id", "price", "quantity")


@query(f"WITH {SNAPSHOTS_SQL} SELECT snapshot_seq, ts, item_id, price, quantity FROM sn WHERE snapshot_seq IN (SELECT snapshot_seq FROM sn WHERE item_id = 7)")
def snapshot_query_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).query(7).select("snapshot_seq", "ts", "item_id", "price", "quantity")


@query(f"WITH {SNAPSHOTS_SQL} SELECT ts, price, quantity FROM sn WHERE item_id = 7")
def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).item(7).select("ts", "price", "quantity")


@query(f"WITH {SNAPSHOTS_SQL} SELECT snapshot_seq, ts, CAST(count(*) AS INT) AS n_items FROM sn GROUP BY ALL")
def snapshot_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).snapshots().select("snapshot_seq", "ts", "n_items")


@query(
    f"""WITH RECURSIVE {SNAPSHOTS_SQL}, n AS (SELECT snapshot_seq, count(*) AS n_items FROM sn GROUP BY snapshot_seq),
    r(snapshot_seq, n_items, segment, held) AS (
      SELECT snapshot_seq, n_items, CAST(0 AS BIGINT), 12 + 12 * n_items FROM n WHERE snapshot_seq = 0
      UNION ALL SELECT n.snapshot_seq, n.n_items, CASE WHEN held >= 20000 THEN segment + 1 ELSE segment END,
             CASE WHEN held >= 20000 THEN 0 ELSE held END + 12 + 12 * n.n_items FROM r JOIN n ON n.snapshot_seq = r.snapshot_seq + 1)
    SELECT snapshot_seq, n_items, segment FROM r"""
)
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.segment_ids(archive.snapshot_table(snapshots(spark, sf_dir)), 20_000)


@query(
    f"""WITH {SNAPSHOTS_SQL}, f AS (SELECT count(DISTINCT snapshot_seq) AS n_snapshots, count(DISTINCT item_id) AS n_items, count(*) AS n FROM sn)
    SELECT n_snapshots, n_items, n_snapshots > 1 AND n_items > 1 AND n = n_snapshots * n_items AS eligible FROM f"""
)
def item_major_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.item_major(snapshots(spark, sf_dir))


@query(
    f"""WITH {SNAPSHOTS_SQL}, s AS (SELECT item_id, min(price) AS min, max(price) AS max, avg(price) AS avg, coalesce(stddev_samp(price), 0) AS volatility,
      min_by(price, ts) AS first, max_by(price, ts) AS last FROM sn GROUP BY item_id)
    SELECT item_id, min, max, round(avg, 8) AS avg, round(volatility, 4) AS volatility, first, last,
           CASE WHEN last > first THEN 'up' WHEN last < first THEN 'down' ELSE 'stable' END AS trend, round((last - first) * 100 / abs(first), 6) AS trend_percent FROM s"""
)
def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive.item_stats(snapshots(spark, sf_dir))
    return found.withColumns({"avg": F.round("avg", 8), "volatility": F.round("volatility", 4), "trend_percent": F.round("trend_percent", 6)})


@query(
    f"""WITH {SNAPSHOTS_SQL}, p AS (SELECT *, lag(price) OVER w AS was, lag(quantity) OVER w AS wasq, lag(snapshot_seq) OVER w AS before, lead(snapshot_seq) OVER w AS next,
                 (SELECT max(snapshot_seq) FROM sn) AS last_seq FROM sn WINDOW w AS (PARTITION BY item_id ORDER BY snapshot_seq))
    SELECT snapshot_seq, item_id, CASE WHEN before IS NULL OR before < snapshot_seq - 1 THEN 'added' ELSE 'changed' END AS change, price, quantity FROM p
    WHERE before IS NULL OR before < snapshot_seq - 1 OR price <> was OR quantity <> wasq
    UNION ALL SELECT snapshot_seq + 1, item_id, 'removed', NULL, NULL FROM p WHERE coalesce(next, last_seq + 1) > snapshot_seq + 1 AND snapshot_seq < last_seq"""
)
def snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.snapshot_deltas(snapshots(spark, sf_dir))


@query(
    f"""WITH {SNAPSHOTS_SQL}, f AS (SELECT count(*) AS n, count(DISTINCT snapshot_seq) AS k FROM sn)
    SELECT 'data' AS part, true AS valid, true AS chained, n AS n_rows FROM f UNION ALL SELECT 'snapshots', true, true, k FROM f"""
)
def verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part of an archive: whether every file's digest and the chain hold, and the rows that its files have."""
    a = archived(spark, sf_dir)
    part = F.substring_index("file", "/", 1).alias("part")
    checked = a.manifest.checks().groupBy(part).agg(F.bool_and("valid").alias("valid"))
    counted = a.rows().agg(F.lit("data").alias("part"), F.count(F.lit(1)).alias("n_rows")).union(a.snapshots().agg(F.lit("snapshots"), F.count(F.lit(1))))
    return checked.withColumn("chained", F.lit(a.manifest.chain_holds(a.manifest.entries()))).join(counted, "part")


@query(f"WITH {SNAPSHOTS_SQL} SELECT snapshot_seq, ts, item_id, price FROM sn WHERE item_id IN (7, 11, 400) AND (snapshot_seq < 900 OR snapshot_seq >= 1300)")
def filtered_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several items within two ranges of time, from the files that can hold them."""
    a = archived(spark, sf_dir)
    edge = {r["snapshot_seq"]: r["ts"] for r in a.snapshots().where("snapshot_seq IN (899, 1300)").collect()}
    found = a.select([7, 11, 400], [(None, edge[899]), (edge[1300], None)])
    return found.select("snapshot_seq", "ts", "item_id", "price")


@query(
    f"""WITH {SNAPSHOTS_SQL}, p AS (SELECT snapshot_seq, ts, item_id, quantity, lag(quantity) OVER (PARTITION BY item_id ORDER BY ts) AS was FROM sn WHERE item_id IN (7, 11, 400))
    SELECT snapshot_seq, ts, item_id, quantity FROM p WHERE was IS DISTINCT FROM quantity"""
)
def sparse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).sparse([7, 11, 400], ["quantity"], changed_only=True)


@query(f"WITH {SNAPSHOTS_SQL} SELECT 2 AS batches, count(*) AS rows, count(DISTINCT snapshot_seq) AS snapshots, min(ts) AS first_ts, max(ts) AS last_ts FROM sn")
def archive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).statistics().select("batches", "rows", "snapshots", "first_ts", "last_ts")


@query(f"WITH {SNAPSHOTS_SQL} SELECT 1 AS dropped, min(ts) AS first_ts, count(*) AS rows FROM sn WHERE snapshot_seq >= 1200")
def file_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retention policy of one batch: the older one goes."""
    a = new_archive(spark, sf_dir)
    due = a.due_for_rotation(now=0, max_batches=1)
    a.drop_batches(due)
    return a.rows().agg(F.lit(len(due)).alias("dropped"), F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("rows"))


STATS_SQL = f"""WITH {SNAPSHOTS_SQL}, s AS (SELECT item_id, min_by(price, ts) AS first, max_by(price, ts) AS last FROM sn GROUP BY item_id),
g AS (SELECT item_id, round((last - first) * 100 / abs(first), 6) AS trend_percent FROM s)"""


@query(
    STATS_SQL
    + """, up AS (SELECT 'gainer' AS kind, item_id, trend_percent FROM g WHERE trend_percent > 0 ORDER BY trend_percent DESC, item_id LIMIT 10),
      down AS (SELECT 'loser', item_id, trend_percent FROM g WHERE trend_percent < 0 ORDER BY trend_percent, item_id LIMIT 10)
      SELECT * FROM up UNION ALL SELECT * FROM down UNION ALL SELECT 'sentiment', count(*), round(avg(sign(trend_percent)), 6) FROM g"""
)
def market_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten items that rise and that fall most (a report of ten by nature), and the mood: items and mean sign."""
    stats = archive.item_stats(snapshots(spark, sf_dir)).select("item_id", F.round("trend_percent", 6).alias("trend_percent"))
    gain, loss, mood = archive.market_movers(stats)
    parts = [rows.select(F.lit(kind).alias("kind"), "item_id", "trend_percent") for kind, rows in (("gainer", gain), ("loser", loss))]
    return parts[0].union(parts[1]).union(mood.select(F.lit("sentiment"), "items", F.round("sentiment", 6)))


@query(
    f"""WITH {SNAPSHOTS_SQL}, p AS (SELECT item_id, CASE WHEN price <> lag(price) OVER (PARTITION BY item_id ORDER BY ts) THEN 1.0 WHEN lag(price) OVER (PARTITION BY item_id ORDER BY ts) IS NULL THEN NULL ELSE 0.0 END AS m FROM sn),
    a AS (SELECT item_id, coalesce(CAST(avg(m) AS DOUBLE), 0) AS score FROM p GROUP BY item_id)
    SELECT item_id, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'hot' WHEN score < 0.2 THEN 'cold' ELSE 'warm' END AS tier FROM a"""
)
def activity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.activity_scores(snapshots(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {SNAPSHOTS_SQL} SELECT snapshot_seq, ts, string_agg(item_id, ',' ORDER BY item_id) AS items, round(sum(price), 2) AS total FROM sn GROUP BY ALL")
def nested_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with their items as maps, in key order."""
    total = F.aggregate(F.map_values("items"), F.lit(0.0), lambda t, x: t + x["price"])
    return archived(spark, sf_dir).nested().select("snapshot_seq", "ts", F.array_join(F.map_keys("items").cast("array<string>"), ",").alias("items"), F.round(total, 2).alias("total"))


@query("SELECT o_orderkey AS snapshot_seq, epoch_us(o_orderdate) // 1000 AS ts, o_totalprice AS price FROM orders WHERE o_orderpriority = '2-HIGH'")
def history_by_string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive whose items are texts."""
    a = archive.Archive(spark, work_path(spark, "string-archive"), key="priority")
    a.append(order_writes(spark, sf_dir).select(F.col("seq").alias("snapshot_seq"), "ts", "priority", "price"))
    return a.item("2-HIGH").select("snapshot_seq", "ts", "price")


LATEST_SQL = "SELECT o_custkey AS key, epoch_us(o_orderdate) // 1000 AS ts, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority FROM orders"
NEWEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1"


@query(f"WITH w AS ({LATEST_SQL}) SELECT key, ts, seq, price, status, priority FROM w {NEWEST}")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_by_key(order_writes(spark, sf_dir)).select("key", "ts", "seq", "price", "status", "priority")


@query("SELECT count(*) AS records, count(DISTINCT o_custkey) AS kept, count(*) - count(DISTINCT o_custkey) AS deduplicated FROM orders")
def compact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.compact(order_writes(spark, sf_dir))[1]


#: Orders split into tiers by number: the newest are hot, the oldest cold.
TIERS_SQL = f"w AS ({LATEST_SQL}), t AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'hot' WHEN seq % 3 = 1 THEN 'warm' ELSE 'cold' END AS tier, CAST(seq % 3 AS INT) AS tier_rank FROM w)"


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = order_writes(spark, sf_dir)
    return store.tiered(*[writes.where(F.col("seq") % 3 == k) for k in range(3)])


@query(f"WITH {TIERS_SQL} SELECT key, ts, seq, price, status, priority, tier, tier_rank FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier_rank, ts DESC, seq DESC) = 1")
def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tier_lookup(tiers(spark, sf_dir))


@query("SELECT event_type || '|' || user_id AS key, count(*) AS n FROM events WHERE event_type LIKE 'view%' GROUP BY ALL")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"))
    return store.prefix_scan(events, "view|").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CAST(user_id AS VARCHAR) AS key, value FROM events)
    SELECT key, seq, value FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 'PUT'"""
)
def change_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_writes(spark, sf_dir).select("seq", F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.col("item_key").alias("key"), "value")
    return store.fold_log(log).select("key", "seq", "value")


@query(
    """WITH f AS (SELECT 'part-' || o_custkey AS file, CASE WHEN o_custkey % 2 = 0 THEN 'warm' ELSE 'cold' END AS tier, max(epoch_us(o_orderdate) // 1000) AS modified FROM orders GROUP BY ALL),
       m AS (SELECT max(modified) + 86400000 AS now FROM f)
    SELECT file, tier, modified, CASE WHEN tier = 'warm' AND now - modified >= 30 * 86400000::BIGINT THEN 'to_cold' WHEN tier = 'cold' AND now - modified >= 365 * 86400000::BIGINT THEN 'delete' ELSE 'keep' END AS action FROM f, m"""
)
def tier_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = order_writes(spark, sf_dir)
    files = writes.groupBy(F.concat(F.lit("part-"), F.col("key")).alias("file"), F.when(F.col("key") % 2 == 0, "warm").otherwise("cold").alias("tier")).agg(F.max("ts").alias("modified"))
    now = files.agg(F.max("modified")).first()[0] or 0
    return store.rotation(files, now + 86_400_000)


@query("SELECT o_custkey AS key, octet_length(encode(CAST(o_custkey AS VARCHAR))) + octet_length(encode('{\"status\":\"' || o_orderstatus || '\"}')) + 32 AS bytes FROM orders")
def record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.estimated_bytes(order_writes(spark, sf_dir).withColumn("key", F.col("key").cast("string")), ["status"]).withColumn("key", F.col("key").cast("long"))


#: Outcomes made from events: the type tells what was recommended, the value how it went.
OUTCOMES_SQL = f"""{WRITES_SQL}
oc AS (SELECT 'i' || (seq % 400) AS insight_id, CASE WHEN event_type = 'error' THEN 'anomaly' ELSE 'recommendation' END AS insight_type, ts, seq,
              CASE WHEN seq % 4 = 0 THEN item_key ELSE event_type || '|' || item_key END AS target,
              CASE WHEN value > 30 THEN 'followed_success' WHEN value > 15 THEN 'followed_failure' WHEN value > 5 THEN 'ignored_validated' ELSE 'ignored_invalidated' END AS result FROM w),
jd AS (SELECT *, CASE WHEN instr(target, '|') > 1 THEN split_part(target, '|', 1) ELSE '*' END AS scope, CAST(result IN ('followed_success', 'ignored_validated') AS INT) AS correct FROM oc)
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return event_writes(spark, sf_dir).select(
        F.concat(F.lit("i"), F.col("seq") % 400).alias("insight_id"),
        F.when(F.col("event_type") == "error", "anomaly").otherwise("recommendation").alias("insight_type"),
        "ts",
        "seq",
        F.when(F.col("seq") % 4 == 0, F.col("item_key")).otherwise(F.concat_ws("|", "event_type", "item_key")).alias("target"),
        F.when(v > 30, "followed_success").when(v > 15, "followed_failure").when(v > 5, "ignored_validated").otherwise("ignored_invalidated").alias("result"),
    )


@query(f"WITH {OUTCOMES_SQL} SELECT insight_type, scope, count(*) AS total, CAST(sum(correct) AS BIGINT) AS correct, round(avg(correct), 6) AS accuracy, round(least(1, avg(correct) * 1.1), 6) AS calibration FROM jd GROUP BY ALL")
def accuracy_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = confidence.accuracy_by_scope(outcomes(spark, sf_dir))
    return found.withColumns({"accuracy": F.round("accuracy", 6), "calibration": F.round("calibration", 6)})


@query(
    f"""WITH {OUTCOMES_SQL}, f AS (SELECT *, min((ts, seq)) OVER (PARTITION BY insight_id) AS first FROM jd),
    r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY insight_type, scope ORDER BY first DESC, ts DESC, seq DESC) <= 50)
    SELECT insight_type, scope, round(avg(correct), 6) AS recent_accuracy, count(*) AS n FROM r GROUP BY ALL"""
)
def recent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.recent_accuracy(outcomes(spark, sf_dir)).withColumn("recent_accuracy", F.round("recent_accuracy", 6))


@query(
    f"""WITH {OUTCOMES_SQL}, h AS (SELECT *, count(*) OVER o AS total, avg(correct) OVER o AS accuracy FROM jd
          WINDOW o AS (PARTITION BY insight_type, scope ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, CASE WHEN accuracy < 0.3 AND total >= 10 THEN true WHEN accuracy >= 0.5 THEN false END AS off,
                 CASE WHEN accuracy > 0.95 AND total > 50 THEN true WHEN accuracy <= 0.9 THEN false END AS sure FROM h)
    SELECT insight_type, scope, max(total) AS total, round(max_by(accuracy, total), 6) AS accuracy,
           coalesce(max_by(off, total) FILTER (off IS NOT NULL), false) AS disabled, coalesce(max_by(sure, total) FILTER (sure IS NOT NULL), false) AS high_reliability
    FROM e GROUP BY ALL"""
)
def confidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.confidence_flags(outcomes(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


#: Fields of mixed kinds: value and k are numbers throughout, event_type is text, and mark is now one, now the other.
RECORDS_SQL = """
rc AS (SELECT 'value' AS field, value AS number, CAST(NULL AS VARCHAR) AS text FROM events UNION ALL SELECT 'type', NULL, event_type FROM events
       UNION ALL SELECT 'mark', CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END FROM events)
"""


@query(
    f"""WITH {RECORDS_SQL} SELECT field, CASE WHEN bool_and(number IS NOT NULL) THEN 'numeric' ELSE 'categorical' END AS kind,
    coalesce(array_to_string(list_sort(list(DISTINCT text) FILTER (text IS NOT NULL)), ','), '') AS values FROM rc GROUP BY field"""
)
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    even = F.col("event_id") % 2 == 0
    entries = F.array(
        F.struct(F.lit("value").alias("field"), F.col("value").alias("number"), text.alias("text")),
        F.struct(F.lit("type").alias("field"), number.alias("number"), F.col("event_type").alias("text")),
        F.struct(F.lit("mark").alias("field"), F.when(even, F.col("value")).alias("number"), F.when(~even, F.col("event_type")).alias("text")),
    )
    records = table(spark, sf_dir, "events").select(F.explode(entries).alias("e")).select("e.*")
    return model.infer_fields(records).withColumn("values", F.array_join("values", ","))


@query("SELECT event_type AS value, CAST(dense_rank() OVER (ORDER BY event_type) AS INT) AS code FROM (SELECT DISTINCT event_type FROM events)")
def categorical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.category_codes(table(spark, sf_dir, "events"), "event_type")


