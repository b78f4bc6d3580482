"""Queries of snapshots' encodings and block profiles over lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import blocks
from chronoloom.operators.ranks import placed
from chronoloom.plans.registry import query
from chronoloom.sources.tables import event_writes, table

#: Cents of each event type's values in event order, and hundredths of the values of lineitem's supplier groups.
STREAMS_SQL = """
st AS (SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, CAST(round(value * 100) AS BIGINT) AS v FROM events),
"""


def value_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "seq")) - 1
    return event_writes(spark, sf_dir).select(
        F.col("event_type").alias("stream"), pos.cast("long").alias("pos"), F.round(F.col("value") * 100).cast("long").alias("v")
    )


@query(f"WITH {STREAMS_SQL} z AS (SELECT 1) SELECT stream, pos, v FROM st")
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of very long streams: by ranges, so that no task numbers a whole stream."""
    rows = event_writes(spark, sf_dir).select(F.col("event_type").alias("stream"), "ts", "seq", F.round(F.col("value") * 100).cast("long").alias("v"))
    return placed(rows, "stream", ["ts", "seq"]).select("stream", "pos", "v")


DELTA_SQL = f"WITH {STREAMS_SQL} de AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY stream ORDER BY pos), 0) AS d FROM st)"


@query(DELTA_SQL + " SELECT stream, pos, v, d FROM de")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.delta(value_streams(spark, sf_dir))


@query(DELTA_SQL + " SELECT stream, pos, v, d, d - coalesce(lag(d) OVER (PARTITION BY stream ORDER BY pos), 0) AS dd FROM de")
def delta_of_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.delta_of_delta(value_streams(spark, sf_dir))


@query(f"WITH {STREAMS_SQL} z AS (SELECT 1) SELECT stream, pos, v FROM st")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = blocks.delta_of_delta(value_streams(spark, sf_dir)).select("stream", "pos", "dd")
    return blocks.undo_delta_of_delta(coded).select("stream", "pos", "v")


@query(
    """WITH s AS (SELECT l_returnflag AS stream, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos,
              CAST(floor(l_quantity / 25) AS BIGINT) AS v FROM lineitem),
       t AS (SELECT *, pos - row_number() OVER (PARTITION BY stream, v ORDER BY pos) AS g FROM s),
       r AS (SELECT *, (row_number() OVER (PARTITION BY stream, v, g ORDER BY pos) - 1) // 255 AS c FROM t)
       SELECT stream, min(pos) AS start, count(*) AS length, v FROM r GROUP BY stream, v, g, c"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.run_lengths(flag_streams(spark, sf_dir))


def flag_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    pos = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(*order)) - 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stream"), pos.cast("long").alias("pos"), F.floor(F.col("l_quantity") / 25).cast("long").alias("v")
    )


@query("SELECT p_name AS key, dense_rank() OVER (ORDER BY encode(p_name)) - 1 AS id FROM (SELECT DISTINCT p_name FROM part)")
def string_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.dictionary(table(spark, sf_dir, "part"), "p_name")


METRICS_SQL = f"""WITH {STREAMS_SQL}
b AS (SELECT *, pos // 500 AS block, CAST(v AS DOUBLE) AS x FROM st),
d1 AS (SELECT *, x - lag(x) OVER w AS d FROM b WINDOW w AS (PARTITION BY stream, block ORDER BY pos)),
d2 AS (SELECT *, d - lag(d) OVER w AS dd, CASE WHEN sign(d) * sign(lag(d) OVER w) < 0 THEN 1 ELSE 0 END AS flip,
              avg(abs(d)) OVER (PARTITION BY stream, block) AS mean FROM d1 WINDOW w AS (PARTITION BY stream, block ORDER BY pos)),
a AS (SELECT stream, block, count(*) AS n, count(d) AS nd, count(dd) AS ndd, count(DISTINCT x) AS uv, count(DISTINCT d) AS ud, count(DISTINCT dd) AS udd,
             count(*) FILTER (x = 0) AS zero, sum(abs(d)) AS sd, sum(flip) AS flips, count(*) FILTER (d >= 0) AS up, count(*) FILTER (d <= 0) AS down,
             count(*) FILTER (mean > 0 AND abs(d) > mean * 5) AS outliers, count(*) FILTER (dd = 0) AS ddzero, sum(abs(dd)) AS sdd,
             list_sort(list(abs(d)) FILTER (d IS NOT NULL)) AS ad, list_sort(list(abs(dd)) FILTER (dd IS NOT NULL)) AS ldd
      FROM d2 GROUP BY stream, block),
m AS (SELECT stream, block, n, uv / n AS unique_ratio, zero / n AS zero_ratio, CASE WHEN nd > 0 THEN sd / nd ELSE 0 END AS mean_abs_delta,
             coalesce(ad[CAST(floor(nd * 0.9) AS INT) + 1], 0) AS p90_abs_delta, CASE WHEN nd > 1 THEN flips / (nd - 1) ELSE 0 END AS sign_flip_rate,
             CASE WHEN nd > 0 THEN greatest(up, down) / nd ELSE 1 END AS monotonicity_score, CASE WHEN nd > 0 THEN outliers / nd ELSE 0 END AS outlier_score,
             CASE WHEN nd > 0 THEN ud / nd ELSE 0 END AS unique_delta_ratio, CASE WHEN ndd > 0 THEN udd / ndd ELSE 0 END AS unique_dod_ratio,
             CASE WHEN ndd > 0 THEN ddzero / ndd ELSE 0 END AS dod_zero_ratio, CASE WHEN ndd > 0 THEN sdd / ndd ELSE 0 END AS mean_abs_dod,
             coalesce(ldd[CAST(floor(ndd * 0.9) AS INT) + 1], 0) AS p90_abs_dod FROM a)
"""
REGIME_SQL = """CASE WHEN monotonicity_score > 0.9 OR unique_ratio < 0.05 THEN 'ORDERED'
  WHEN (sign_flip_rate > 0.4 AND unique_ratio > 0.8) OR outlier_score > 0.1 THEN 'CHAOTIC' ELSE 'MIXED' END"""
METRICS = [
    "unique_ratio", "zero_ratio", "mean_abs_delta", "p90_abs_delta", "sign_flip_rate", "monotonicity_score", "outlier_score",
    "unique_delta_ratio", "unique_dod_ratio", "dod_zero_ratio", "mean_abs_dod", "p90_abs_dod",
]


@query(METRICS_SQL + "SELECT stream, block, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRICS) + " FROM m")
def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.block_metrics(value_streams(spark, sf_dir), 500)
    return found.select("stream", "block", "n", *[F.round(c, 6).alias(c) for c in METRICS])


@query(METRICS_SQL + f"SELECT stream, block, {REGIME_SQL} AS regime FROM m")
def block_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_metrics(value_streams(spark, sf_dir), 500).select("stream", "block", "regime")


SIZES_SQL = f"""{DELTA_SQL},
z AS (SELECT *, pos // 500 AS block, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS zz FROM de),
r AS (SELECT *, row_number() OVER (PARTITION BY stream, block ORDER BY pos) - row_number() OVER (PARTITION BY stream, block, d ORDER BY pos) AS g FROM z),
c AS (SELECT *, (row_number() OVER (PARTITION BY stream, block, d, g ORDER BY pos) - 1) // 255 AS cut FROM r),
runs AS (SELECT stream, block, count(*) AS len, any_value(zz) AS zz FROM c GROUP BY stream, block, d, g, cut),
rl AS (SELECT stream, block, CAST(sum(ceil(greatest(1, length(bin(2 * len))) / 7) + ceil(greatest(1, length(bin(zz))) / 7)) AS BIGINT) AS rle FROM runs GROUP BY ALL),
s AS (SELECT stream, block, count(*) AS n, CAST(sum(ceil(greatest(1, length(bin(zz))) / 7)) AS BIGINT) AS varint,
             CAST(1 + ceil(count(*) * greatest(1, length(bin(max(zz)))) / 8) AS BIGINT) AS bitpack, count(*) * 8 AS fixed64 FROM z GROUP BY stream, block)
"""


@query(SIZES_SQL + "SELECT stream, block, n, varint, bitpack, rle, fixed64 FROM s JOIN rl USING (stream, block)")
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.codec_sizes(blocks.delta(value_streams(spark, sf_dir)), "d", 500)


CHOICE = ["varint", "bitpack", "rle", "fixed64"]


@query(
    SIZES_SQL
    + """SELECT stream, block, n, CASE least(varint, bitpack, rle, fixed64) WHEN varint THEN 'varint' WHEN bitpack THEN 'bitpack' WHEN rle THEN 'rle' ELSE 'fixed64' END AS codec,
       least(varint, bitpack, rle, fixed64) AS bytes, round(n * 8.0 / least(varint, bitpack, rle, fixed64), 6) AS ratio FROM s JOIN rl USING (stream, block)"""
)
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = blocks.codec_sizes(blocks.delta(value_streams(spark, sf_dir)), "d", 500)
    return blocks.codec_choice(sizes, CHOICE).withColumn("ratio", F.round("ratio", 6))


@query()
def dictionary_codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.dictionary_sizes(blocks.delta(value_streams(spark, sf_dir)), "d", 500)


def profiled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of small blocks of events' values, with the ratio of the best codec."""
    streams = value_streams(spark, sf_dir)
    choice = blocks.codec_choice(blocks.codec_sizes(blocks.delta(streams), "d", 100), CHOICE)
    return blocks.block_metrics(streams, 100).join(choice.select("stream", "block", "bytes", "ratio"), ["stream", "block"])


@query()
def chm_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chm_routing(profiled_blocks(spark, sf_dir))


@query()
def chm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chm_segments(profiled_blocks(spark, sf_dir))


@query()
def chm_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = profiled_blocks(spark, sf_dir)
    routed = blocks.chm_routing(sized).select("stream", "block", "decision")
    return blocks.telemetry(routed.join(sized.select("stream", "block", (F.col("n") * 8).alias("bytes_in"), F.col("bytes").alias("bytes_out")), ["stream", "block"]))
