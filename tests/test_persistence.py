"""Insight state as records and back."""

from chronoloom import model
from chronoloom.operators import behavior, confidence, correlation, persistence


def test_every_kind_comes_back_whole(spark):
    writes = spark.createDataFrame([(k, 1000 * i, i, float(m * i + i % 2)) for k, m in (("a|x", 3), ("b", 5)) for i in range(12)], "item_key string, ts long, seq long, v double")
    out = [(f"i{k}", "anomaly", "x|y", "followed_success", k, k) for k in range(4)]
    frames = {
        "behavior": behavior.item_behavior(writes, ["v"]),
        "trend": behavior.field_trends(writes, ["v"]),
        "correlation": correlation.pair_correlations(correlation.item_series(writes.withColumnRenamed("v", "signal"))),
        "confidence": confidence.confidence(spark.createDataFrame(out, "insight_id string, insight_type string, target string, result string, ts long, seq long")),
    }
    for kind, df in frames.items():
        records = persistence.to_records(df, kind)
        assert records.where(~model.is_insight(records.key)).isEmpty()
        back = persistence.from_records(records, kind, df).select(*df.columns)
        assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.count()


def test_numeric_fields(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x")], "item_key string, ts long, v double, s string")
    assert model.numeric_fields(df, "ts") == ["v"]
