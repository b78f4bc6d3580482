"""Streams against their batch forms."""

import random

import pytest
from chronoloom.operators import behavior
from chronoloom.operators.store import latest_by_key
from chronoloom.streaming import behavior as streams

SCHEMA = "item_key string, ts long, seq long, op string, value double"


def test_stream_over_restarts_equals_batch(spark, tmp_path):
    r, rows, ts = random.Random(9), [], 1_000_000
    for i in range(400):
        ts += r.choice([1, 1000, 4_000_000, 90_000_000])
        rows.append((f"k{r.randrange(6)}", ts, i, "write", r.choice([None, 1.0, r.uniform(0, 9)])))
    seen = []
    subs = streams.Subscriptions()
    number = subs.subscribe(["lifecycle_change"], seen.append)
    for part in range(3):
        spark.createDataFrame(rows[part * 150 : (part + 1) * 150], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ops = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        streams.run_behavior(ops, ["value"], f"{tmp_path}/cp", f"{tmp_path}/updates", f"{tmp_path}/events", subs).awaitTermination()
    updates = spark.read.parquet(f"{tmp_path}/updates")
    assert updates.count() == 400
    last = {x.item_key: x for x in latest_by_key(updates.drop("batch", "anomalies"), "item_key").collect()}
    writes = spark.createDataFrame(rows, SCHEMA).drop("op")
    for b in behavior.item_behavior(writes, ["value"]).collect():
        s = last[b.item_key]
        assert (s.write_count, s.streak, s.streak_record, s.lifecycle) == (b.write_count, b.streak, b.streak_record, b.lifecycle)
        assert (s.velocity, s.volatility, s.entropy) == pytest.approx((b.velocity, b.volatility, b.entropy))
    changes = behavior.lifecycle_transitions(writes).count()
    assert spark.read.parquet(f"{tmp_path}/events").where("type = 'lifecycle_change'").count() == changes == len(seen)
    assert subs.unsubscribe(number) and not subs.unsubscribe(number)
    with pytest.raises(ValueError):
        subs.subscribe(["nothing"], seen.append)


def test_reads_change_lifecycle(spark, tmp_path):
    day = 86_400_000
    rows = [("a", 0, 0, "write", 1.0), ("a", 8 * day, 1, "read", None), ("a", 31 * day, 2, "read", None), ("a", 31 * day + 1, 3, "write", 2.0), ("b", 5, 4, "read", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    ops = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    streams.run_behavior(ops, ["value"], f"{tmp_path}/cp", f"{tmp_path}/updates").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/updates").orderBy("seq").collect()
    assert [r.lifecycle for r in found] == ["emerging", "dormant", "dead", "resurrected"]
    assert found[2].access_frequency == pytest.approx(0.35 * 3_600_000 / (23 * day) + 0.65 * 0.35)


def test_archive_sink_appends_each_batch_once(spark, tmp_path):
    from chronoloom.sources.archive import Archive
    from chronoloom.streaming.sinks import archive_sink

    schema = "snapshot_seq long, ts long, item_id long, price double, quantity double"
    a = Archive(spark, f"file://{tmp_path}/archive")
    for part in range(2):
        spark.createDataFrame([(part, part, i, 1.0 * i, 2.0) for i in range(5)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        rows.writeStream.foreachBatch(archive_sink(a, "s")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    archive_sink(a, "s")(spark.createDataFrame([(9, 9, 9, 9.0, 9.0)], schema), 0)
    assert a.rows().count() == 10 and a.verify() and a.manifest.version() == 1


def test_cross_item_sink_reports_changes(spark, tmp_path):
    from chronoloom.streaming.sinks import CrossItemSink

    seen = []
    subs = streams.Subscriptions()
    subs.subscribe(["correlation_discovered", "cluster_formed", "cluster_dissolved"], seen.append)
    sink = CrossItemSink(spark, f"file://{tmp_path}/cross", subs)
    schema = "item_key string, ts long, seq long, signal double"
    ramp = lambda k, start, f: [(k, 1000 * i, i, float(f(i))) for i in range(start, start + 12)]
    sink(spark.createDataFrame(ramp("a", 0, lambda i: 2 * i) + ramp("b", 0, lambda i: 3 * i + i % 2), schema), 0)
    assert sorted(e["type"] for e in seen) == ["cluster_formed", "correlation_discovered"]
    seen.clear()
    sink(spark.createDataFrame(ramp("c", 0, lambda i: 5 * i + i % 3), schema), 1)
    assert sorted((e["type"], e["item_key"]) for e in seen) == [
        ("cluster_dissolved", "cluster_a|b"), ("cluster_formed", "cluster_a|b|c"), ("correlation_discovered", "a|c"), ("correlation_discovered", "b|c"),
    ]
    assert spark.read.parquet(f"{tmp_path}/cross/pairs/batch=1").count() == 3


def test_pairs_of_kept_batches_are_those_of_one_pass(spark, tmp_path):
    from chronoloom.operators import correlation
    from chronoloom.streaming.sinks import CrossItemSink

    r = random.Random(4)
    schema = "item_key string, ts long, seq long, signal double"
    items = [[f"i{k}" for k in range(12)], ["i0", "i1", "i2"], ["i2", "i3", "new"], ["i4"], ["i0", "i5"]]
    batches = [[(k, 100_000 * n + 1000 * t, 100 * n + t, r.uniform(0, 9)) for k in keys for t in range(9)] for n, keys in enumerate(items)]
    sink = CrossItemSink(spark, f"file://{tmp_path}/cross", threshold=0.5)
    rows = lambda df: sorted((x.item_a, x.item_b, x.lag, x.n, round(x.coefficient, 9), x.updated_at) for x in df.collect())
    report = {0: sink.keep, 1: sink, 2: sink.keep, 3: sink.keep, 4: sink}  # tables after 1 and 4; 2 and 3 wait for 4's
    for number, batch in enumerate(batches):
        report[number](spark.createDataFrame(batch, schema), number)
    for number in (1, 4):
        so_far = spark.createDataFrame([x for batch in batches[: number + 1] for x in batch], schema)
        want = rows(correlation.pair_correlations(correlation.item_series(so_far), threshold=0.5))
        assert rows(spark.read.parquet(f"{tmp_path}/cross/pairs/batch={number}")) == want and len(want) > 3
    before, after = ({(x[0], x[1]) for x in rows(spark.read.parquet(f"{tmp_path}/cross/pairs/batch={n}"))} for n in (1, 4))
    found = spark.read.parquet(f"{tmp_path}/cross/events/batch=4").where("type = 'correlation_discovered'").collect()
    assert {tuple(e.item_key.split("|")) for e in found} == after - before
    assert rows(sink.evaluate(4)) == want  # again, as after a failure


def test_stream_pairs_evaluates_once_all_items(spark, sf_dir, monkeypatch):
    from chronoloom.operators import correlation
    from chronoloom.plans import streams as plans

    calls = []
    plain = correlation.pair_correlations
    monkeypatch.setattr(correlation, "pair_correlations", lambda items, **k: calls.append((items.count(), k.get("only"))) or plain(items, **k))
    plans.stream_pairs(spark, sf_dir)
    assert calls == [(15, None)]
