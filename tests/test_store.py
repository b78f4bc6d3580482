"""The keyed store and the facade."""

import json
import random

import pytest
from chronoloom.engine import Engine
from chronoloom.operators import confidence, store
from pyspark.sql import functions as F

LOG = "seq long, op string, key string, price double, label string, qty double, status string"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


def test_fold_and_damage(spark):
    log = spark.createDataFrame([(4, "PUT", "oak", 3.5, "tall", None, None), (5, "PUT", "elm", None, None, 12.0, "felled"), (6, "DELETE", "oak", None, None, None, None)], LOG)
    assert [r.key for r in store.fold_log(log).collect()] == ["elm"]
    summed = store.with_checksum(log.withColumn("payload", F.to_json(F.struct("price", "qty"))))
    damaged = summed.withColumn("payload", F.when(F.col("seq") == 4, "x").otherwise(F.col("payload")))
    assert [r.seq for r in store.intact(damaged).orderBy("seq").collect()] == [5, 6]


def test_thresholds():
    assert store.flush_decision(0, 1, max_dirty=1) is None and store.flush_decision(0, 2, max_dirty=1) == "dirty"
    assert store.flush_decision(21, 0, max_bytes=20) == "size"


def test_replace_prefix_and_delete(spark, path):
    e = Engine(spark, path).start()
    e.put("pine/7", {"rings": 41, "state": "dry"}, ts=11)
    e.put("pine/7", {"rings": 42, "owner": "north"}, ts=12)
    assert e.get("pine/7")["fields"] == {"rings": 42, "owner": "north"}
    for k in ("birch/1", "birch/2", "birch/3", "yew/1"):
        e.put(k, {"rings": 5}, ts=13)
    assert e.scan("birch/").count() == 3
    e.flush()
    e.delete("pine/7", ts=14)
    assert e.get("pine/7") is None and e.scan("pine").isEmpty()
    e.flush()
    assert Engine(spark, path).start().get("pine/7") is None


def test_recovery_from_the_log(spark, path, tmp_path):
    e = Engine(spark, path).start()
    e.put("ash", {"rings": 733, "bark": "grey"}, ts=21)
    e.put("fir", {"height": 30, "note": "lean"}, ts=22)
    e.put("bay", {"height": 4}, ts=23)
    log = sorted(tmp_path.glob("store/wal/*.json"))
    damaged = json.loads(log[0].read_text())
    log[0].write_text(json.dumps(damaged | {"entry": damaged["entry"].replace("733", "734")}))
    for crc in tmp_path.glob("store/wal/.*.crc"):
        crc.unlink()
    again = Engine(spark, path).start()
    assert again.get("ash") is None and again.get("fir")["fields"] == {"height": 30.0, "note": "lean"} and again.seq >= 4


def test_compact_rotate_and_tiers(spark, path):
    e = Engine(spark, path, cold_key=b"0" * 32).start()
    e.put("moss", {"area": 6, "tone": "pale"}, ts=31)
    e.put("fern", {"area": 3}, ts=31)
    e.flush()
    e.put("moss", {"area": 8, "tone": "dark"}, ts=32)
    e.put("reed", {"area": 1}, ts=32)
    e.flush()
    done = e.compact()
    assert done["compacted"] and (done["records"], done["kept"], done["deduplicated"]) == (4, 3, 1)
    assert e.get("moss")["tier"] == "hot"
    fresh = Engine(spark, path, cold_key=b"0" * 32).start()
    assert fresh.get("moss")["fields"] == {"area": 8.0, "tone": "dark"} and fresh.get("moss")["tier"] == "warm"
    assert fresh.rotate(warm_ms=0)["rotated"] >= 1
    found = fresh.get("moss")
    assert (found["fields"], found["tier"], found["ts"], found["behavior"]["write_count"]) == ({"area": 8.0, "tone": "dark"}, "cold", 32, 2)
    assert fresh.vacuum(older_ms=0)["warm"] >= 2 and fresh.get("moss")["tier"] == "cold"
    assert fresh.verify("cold").where("NOT valid").isEmpty() and fresh.ping()["warm"] == 0
    with pytest.raises(Exception, match="(?i)aes|key"):
        Engine(spark, path, cold_key=b"1" * 32).start().scan().collect()


def test_auto_flush(spark, path):
    e = Engine(spark, path, max_dirty=2).start()
    assert [e.put(f"k{i}", {"v": i}, ts=i)["autoFlushed"] for i in range(3)] == [None, None, "dirty"]


def test_soak(spark, path):
    r, truth = random.Random(3), {}
    e = Engine(spark, path, max_dirty=60).start()
    for i in range(200):
        key = f"k{r.randrange(40)}"
        if r.random() < 0.8:
            truth[key] = {"score": float(i), "tag": f"t{i}"}
            e.put(key, truth[key], ts=i)
        else:
            truth.pop(key, None)
            e.delete(key, ts=i)
        if i == 120:
            e.compact()
    again = Engine(spark, path).start()
    found = {x.key: {**x.numbers, **x.texts} for x in again.scan().collect()}
    assert found == truth


def test_calls(spark, path):
    e = Engine(spark, path, token="t").start()
    code = lambda q: e.call(q).get("error", {}).get("code")
    assert code("{") == -32700 and code({"id": 1}) == -32600 and code({"method": "nope", "token": "t"}) == -32601
    assert code({"method": "get", "params": {"key": "x"}}) == -32000 and code({"method": "get", "params": {"wrong": 1}, "token": "t"}) == -32602
    assert e.call({"id": 5, "method": "ping"})["result"]["ok"]
    assert e.call({"method": "put", "params": {"key": "x", "fields": {"v": 1}}, "token": "t"})["result"]["ok"]
    assert e.call({"method": "scan", "params": {"prefix": "x"}, "token": "t"})["result"][0]["numbers"] == {"v": 1.0}
    assert code({"method": "reportOutcome", "params": {"insight_id": "none", "result": "followed_success"}, "token": "t"}) == -32602


def test_insights_through_the_facade(spark, path):
    e = Engine(spark, path).start()
    e.put_all(spark.createDataFrame([(k, 1000 + 100 * i, i, {"v": float(m * i + i % 2)}, {}) for k, m in (("a", 3), ("b", 5)) for i in range(20)], "key string, ts long, seq long, numbers map<string,double>, texts map<string,string>"))
    e.seq = 100
    assert e.get_insight("a").first().write_count == 20 and e.get_insights(lifecycle="active").count() == 2
    assert e.get_correlations().count() == 1 and e.get_clusters().first().cluster_id == "cluster_a|b"
    assert e.get_forecast("a", "v", 3).count() == 1 and e.get_leading_indicators().count() <= 1 and e.get_seasonal_patterns().count() >= 0
    rec = e.get_recommendations(type="promote").first()
    e.report_outcome(rec.insight_id, "followed_success", ts=1)
    (acc,) = e.get_accuracy().collect()
    assert (acc.insight_type, acc.scope, acc.accuracy) == ("recommendation", "*", 1.0)
    assert e.cold_start("a|new").count() == 1 and e.get_anomalies(since=10**15).isEmpty()


def test_flags_have_hysteresis(spark):
    results = ["followed_failure"] * 10 + ["followed_success"] * 11
    rows = [(f"i{k}", "anomaly", "x|y", r, k, k) for k, r in enumerate(results)]
    h = confidence.flag_history(spark.createDataFrame(rows, "insight_id string, insight_type string, target string, result string, ts long, seq long")).orderBy("seq").collect()
    assert not h[8].disabled and h[9].disabled and h[18].disabled and not h[19].disabled


def test_recent_accuracy_window(spark):
    rows = [(f"i{k}", "anomaly", "t", "followed_success" if k >= 50 else "followed_failure", k, k) for k in range(100)]
    (r,) = confidence.recent_accuracy(spark.createDataFrame(rows, "insight_id string, insight_type string, target string, result string, ts long, seq long")).collect()
    assert (r.recent_accuracy, r.n, r.scope) == (1.0, 50, "*")


def test_puts_raise_events_and_return_behaviour(spark, path):
    e = Engine(spark, path).start()
    seen = []
    e.subscribe(["lifecycle_change", "anomaly_detected", "recommendation_new"], seen.append)
    for i in range(12):
        done = e.put("pump", {"flow": 500.0 if i == 11 else 10.0 + i % 2}, ts=1_000_000 + 60_000 * i)
    assert done["behavior"]["write_count"] == 12 and done["behavior"]["lifecycle"] == "active"
    kinds = [x["type"] for x in seen]
    assert "lifecycle_change" in kinds and "anomaly_detected" in kinds
    (odd,) = [json.loads(x["detail"]) for x in seen if x["type"] == "anomaly_detected"]
    assert odd["field"] == "flow" and odd["actual"] == 500.0 and odd["z_score"] > 2
    advice = {json.loads(x["detail"])["kind"] for x in seen if x["type"] == "recommendation_new"}
    assert {"promote", "alert", "investigate"} >= advice >= {"promote", "alert"}
    batch = e.get_insight("pump").first()
    assert (batch.lifecycle, batch.write_count, batch.streak) == ("active", 12, done["behavior"]["streak"]) and batch.velocity == pytest.approx(done["behavior"]["velocity"])


def test_subscriptions_by_call_are_polled(spark, path):
    e = Engine(spark, path).start()
    ask = lambda method, **params: e.call({"id": 1, "method": method, "params": params})
    number = ask("subscribe", events=["anomaly_detected", "lifecycle_change", "correlation_discovered", "cluster_formed"])["result"]
    assert ask("subscribe", events=["nothing"])["error"]["code"] == -32602
    for i in range(12):
        ask("put", key="a", fields={"v": float(2 * i)}, ts=1000 + 100 * i)
        ask("put", key="b", fields={"v": float(3 * i + i % 2)}, ts=1000 + 100 * i)
    found = ask("poll", number=number)["result"]
    assert found and {x["type"] for x in found} == {"lifecycle_change"} and ask("poll", number=number)["result"] == []
    ask("flush")
    later = ask("poll", number=number)["result"]
    assert sorted(x["type"] for x in later) == ["cluster_formed", "correlation_discovered"] and later[0]["item_key"] in ("a|b", "cluster_a|b")
    assert ask("unsubscribe", number=number)["result"] is True and ask("poll", number=number)["error"]["code"] == -32602


def test_outcomes_and_behaviour_survive_a_restart(spark, path):
    e = Engine(spark, path).start()
    for i in range(14):
        e.put("kiln", {"heat": float(i)}, ts=1000 + 100 * i)
    rec = e.get_recommendations(type="promote").first()
    e.report_outcome(rec.insight_id, "followed_failure", ts=9000)
    crashed = Engine(spark, path).start()  # nothing was flushed
    assert crashed.get_accuracy().first().total == 1
    crashed.flush()
    assert crashed.save_insights()["files"] >= 1
    again = Engine(spark, path).start()
    (acc,) = again.get_accuracy().collect()
    assert (acc.total, acc.correct, acc.scope) == (1, 0, "*")
    assert again.states == {} and again.get("kiln")["behavior"]["write_count"] == 14
    done = again.put("kiln", {"heat": 14.0}, ts=1000 + 1400)
    assert done["behavior"]["write_count"] == 15 and done["behavior"]["streak"] == 14 and done["behavior"]["read_count"] == 1
    kept = {r.key: r for r in again.saved_insights("behavior").collect()}
    assert kept["_insight/behavior/kiln"].numbers["write_count"] == 14.0 and again.scan("").count() == 1
    assert {r.texts["field"] for r in again.saved_insights("trend").collect()} == {"heat"} and again.saved_insights("confidence").count() == 1


def test_a_flush_by_size_comes_with_the_put_that_passes_it(spark, path):
    e = Engine(spark, path, max_bytes=300).start()
    assert [e.put(f"k{i}", {"t": "x" * 60}, ts=i)["autoFlushed"] for i in range(4)] == [None, None, "size", "size"]
    assert Engine._bytes(e.hot["k1"]) * 4 == e.size


def test_reads_are_not_dirty_and_hot_records_are_bounded(spark, path):
    e = Engine(spark, path, max_dirty=3, max_hot=2).start()
    for i in range(4):
        e.put(f"k{i}", {"v": i}, ts=i)
    for _ in range(5):
        e.get("k3", ts=10)
    assert e.ping()["dirty"] == 0 and len(e.pending) == 5
    for i in range(4, 7):
        e.put(f"k{i}", {"v": i}, ts=i)
    e.flush()
    e.put("k7", {"v": 7}, ts=7)
    assert len(e.hot) <= 4 and e.get("k0")["tier"] == "warm" and e.scan("k").count() == 8


def test_a_log_of_several_operations_a_file(spark, path, tmp_path):
    e = Engine(spark, path, sync_every=4).start()
    for i in range(6):
        e.put(f"k{i}", {"v": i}, ts=i)
    assert len(list(tmp_path.glob("store/wal/*.json"))) == 1 and Engine(spark, path).start().scan("k").count() == 4
    e.stop()
    assert Engine(spark, path).start().scan("k").count() == 6


def test_a_lookup_opens_only_files_that_can_hold_the_key(spark, path, tmp_path):
    e = Engine(spark, path).start()
    for name in ("a", "m", "z"):
        e.put(f"{name}1", {"v": 1}, ts=1)
        e.put(f"{name}2", {"v": 2}, ts=2)
        e.flush()
    fresh = Engine(spark, path).start()
    files = fresh._manifest("warm").require(only=lambda f: f.may_hold(["m2"], None, None))
    for x in fresh._entries("warm"):
        if f"{fresh.path}/warm/{x.file}" not in files and "insight" not in x.file:
            (tmp_path / "store" / "warm" / x.file).unlink()
    assert fresh.get("m2")["fields"] == {"v": 2.0}
    with pytest.raises(Exception, match="missing"):
        fresh.scan("z")
