"""Behaviour and signals: fixed cases, and random logs against the one-row-at-a-time fold."""

import random

import pytest
from chronoloom.operators import behavior, signals
from chronoloom.streaming import fold

T = "item_key string, ts long, seq long, "


def frame(spark, rows, fields):
    return spark.createDataFrame([(k, ts, i, *v) for i, (k, ts, *v) in enumerate(rows)], T + ", ".join(f"{f} double" for f in fields))


def one(df):
    (row,) = df.collect()
    return row


def test_steady_growth(spark):
    w = frame(spark, [("a", 1000 + 100 * i, 100.0 + 10 * i) for i in range(10)], ["price"])
    b = one(behavior.item_behavior(w, ["price"]))
    assert b.velocity == pytest.approx(35254.391850) and b.volatility == 0 and b.entropy == 0
    assert (b.write_count, b.streak, b.streak_record, b.lifecycle) == (10, 9, 9, "active")


def test_trends_of_two_fields(spark):
    w = frame(spark, [("b", 1000 + 50 * i, 50.0 + 5 * i, 100.0) for i in range(15)], ["price", "volume"])
    t = {r.field: r for r in behavior.field_trends(w, ["price", "volume"]).collect()}
    assert (t["price"].min, t["price"].max, t["price"].direction) == (50, 120, "up")
    assert t["price"].ema == pytest.approx(108.412459) and t["price"].z_score == pytest.approx(1.565248) and t["price"].magnitude == pytest.approx(0.165536, abs=1e-6)
    assert t["volume"].ema == pytest.approx(100) and (t["volume"].z_score, t["volume"].magnitude, t["volume"].direction) == (0, 0, "flat")
    assert one(behavior.item_behavior(w, ["price", "volume"])).velocity == pytest.approx(71826.973167)


def test_streak_turns_and_zero_change_is_neutral(spark):
    rows = [("c", 1000 + 100 * i, 10.0 + i) for i in range(5)] + [("c", 1600 + 100 * i, 14.0 - 2 * i) for i in range(3)]
    b = one(behavior.item_behavior(frame(spark, rows, ["val"]), ["val"]))
    assert (b.streak, b.streak_record, b.lifecycle) == (-2, 4, "emerging")
    assert b.entropy == pytest.approx(0.918296, abs=1e-6) and b.volatility == pytest.approx(37.796447)


def test_alternation_is_entropic(spark):
    b = one(behavior.item_behavior(frame(spark, [("d", 1000 + i, 100.0 if i % 2 else 50.0) for i in range(20)], ["v"]), ["v"]))
    assert b.entropy == pytest.approx(0.998001, abs=1e-6) and abs(b.streak) == 1 and b.streak_record == 1


def test_spike_is_a_critical_anomaly(spark):
    rows = [("e", 1000 + 100 * i, 10.0) for i in range(30)] + [("e", 4100, 999.0)]
    found = one(signals.anomalies(frame(spark, rows, ["val"]), ["val"]))
    assert found.severity == "critical" and found.z_score == pytest.approx(5.388159) and found.expected == pytest.approx(306.7)


def test_stale_field_is_reported_again(spark):
    rows = [("e", 1000 + 100 * i, 10.0, 1.0) for i in range(30)] + [("e", 4100, 999.0, 1.0), ("e", 4200, None, 1.0)]
    found = signals.anomalies_per_write(frame(spark, rows, ["val", "x"]), ["val", "x"]).orderBy("seq").collect()
    assert [(r.seq, r.actual) for r in found] == [(30, 999.0), (31, pytest.approx(306.7))]


@pytest.mark.parametrize(("h", "value", "sure"), [(3, 167.3917, 0.592655), (20, 357.721, 0.108268)])
def test_forecast_decays(spark, h, value, sure):
    w = frame(spark, [("f", 1000 + 100 * i, 100.0 + 5 * i) for i in range(10)], ["price"])
    f = one(signals.forecast(behavior.field_trends(w, ["price"]), h))
    assert f.projected_value == pytest.approx(value, rel=1e-5) and f.confidence == pytest.approx(sure, rel=1e-5)


def test_lifecycle_as_of(spark):
    day = 86_400_000
    w = frame(spark, [("g", 0, 1.0), ("g", day, 2.0)], ["v"])
    states = [one(behavior.item_behavior(w, ["v"], as_of=t)).lifecycle for t in (day + 8 * day, day + 31 * day)]
    assert states == ["dormant", "dead"]
    back = frame(spark, [("g", 0, 1.0), ("g", 40 * day, 2.0)], ["v"])
    assert one(behavior.item_behavior(back, ["v"])).lifecycle == "resurrected"
    single = frame(spark, [("g", 0, 1.0)], ["v"])
    assert one(behavior.item_behavior(single, ["v"])).lifecycle == "emerging"


def test_batch_equals_fold_on_random_logs(spark):
    r = random.Random(5)
    rows, states = [], {}
    for k in range(12):
        ts = 1_000_000
        for _ in range(r.randint(1, 150)):
            ts += r.choice([0, 1, 500, 3_600_000, 40_000_000, 3_000_000_000])
            rows.append((f"k{k}", ts, r.choice([None, 1.0, 2.0, 3.0, r.uniform(-5, 5)]), r.choice([None, 7.0, r.uniform(0, 1)])))
    for key, ts, a, b in rows:
        values = {f: v for f, v in (("a", a), ("b", b)) if v is not None}
        states[key], _ = fold.write(states.get(key), ts, values)
    w = frame(spark, rows, ["a", "b"])
    for b in behavior.item_behavior(w, ["a", "b"]).collect():
        s = states[b.item_key]
        assert (b.write_count, b.streak, b.streak_record, b.lifecycle) == (s["n"], s["run"], s["record"], s["lifecycle"])
        assert b.velocity == pytest.approx(s["velocity"]) and b.entropy == pytest.approx(fold.entropy(s)) and b.volatility == pytest.approx(fold.volatility(s))
    for t in behavior.field_trends(w, ["a", "b"]).collect():
        held = states[t.item_key]["fields"][t.field]
        assert (t.ema, t.min, t.max, t.last) == pytest.approx((held["ema"], held["min"], held["max"], held["last"]))
        assert t.z_score == pytest.approx(fold.z_score(held), abs=1e-9)
    last = {}
    for t in behavior.trend_history(w, ["a", "b"]).orderBy("ts", "seq").collect():
        last[t.item_key, t.field] = t
    assert all(t.ema == pytest.approx(states[k]["fields"][f]["ema"]) for (k, f), t in last.items())


def test_recommendations_and_expiry(spark):
    w = frame(spark, [("a", 1000 + 100 * i, 100.0 + 10 * i) for i in range(12)], ["price"])
    recs = signals.recommendations(w, ["price"], behavior.item_behavior(w, ["price"]))
    kinds = sorted((r.type, r.basis) for r in recs.collect())
    assert kinds == [("investigate", "streak"), ("promote", "lifecycle.active")]
    assert recs.select("insight_id").collect() == recs.select("insight_id").collect()
    assert signals.select_recommendations(recs, as_of=10**12).isEmpty()


def test_empty_input(spark):
    w = frame(spark, [], ["v"])
    assert behavior.item_behavior(w, ["v"]).isEmpty() and behavior.field_trends(w, ["v"]).isEmpty() and signals.anomalies(w, ["v"]).isEmpty()
