"""Codec arithmetic, block metrics and block health on fixed cases."""

import random

import pytest
from chronoloom.functions import scalar
from chronoloom.operators import blocks
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def stream(spark, values, name="s", kind="long"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], f"stream string, pos long, v {kind}")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=40))
def test_codecs_round_trip(spark, values):
    s = stream(spark, values)
    back = lambda df: [r.v for r in df.orderBy("pos").collect()]
    assert back(blocks.undo_delta(blocks.delta(s).select("stream", "pos", "d"))) == values
    assert back(blocks.undo_delta_of_delta(blocks.delta_of_delta(s).select("stream", "pos", "dd"))) == values
    assert back(blocks.undo_run_lengths(blocks.run_lengths(s))) == values


def test_ranges_of_a_stream_join_without_a_seam(spark):
    r = random.Random(3)
    rows = [("a", i, r.choice([1, 1, 1, 5])) for i in range(101)] + [("b", i, 7) for i in range(60)] + [("c", 0, -3)]
    s = spark.createDataFrame(rows, "stream string, pos long, v long")
    every = lambda df: sorted(map(tuple, df.collect()))
    for span in (4, 7, 64):
        assert every(blocks.delta(s, span)) == every(blocks.delta(s)) and every(blocks.delta_of_delta(s, span)) == every(blocks.delta_of_delta(s))
        assert every(blocks.undo_delta(blocks.delta(s).select("stream", "pos", "d"), span=span).select("stream", "pos", "v")) == sorted(rows)
        assert every(blocks.undo_delta_of_delta(blocks.delta_of_delta(s).select("stream", "pos", "dd"), span).select("stream", "pos", "v")) == sorted(rows)
        assert every(blocks.run_lengths(s, 25, span)) == every(blocks.run_lengths(s, 25))
    assert every(blocks.run_lengths(s, 25, 7).where("stream = 'b'")) == [("b", 0, 25, 7), ("b", 25, 25, 7), ("b", 50, 10, 7)]


def test_places_of_a_group_that_spans_ranges(spark):
    from chronoloom.operators.ranks import placed, ranked

    r = random.Random(8)
    rows = [("big" if i % 5 else f"g{i}", r.random(), i) for i in range(400)] + [(None, 0.5, 1000), (None, 0.1, 1001)]
    df = spark.createDataFrame(rows, "g string, at double, seq long").repartition(7)
    want = {}
    for g, at, seq in sorted(rows, key=lambda x: (x[1], x[2])):
        want.setdefault(g, []).append(seq)
    found = {}
    for x in placed(df, "g", ["at", "seq"]).collect():
        found[x.g, x.pos] = x.seq
    assert found == {(g, k): seq for g, held in want.items() for k, seq in enumerate(held)}
    numbers = spark.range(500).select((F.col("id") * 3).alias("v"))
    assert sorted(map(tuple, ranked(numbers, "v", "r", 1).collect())) == [(3 * k, k + 1) for k in range(500)]


def plain_dictionary(values, entries=256):
    """Bytes of each value: a recent one by its place in the ring, another by itself, as varints that tell which."""
    recent, at, out = {}, 0, []
    for v in values:
        slot = next((k for k, x in recent.items() if x == v), None)
        code = slot * 2 + 1 if slot is not None else (v * 2 if v >= 0 else -v * 2 - 1) * 2
        if slot is None:
            recent[at] = v
            at = (at + 1) % entries
        n, code = 1, code * 2  # the varint is of the zigzag form
        while code >= 128:
            n, code = n + 1, code >> 7
        out.append(n)
    return out


def test_dictionary_codec_query_equals_a_plain_loop(spark, sf_dir):
    from chronoloom.plans import blocks as plans

    coded = {}
    for r in sorted(blocks.delta(plans.value_streams(spark, sf_dir)).collect(), key=lambda r: (r.stream, r.pos)):
        coded.setdefault(r.stream, []).append(r.d)
    want = {(s, k // 500): sum(sizes[k : k + 500]) for s, d in coded.items() for sizes in [plain_dictionary(d)] for k in range(0, len(d), 500)}
    found = plans.dictionary_codec_sizes(spark, sf_dir).collect()
    assert {(r.stream, r.block): r["dict"] for r in found} == want


def plain_health(rows, every=4):
    """Decisions and segments of one stream's blocks (block, unique, unique_delta, ratio), told block by block in plain words."""
    usual, spread, share, seen, bad, probes_in_row = 2.0, 0.5, 0.5, 0, None, 0
    out, segments = [], []
    for block, unique, change, ratio in rows:
        seen += 1
        drop = ratio < usual - min(3 * spread, usual * 0.9)
        burst = not drop and unique > 0.5 and unique > share * 1.5 and ratio < usual
        name = "RATIO_DROP" if drop else "ENTROPY_BURST" if burst else None
        back = ratio >= usual - 10 * max(spread, 0.1)
        gate = unique > 0.85 and change > 0.85
        if bad is None:
            if gate or name:
                out.append((block, "QUARANTINE", "ENTROPY_GATE" if gate else name, 17))
                bad, probes_in_row = [len(segments) + 1, block, None, name or "UNKNOWN", ratio, unique, 0, 0], 0
                segments.append(bad)
            else:
                out.append((block, "CORE", None, 0))
                if unique <= 0.8 and seen == 1:
                    usual, spread, share = ratio, ratio * 0.1, unique
                elif unique <= 0.8:
                    spread = 0.1 * abs(ratio - usual) + 0.9 * spread
                    usual, share = 0.1 * ratio + 0.9 * usual, 0.1 * unique + 0.9 * share
            continue
        probe = block % every == 0
        if not gate and probe and back and probes_in_row >= 2:
            out.append((block, "CORE", "RECOVERY_MATCH", 4))
            bad[2], bad, probes_in_row = block, None, 0
            continue
        why = "ENTROPY_GATE" if gate else "QUARANTINE_ACTIVE" if not probe else "RECOVERY_PENDING" if back else "RECOVERY_PROBE_FAIL"
        out.append((block, "QUARANTINE", why, 18))
        bad[4], bad[5] = min(bad[4], ratio), max(bad[5], unique)
        if probe:
            bad[6], bad[7] = bad[6] + 1, bad[7] + back
            probes_in_row = probes_in_row + 1 if back else 0
    for s in segments:
        s[2] = rows[-1][0] if s[2] is None else s[2]
    return out, segments


def test_health_of_random_streams_equals_a_plain_loop(spark):
    r, rows = random.Random(12), []
    for s in range(12):
        level = r.choice([1.2, 2.0, 6.0])
        for k in range(r.choice([1, 9, 150])):
            rows.append((f"s{s}", k, r.choice([0.1, 0.4, 0.7, 0.9]), r.choice([0.2, 0.9]), max(0.05, level * r.choice([1, 1, 1, 1.1, 0.9, 0.2]))))
    shuffled = r.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "stream string, block long, unique_ratio double, unique_delta_ratio double, ratio double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # streams reach over batches
    routed = {(x.stream, x.block): (x.decision, x.reason, x.flags) for x in blocks.chm_routing(df).collect()}
    segments = sorted(tuple(x) for x in blocks.chm_segments(df).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, ended = {}, []
    for s in {x[0] for x in rows}:
        out, bad = plain_health([x[1:] for x in rows if x[0] == s])
        want |= {(s, b): (d, why, f) for b, d, why, f in out}
        ended += [(s, *x) for x in bad]
    assert routed == want and segments == sorted(ended) and len(ended) > 5


def test_health_queries_equal_a_plain_loop(spark, sf_dir):
    from chronoloom.plans import blocks as plans

    held = {}
    for x in plans.profiled_blocks(spark, sf_dir).collect():
        held.setdefault(x.stream, []).append((x.block, x.unique_ratio, x.unique_delta_ratio, x.ratio, 8 * x.n, x.bytes))
    want, ended, sums = {}, [], {}
    for s, rows in held.items():
        rows.sort()
        out, bad = plain_health([x[:4] for x in rows])
        ended += [(s, *x) for x in bad]
        for (b, d, why, f), x in zip(out, rows, strict=True):
            want[s, b] = (d, why, f)
            n, i, o = sums.get(d, (0, 0, 0))
            sums[d] = (n + 1, i + x[4], o + x[5])
    assert {(x.stream, x.block): (x.decision, x.reason, x.flags) for x in plans.chm_routing(spark, sf_dir).collect()} == want
    assert sorted(tuple(x) for x in plans.chm_report(spark, sf_dir).collect()) == sorted(ended)
    assert {x.decision: (x.blocks, x.input_bytes, x.output_bytes, x.ratio) for x in plans.chm_telemetry(spark, sf_dir).collect()} == {d: (n, i, o, i / o) for d, (n, i, o) in sums.items()}


def test_runs_are_cut_at_255(spark):
    found = blocks.run_lengths(stream(spark, [4] * 600 + [5])).orderBy("start").collect()
    assert [(r.start, r.length, r.v) for r in found] == [(0, 255, 4), (255, 255, 4), (510, 90, 4), (600, 1, 5)]


def test_varint_and_zigzag(spark):
    df = spark.createDataFrame([(v,) for v in (0, -1, 1, 63, 64, -64, -65, 2**40)], "v long")
    found = df.select(scalar.zigzag(F.col("v")).alias("z"), scalar.varint_bytes(F.col("v")).alias("n")).collect()
    assert [r.z for r in found[:3]] == [0, 1, 2] and [r.n for r in found] == [1, 1, 1, 1, 2, 1, 2, 6]


def test_regimes(spark):
    r = random.Random(1)
    s = stream(spark, [float(i) for i in range(100)], "up", "double").union(stream(spark, [r.uniform(-1e6, 1e6) for _ in range(100)], "wild", "double"))
    found = {x.stream: x for x in blocks.block_metrics(s).collect()}
    assert found["up"].regime == "ORDERED" and found["wild"].regime == "CHAOTIC" and found["up"].monotonicity_score == 1


def test_single_value_block(spark):
    (m,) = blocks.block_metrics(stream(spark, [3.0], kind="double")).collect()
    assert (m.n, m.unique_ratio, m.monotonicity_score, m.p90_abs_delta, m.sign_flip_rate) == (1, 1, 1, 0, 0)


def test_dictionary_is_sorted(spark):
    found = blocks.dictionary(spark.createDataFrame([("b",), ("a",), ("ä",), ("b",), (None,)], "k string"), "k").orderBy("id").collect()
    assert [(r.key, r.id) for r in found] == [("a", 0), ("b", 1), ("ä", 2)]


def test_dictionary_codec_repeats_are_small(spark):
    (same,) = blocks.dictionary_sizes(stream(spark, [1_000_000] * 10), "v").collect()
    (fresh,) = blocks.dictionary_sizes(stream(spark, [1_000_000 * i for i in range(1, 11)]), "v").collect()
    assert same["dict"] < fresh["dict"]


def route(ratios, uniques, every=4):
    h, out, ended = blocks.Health(), [], []
    for k, (ratio, unique) in enumerate(zip(ratios, uniques, strict=True)):
        h, decision, reason, flags, closed = blocks.health_step(h, k, unique, unique, ratio, blocks.Limits(every))
        out.append((decision, reason, flags))
        ended += [closed] * (closed is not None)
    return out, ended


def test_entropy_gate():
    assert route([2.0], [0.9])[0][0][:2] == ("QUARANTINE", "ENTROPY_GATE")


def test_ratio_drop_starts_an_anomaly():
    out, _ = route([2.0] * 5 + [0.5], [0.2] * 6)
    assert out[4] == ("CORE", None, 0) and out[5] == ("QUARANTINE", "RATIO_DROP", blocks.START | blocks.QUARANTINED)


def test_entropy_burst():
    out, _ = route([2.0] * 5 + [1.95], [0.2] * 5 + [0.8])
    assert out[5][1] == "ENTROPY_BURST"


def test_recovery_after_three_probes():
    out, ended = route([0.1] + [5.0] * 12, [0.2] * 13)
    assert out[0][0] == "QUARANTINE"
    assert [out[k][1] for k in (4, 8, 12)] == ["RECOVERY_PENDING", "RECOVERY_PENDING", "RECOVERY_MATCH"]
    assert out[12][0] == "CORE" and out[12][2] == blocks.END and ended[0].end_block == 12


def test_routing_follows_each_stream_in_order(spark):
    rows = [(s, k, 0.2, 0.2, 2.0 if k < 5 else 0.5) for s in ("x", "y") for k in range(8)]
    df = spark.createDataFrame(rows, "stream string, block long, unique_ratio double, unique_delta_ratio double, ratio double")
    found = blocks.chm_routing(df).where("decision = 'QUARANTINE'").groupBy("stream").agg(F.min("block").alias("b"), F.count("*").alias("n")).collect()
    assert {(r.stream, r.b, r.n) for r in found} == {("x", 5, 3), ("y", 5, 3)}
    (seg,) = blocks.chm_segments(df.where("stream = 'x'")).collect()
    assert (seg.start_block, seg.end_block, seg.reason) == (5, 7, "RATIO_DROP")
    assert blocks.worst_blocks(df, 3).count() == 6


def test_profile(spark):
    with pytest.raises(ValueError):
        blocks.profile_storage(stream(spark, []))
    found = blocks.profile_storage(stream(spark, list(range(3000))))
    assert len(found["trials"]) == 6 and found["best"]["ratio"] == pytest.approx(max(t["ratio"] for t in found["trials"]), rel=0.01)


def test_item_major(spark):
    full = spark.createDataFrame([(s, i) for s in range(3) for i in range(4)], "snapshot_seq long, item_id long")
    assert blocks.item_major(full).first().eligible and not blocks.item_major(full.where("NOT (snapshot_seq = 1 AND item_id = 2)")).first().eligible


def test_report_file(spark, tmp_path):
    rows = [("x", k, 0.2, 0.2, 2.0 if k < 5 else 0.5) for k in range(8)]
    df = spark.createDataFrame(rows, "stream string, block long, unique_ratio double, unique_delta_ratio double, ratio double")
    blocks.write_report(df, f"{tmp_path}/report", "run-1")
    found = spark.read.json(f"{tmp_path}/report")
    assert {(r.kind, r["count"]) for r in found.groupBy("kind").count().collect()} == {("segment", 1), ("worst_block", 8)} and found.first().run_id == "run-1"
