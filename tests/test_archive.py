"""Archives: round trips, queries by item, tampering."""

import glob
import os

import pytest
from chronoloom import model
from chronoloom.functions import scalar
from chronoloom.sources import archive, manifest
from pyspark.sql import functions as F

ROWS = "snapshot_seq long, ts long, item_id long, price double, quantity double"


def golden():
    """48 hourly snapshots of items that come and go."""
    rows = []
    for i in range(48):
        ts = 1_700_000_000 + 3600 * i
        rows += [(i, ts, 1, 10000.0 + 3 * i, 1.0), (i, ts, 2, 20000.0 + (17 * i) % 101 - 50, 2.0)]
        rows += [(i, ts, 3, 99000.0, 1.0)] * (i % 6 == 0) + [(i, ts, 10, 1234.0, 5.0)] * (i % 4 == 0)
    return rows


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/archive"


def test_golden_round_trip(spark, path):
    rows = golden()
    a = archive.Archive(spark, path)
    a.append(spark.createDataFrame(rows, ROWS))
    assert sorted(map(tuple, a.rows().select("snapshot_seq", "ts", "item_id", "price", "quantity").collect())) == sorted(rows) and len(rows) == 116
    assert a.verify() and "price" in a.schema().names
    nested = {r.snapshot_seq: r["items"] for r in a.nested().collect()}
    assert len(nested) == 48 and set(nested[12]) == {1, 2, 3, 10} and nested[1][2].price == 20000.0 + 17 - 50
    assert a.query(3).select("snapshot_seq").distinct().count() == 8 and a.item(3).count() == 8 and a.item(999).isEmpty()
    assert a.item(1, since=1_700_000_000 + 7200, limit=3).count() == 3


def test_two_batches_chain(spark, path):
    a = archive.Archive(spark, path)
    for k, item in ((0, 101), (5, 202)):
        a.append(spark.createDataFrame([(k + i, k + i, item, 100.0 + i, 10.0) for i in range(5)], ROWS))
    assert a.verify() and a.manifest.version() == 1
    assert [a.query(i).count() for i in (101, 202, 999)] == [5, 5, 0]
    again = archive.Archive(spark, path)
    again.append(spark.createDataFrame([(10, 10, 303, 1.0, 1.0)], ROWS))
    assert again.verify() and again.rows().count() == 11
    again.seal()
    with pytest.raises(manifest.ArchiveError):
        again.append(spark.createDataFrame([(11, 11, 303, 1.0, 1.0)], ROWS))


def test_empty_snapshots_come_back(spark, path):
    a = archive.Archive(spark, path)
    times = spark.createDataFrame([(0, 1, 0), (1, 2, 0)], "snapshot_seq long, ts long, n_items int")
    a.append(spark.createDataFrame([], ROWS), times)
    assert [(r.ts, r["items"]) for r in a.nested().orderBy("ts").collect()] == [(1, {}), (2, {})]


def test_doubles_are_exact(spark, path):
    values = [float("nan"), float("inf"), float("-inf"), -0.0, 1.7976931348623157e308, 5e-324, 1e-308, 100.75]
    a = archive.Archive(spark, path)
    a.append(spark.createDataFrame([(i, i, 1, v, 0.125) for i, v in enumerate(values)], ROWS))
    assert [repr(r.price) for r in a.item(1).collect()] == [repr(v) for v in values]


def test_string_keys(spark, path):
    keys = ["file_write|src/auth.py", "shell_exec|rm -rf /", "café", "naïve", "日本語", ""]
    a = archive.Archive(spark, path, key="item_key")
    a.append(spark.createDataFrame([(0, 0, k, 1.0) for k in keys], "snapshot_seq long, ts long, item_key string, score double"))
    assert sorted(r.item_key for r in a.rows().collect()) == sorted(keys) and a.item("café").count() == 1


def test_tampering_is_noticed_before_rows_are_read(spark, path, tmp_path):
    a = archive.Archive(spark, path)
    a.append(spark.createDataFrame(golden(), ROWS))
    (file, *_) = glob.glob(f"{tmp_path}/archive/data/*/part-*.parquet")
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 1
    for crc in glob.glob(f"{os.path.dirname(file)}/.*.crc"):
        os.remove(crc)
    open(file, "wb").write(bytes(data))
    assert not a.verify()
    with pytest.raises(manifest.IntegrityError):
        a.rows()
    assert a.manifest.require(warn_only=True)
    os.remove(file)
    with pytest.raises(manifest.IncompleteDataError):
        a.manifest.require(warn_only=True)
    with pytest.raises(manifest.IncompleteDataError):
        archive.Archive(spark, f"{path}-none").rows()


def test_limits_and_concurrent_writers(spark, path):
    a = archive.Archive(spark, path)
    a.append(spark.createDataFrame(golden(), ROWS))
    with pytest.raises(manifest.LimitExceededError):
        a.rows(limit_bytes=10)
    m = manifest.Manifest(spark, path)
    m.commit(m.entries(), 0)
    with pytest.raises(manifest.ConcurrentWriteError):
        m.commit(m.entries(), 0)


def test_a_writer_that_died_does_not_block_the_next(spark, path, tmp_path):
    a = archive.Archive(spark, path)
    a.append(spark.createDataFrame(golden(), ROWS))
    m = a.manifest
    m._fs.createNewFile(m._at("claim-1.0"))  # and then nothing: no version follows
    with pytest.raises(manifest.ConcurrentWriteError):
        m.commit(m.entries(), 0)
    assert m.commit(m.entries(), 0, claim_ms=0) == 1 and m.version() == 1
    a.append(spark.createDataFrame([(99, 99, 5, 1.0, 1.0)], ROWS))
    assert a.verify() and a.rows().count() == len(golden()) + 1


def test_a_late_writer_whose_claim_was_void_fails(spark, path, monkeypatch):
    a = archive.Archive(spark, path)
    a.append(spark.createDataFrame(golden(), ROWS))
    m, other = a.manifest, manifest.Manifest(spark, path)
    entries, real, calls = m.entries(), m.version, []

    def slow():  # another writer takes the claim over while this one is about to write
        if not calls:
            calls.append(other.commit(entries[:1], 0, claim_ms=0))
        return 0

    monkeypatch.setattr(m, "version", slow)
    with pytest.raises(manifest.ConcurrentWriteError):
        m.commit(entries, 0)
    monkeypatch.setattr(m, "version", real)
    assert m.version() == 1 and len(m.entries()) == 1


def test_queries_open_only_files_that_can_hold_their_rows(spark, path, tmp_path):
    a = archive.Archive(spark, path)
    for first in (0, 1000):  # two batches of other items and times
        rows = [(first + t, first + t, first + i, 1.0 * t, 1.0) for t in range(3) for i in range(400)]
        a.append(spark.createDataFrame(rows, ROWS).repartition(4), rows_per_file=300)
    files = a.files()
    some = a.files(keys=[7])
    assert len(files) >= 8 and len(some) <= 2 and a.files(keys=[5000]) == [] and set(a.files(since=900)) == {f for f in files if "batch=1" in f}
    (tmp_path / some[0].split("archive/")[1]).exists()
    for f in set(files) - set(a.files(keys=[1007])):
        os.remove(f.split("://")[-1] if "://" in f else f[5:])
    assert a.item(1007).count() == 3 and a.item(5000).isEmpty()  # the other files are not even missed
    with pytest.raises(manifest.IncompleteDataError):
        a.rows()


def test_several_items_and_times_sparse_and_statistics(spark, path):
    a = archive.Archive(spark, path)
    a.append(spark.createDataFrame(golden(), ROWS))
    base = 1_700_000_000
    found = a.select([3, 10], [(None, base + 3600 * 6), (base + 3600 * 40, None)])
    want = [r for r in golden() if r[2] in (3, 10) and (r[1] <= base + 3600 * 6 or r[1] >= base + 3600 * 40)]
    assert sorted(map(tuple, found.select("snapshot_seq", "ts", "item_id", "price", "quantity").collect())) == sorted(want)
    assert a.sparse([2, 3], ["quantity"]).columns == ["snapshot_seq", "ts", "item_id", "quantity"] and a.sparse([1, 3], ["price"], True).count() == 48 + 1
    (s,) = a.statistics().collect()
    assert (s.rows, s.snapshots, s.first_ts, s.batches) == (116, 48, base, 1) and s.bytes_per_row > 0


def test_retention(spark, path):
    a = archive.Archive(spark, path)
    for k in range(3):
        a.append(spark.createDataFrame([(k, 100 * k, 1, 1.0, 1.0)], ROWS))
    assert a.due_for_rotation(now=1000) == [] and a.due_for_rotation(now=250, max_age_ms=100) == ["batch=0", "batch=1"]
    assert a.due_for_rotation(now=0, max_batches=2) == ["batch=0"] and a.due_for_rotation(now=0, max_bytes=0) == ["batch=0", "batch=1", "batch=2"]
    early = a.rows()
    a.drop_batches(["batch=0"])
    assert a.rows().count() == 2 and early.count() == 3 and a.verify()  # a reader that holds the earlier version goes on
    assert a.vacuum(older_ms=0) >= 1 and a.rows().count() == 2


def test_encryption(spark, path):
    key = scalar.derive_key("secret", b"salt", 1000)
    a = archive.Archive(spark, path, encryption_key=key)
    a.append(spark.createDataFrame(golden(), ROWS))
    assert sorted(map(tuple, a.rows().select("snapshot_seq", "ts", "item_id", "price", "quantity").collect())) == sorted(golden())
    with pytest.raises(Exception, match="(?i)aes|decrypt|key"):
        archive.Archive(spark, path, encryption_key=scalar.derive_key("wrong", b"salt", 1000)).rows().collect()
    assert "price" not in archive.Archive(spark, path).rows().columns


def test_segments(spark):
    times = spark.createDataFrame([(i, i, 4) for i in range(10)], "snapshot_seq long, ts long, n_items int")
    assert [r.segment for r in archive.segment_ids(times, 120).orderBy("snapshot_seq").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_extras(spark):
    rows = spark.createDataFrame(golden(), ROWS)
    stats = {r.item_id: r for r in archive.item_stats(rows).collect()}
    assert stats[1].trend == "up" and stats[3].trend == "stable" and stats[1].min == 10000
    gain, loss, mood = archive.market_movers(archive.item_stats(rows))
    assert gain.first().item_id == 1 and mood.first()["items"] == 4
    assert {r.item_id: r.tier for r in archive.activity_scores(rows).collect()}[3] == "cold"
    kinds = archive.snapshot_deltas(rows).where("item_id = 3").groupBy("change").count().collect()
    assert {r.change: r["count"] for r in kinds} == {"added": 8, "removed": 8}


def test_model(spark):
    assert model.TRUST_EVENTS["outcome"].metadata["enum"]["timeout"] == 3 and model.MARKET_DATA["item_id"].metadata["profile"] == "market_data_v1"
    df = spark.createDataFrame([("error",), ("new",), (None,)], "outcome string")
    coded = df.select(model.encode_category(F.col("outcome"), model.OUTCOMES).alias("c"))
    assert [r.c for r in coded.collect()] == [2, 0, 0]
    assert [r.t for r in coded.select(model.decode_category(F.col("c"), model.OUTCOMES).alias("t")).collect()] == ["error", "approved", "approved"]
    keys = spark.createDataFrame([("_insight/behavior/a|b",), ("a|b",)], "k string")
    found = keys.select(model.is_insight(F.col("k")).alias("i"), model.insight_target(F.col("k")).alias("t"), scalar.scope(F.col("k")).alias("s")).collect()
    assert [(r.i, r.t) for r in found] == [(True, "a|b"), (False, "a|b")] and found[1].s == "a"
    rows, times = model.to_long(spark.sql("SELECT 0L AS snapshot_seq, 5L AS ts, map(1L, struct(2.0D AS price)) AS items"))
    assert rows.first().price == 2.0 and times.first().n_items == 1
