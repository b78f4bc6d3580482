"""Snapshot archives: lossless Parquet with a manifest, queryable by item.

Rows lie sorted by item and time within files, with bloom filters on the item column, so that a query for an item skips
files, row groups and pages. A side table holds every snapshot with its number of items, empty ones too. Both are chained
in one manifest, which has each file's ranges of item and time: a query opens the files that can hold its rows, and what
it opens is checked first.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalar
from chronoloom.model import to_nested
from chronoloom.operators.ranks import ranked
from chronoloom.sources.manifest import ArchiveError, IncompleteDataError, Manifest, chain, new_files

SEGMENT_BYTES = 1 << 20


def segment_ids(snapshots: DataFrame, limit: int = SEGMENT_BYTES) -> DataFrame:
    """snapshots (snapshot_seq, n_items) with segment: a segment closes with the snapshot whose size, 12 bytes and 12 for each item, fills it.

    Where one segment ends depends on all before it, so this is one pass in order; what it reads is two numbers a snapshot.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = held = 0
        for b in batches:
            out = []
            for n in b.column(1).to_pylist():
                out.append(segment)
                held += 12 + 12 * n
                if held >= limit:
                    segment, held = segment + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["snapshot_seq", "n_items", "segment"])

    ordered = snapshots.select(F.col("snapshot_seq").cast("long"), F.col("n_items").cast("long").alias("n_items")).repartition(1).sortWithinPartitions("snapshot_seq")
    return ordered.mapInArrow(cut, "snapshot_seq long, n_items long, segment long")


def with_snapshot_seq(rows: DataFrame) -> DataFrame:
    """Rows (ts, item, …) with snapshot_seq, the rank of their ts from 0; times are ranked on their own, range by range."""
    return rows.join(ranked(rows.select("ts").distinct(), "ts", "snapshot_seq"), "ts").select("snapshot_seq", *rows.columns)


def snapshot_table(rows: DataFrame) -> DataFrame:
    """snapshot_seq, ts and n_items of the snapshots that have rows."""
    return rows.groupBy("snapshot_seq", "ts").agg(F.count(F.lit(1)).cast("int").alias("n_items"))


class Archive:
    """One archive folder: `data` (item rows), `snapshots` and `_manifest`."""

    def __init__(self, spark: SparkSession, path: str, key: str = "item_id", encryption_key: bytes | None = None):
        self.spark, self.path, self.key, self.encryption_key = spark, path.rstrip("/"), key, encryption_key
        self.manifest = Manifest(spark, self.path)
        self.sealed = False

    def append(self, rows: DataFrame, snapshots: DataFrame | None = None, level: int = 3, rows_per_file: int = 5_000_000, part: str | None = None) -> int:
        """Add a batch, chained to what is there; returns the manifest's version. snapshots adds those without items; part names the batch.

        The batch is dealt by ranges of item, so an item lies in few files whatever its number of rows. rows should come
        from files: the ranges are sampled from them before they are written.
        """
        if self.sealed:
            raise ArchiveError("the archive is sealed")
        version = self.manifest.version()
        held = self.manifest.entries()
        batch = f"batch={version + 1 if part is None else part}"
        options = {
            "compression": "zstd",
            "parquet.compression.codec.zstd.level": str(level),
            "parquet.writer.version": "PARQUET_2_0",
            f"parquet.bloom.filter.enabled#{self.key}": "true",
            "maxRecordsPerFile": str(rows_per_file),
        }
        laid_out = self._sealed_rows(rows) if self.encryption_key else rows
        order = [self.key, "ts", "snapshot_seq"]
        ordered = laid_out.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.write.mode("overwrite").options(**options).parquet(f"{self.path}/data/{batch}")
        # counted from what was written, so that rows are not computed again
        times = snapshots if snapshots is not None else snapshot_table(self.spark.read.schema(laid_out.schema).parquet(f"{self.path}/data/{batch}"))
        times.select("snapshot_seq", "ts", "n_items").sortWithinPartitions("snapshot_seq").write.mode("overwrite").options(compression="zstd").parquet(f"{self.path}/snapshots/{batch}")
        with ThreadPoolExecutor(2) as pool:  # small jobs, side by side
            found = pool.map(lambda x: new_files(self.spark, self.path, f"{x[0]}/{batch}", x[1]), [("data", self.key), ("snapshots", "snapshot_seq")])
            new = [f for files in found for f in files]
        return self.manifest.commit(chain(new, held), version)

    def seal(self) -> None:
        """No more rows through this handle."""
        self.sealed = True

    def _fields(self, columns: list[str]) -> list[str]:
        return [c for c in columns if c not in ("snapshot_seq", "ts", self.key)]

    def _sealed_rows(self, rows: DataFrame) -> DataFrame:
        payload = F.to_json(F.struct(*self._fields(rows.columns)), {"ignoreNullFields": "false"}).cast("binary")
        schema = F.lit(rows.select(*self._fields(rows.columns)).schema.json())
        return rows.select("snapshot_seq", "ts", self.key, scalar.encrypted(payload, self.encryption_key, self.key).alias("payload"), schema.alias("payload_schema"))

    def files(self, part: str = "data", keys: list | None = None, since: int | None = None, until: int | None = None, **limits) -> list[str]:
        """The files that can hold rows of these items within these times, checked."""
        return self.manifest.require(only=lambda e: e.file.startswith(f"{part}/") and e.may_hold(keys, since, until), **limits)

    def _read(self, files: list[str], part: str = "data") -> DataFrame:
        if files:
            return self.spark.read.parquet(*files)
        entries = [e for e in self.manifest.entries() if e.file.startswith(f"{part}/")]
        if not entries:
            raise IncompleteDataError(f"{self.path} has no {part}")
        return self.spark.read.parquet(f"{self.path}/{entries[0].file}").limit(0)

    def rows(self, warn_only: bool = False, limit_bytes: int | None = None, keys: list | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
        """All item rows of the files that can hold these items within these times (all files, where nothing is asked).

        A changed or missing file among them raises before any row is read.
        """
        raw = self._read(self.files("data", keys, since, until, warn_only=warn_only, limit_bytes=limit_bytes))
        if self.encryption_key is None or "payload" not in raw.columns:
            return raw
        from pyspark.sql.types import StructType

        first = raw.select("payload_schema").first()
        kind = StructType.fromJson(__import__("json").loads(first[0])) if first else StructType([])
        plain = F.from_json(scalar.decrypted(F.col("payload"), self.encryption_key, self.key).cast("string"), kind)
        return raw.select("snapshot_seq", "ts", self.key, plain.alias("_p")).select("snapshot_seq", "ts", self.key, "_p.*")

    def snapshots(self, warn_only: bool = False) -> DataFrame:
        return self._read(self.files("snapshots", warn_only=warn_only), "snapshots")

    def nested(self) -> DataFrame:
        """Snapshots with items as maps, empty ones too."""
        return to_nested(self.rows(), self.snapshots(), self.key)

    def schema(self):
        """The rows' schema; reads a footer only."""
        return self.spark.read.parquet(f"{self.path}/data").drop("batch").schema

    def item(self, value, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
        """An item's history; only files that can hold it are opened, and the filters reach their scan."""
        found = self.select([value], [(since, until)]).orderBy("ts", "snapshot_seq")
        return found if limit is None else found.limit(limit)

    def select(self, keys: list | None = None, times: list[tuple[int | None, int | None]] | None = None) -> DataFrame:
        """Rows of any of these items within any of these times (since, until: both included, None: open); None asks for all."""
        low = None if not times or any(a is None for a, _ in times) else min(a for a, _ in times)
        high = None if not times or any(b is None for _, b in times) else max(b for _, b in times)
        found = self.rows(keys=keys, since=low, until=high)
        if keys is not None:
            found = found.where(F.col(self.key).isin(*keys))
        if times is not None:
            within = F.lit(False)
            for a, b in times:
                within = within | ((F.lit(True) if a is None else F.col("ts") >= a) & (F.lit(True) if b is None else F.col("ts") <= b))
            found = found.where(within)
        return found

    def sparse(self, keys: list, fields: list[str], changed_only: bool = False) -> DataFrame:
        """snapshot_seq, ts, item and the named fields of some items; with changed_only the rows in which one of the fields is new."""
        found = self.select(keys).select("snapshot_seq", "ts", self.key, *fields)
        if not changed_only:
            return found
        now = F.struct(*fields)
        was = F.lag(now).over(Window.partitionBy(self.key).orderBy("ts", "snapshot_seq"))
        return found.withColumn("_new", ~was.eqNullSafe(now)).where("_new").drop("_new")

    def statistics(self) -> DataFrame:
        """One row: files, bytes, batches, rows, items, snapshots, first_ts, last_ts, bytes_per_row. The formulas are ours."""
        data = [e for e in self.manifest.entries() if e.file.startswith("data/")]
        size = sum(e.bytes for e in data)
        return self.rows().agg(
            F.lit(len(data)).alias("files"), F.lit(size).cast("long").alias("bytes"), F.lit(len({e.file.split("/")[1] for e in data})).alias("batches"), F.count(F.lit(1)).alias("rows"),
            F.approx_count_distinct(self.key).alias("items"), F.countDistinct("snapshot_seq").alias("snapshots"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        ).withColumn("bytes_per_row", F.try_divide("bytes", "rows"))

    def due_for_rotation(self, now: int, max_age_ms: int | None = None, max_bytes: int | None = None, max_batches: int | None = None) -> list[str]:
        """Batches that a retention policy lets go, oldest first: over an age (by their last row), or beyond a total size or number. The policy is ours."""
        held: dict[str, list] = {}
        for e in self.manifest.entries():
            if e.file.startswith("data/"):
                held.setdefault(e.file.split("/")[1], []).append(e)
        oldest = sorted(held, key=lambda b: (max((e.until if e.until is not None else -1 for e in held[b]), default=-1), b))
        due, size = [], sum(e.bytes for files in held.values() for e in files)
        for b in oldest:
            last = max((e.until for e in held[b] if e.until is not None), default=None)
            old = max_age_ms is not None and last is not None and now - last > max_age_ms
            if not (old or max_bytes is not None and size > max_bytes or max_batches is not None and len(held) - len(due) > max_batches):
                break
            due.append(b)
            size -= sum(e.bytes for e in held[b])
        return due

    def drop_batches(self, batches: list[str]) -> int:
        """A version of the manifest without these batches; files stay for readers of earlier versions until `vacuum`."""
        version = self.manifest.version()
        return self.manifest.commit(chain([e for e in self.manifest.entries(version) if e.file.split("/")[1] not in batches]), version)

    def vacuum(self, older_ms: int = 86_400_000) -> int:
        """Delete data files that no manifest entry names and that are older than older_ms; returns their number."""
        return self.manifest.vacuum(older_ms)

    def query(self, value) -> DataFrame:
        """The whole snapshots that hold an item, all their rows; which snapshots do is read from the item's files alone."""
        wanted = self.rows(keys=[value]).where(F.col(self.key) == value).select("snapshot_seq").distinct()
        return self.rows().join(wanted, "snapshot_seq", "left_semi")

    def verify(self) -> bool:
        return self.manifest.verify()


def snapshots_with_item(rows: DataFrame, value, key: str = "item_id") -> DataFrame:
    """All rows of the snapshots that hold an item."""
    return rows.join(rows.where(F.col(key) == value).select("snapshot_seq").distinct(), "snapshot_seq", "left_semi")


def item_stats(rows: DataFrame, key: str = "item_id", value: str = "price") -> DataFrame:
    """min, max, avg, volatility (standard deviation), first, last, trend and trend_percent of each item. The formulas are ours."""
    at = F.struct("ts", "snapshot_seq")
    out = rows.groupBy(key).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("volatility"),
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"),
    )
    change = F.col("last") - F.col("first")
    percent = F.coalesce(F.try_divide(change * 100, F.abs("first")), F.lit(0.0))
    trend = F.when(change > 0, "up").when(change < 0, "down").otherwise("stable")
    return out.withColumns({"trend": trend, "trend_percent": percent})


def market_movers(stats: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Top gainers, top losers, and one row of sentiment: the share of items that rise less the share that fall."""
    gain = stats.where("trend_percent > 0").orderBy(F.desc("trend_percent"), stats.columns[0]).limit(most)
    loss = stats.where("trend_percent < 0").orderBy("trend_percent", stats.columns[0]).limit(most)
    return gain, loss, stats.agg(F.avg(F.signum("trend_percent")).alias("sentiment"), F.count(F.lit(1)).alias("items"))


def activity_scores(rows: DataFrame, key: str = "item_id", value: str = "price") -> DataFrame:
    """score (0 to 1: the share of an item's snapshots in which it changed) and tier (hot from 0.8, cold below 0.2, else warm). The formula is ours."""
    w = Window.partitionBy(key).orderBy("ts", "snapshot_seq")
    moved = rows.select(key, (F.col(value) != F.lag(value).over(w)).cast("int").alias("m"))
    score = moved.groupBy(key).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("score"))
    return score.withColumn("tier", F.when(F.col("score") >= 0.8, "hot").when(F.col("score") < 0.2, "cold").otherwise("warm"))


def snapshot_deltas(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """What changes from one snapshot to the next: snapshot_seq, key, change (added, changed, removed) and the new fields.

    An item's row is compared with its row before; where snapshots between lack it, it was removed after the one and is
    added in the other.
    """
    fields = [c for c in rows.columns if c not in ("snapshot_seq", "ts", key)]
    last = rows.agg(F.max("snapshot_seq").alias("last_seq"))
    w = Window.partitionBy(key).orderBy("snapshot_seq")
    now, was = F.struct(*fields), F.lag(F.struct("snapshot_seq", F.struct(*fields).alias("f"))).over(w)
    seen = rows.select("snapshot_seq", key, now.alias("now"), was.alias("was"), F.lead("snapshot_seq").over(w).alias("next")).crossJoin(F.broadcast(last))
    step = F.col("snapshot_seq") - 1
    state = F.when(F.col("was").isNull() | (F.col("was.snapshot_seq") < step), "added").when(~F.col("was.f").eqNullSafe(F.col("now")), "changed")
    changed = seen.select("snapshot_seq", key, state.alias("change"), *[F.col(f"now.{f}").alias(f) for f in fields]).where("change IS NOT NULL")
    leaves = (F.coalesce(F.col("next"), F.col("last_seq") + 1) > F.col("snapshot_seq") + 1) & (F.col("snapshot_seq") < F.col("last_seq"))
    removed = seen.where(leaves).select(
        (F.col("snapshot_seq") + 1).alias("snapshot_seq"), key, F.lit("removed").alias("change"), *[F.lit(None).cast(rows.schema[f].dataType).alias(f) for f in fields]
    )
    return changed.unionByName(removed)
