"""The keyed store's relational core: change logs folded to current records, tiers, scans and compaction.

A change log has seq (its order), op (PUT or DELETE), key, ts and typed fields. The last entry of a key wins; a delete is
an entry, so that no older copy comes back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("hot", "warm", "cold")


def latest_by_key(writes: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last record of each key, by partial maxima: a key's rows never meet in one place."""
    fields = [c for c in writes.columns if c != key]
    rest = [c for c in fields if c not in order]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_f"), F.max(F.struct(*order)).alias("_o")).select(key, "_o.*", "_f.*")


def fold_log(log: DataFrame, key: str = "key") -> DataFrame:
    """The records that a log leaves: deleted keys are gone."""
    return latest_by_key(log, key, ("seq",)).where("op = 'PUT'").drop("op")


def with_checksum(log: DataFrame, payload: str = "payload") -> DataFrame:
    return log.withColumn("crc", F.crc32(F.concat_ws("|", "op", "key", payload).cast("binary")))


def intact(log: DataFrame, payload: str = "payload") -> DataFrame:
    """The entries whose checksum holds; damaged ones are skipped, later ones kept."""
    return log.where(F.crc32(F.concat_ws("|", "op", "key", payload).cast("binary")) == F.col("crc")).drop("crc")


def tiered(hot: DataFrame, warm: DataFrame, cold: DataFrame) -> DataFrame:
    """Records of all tiers with tier and tier_rank; columns that a tier lacks are NULL."""
    parts = [t.withColumns({"tier": F.lit(n), "tier_rank": F.lit(k)}) for k, (n, t) in enumerate(zip(TIERS, (hot, warm, cold), strict=True))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tier_lookup(records: DataFrame, key: str = "key") -> DataFrame:
    """Each key's record from the first tier that has it; within a tier the newest. Tombstones hide older tiers and are left out."""
    w = Window.partitionBy(key).orderBy("tier_rank", F.desc("ts"), F.desc("seq"))
    found = records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return found.where("NOT coalesce(deleted, false)").drop("deleted") if "deleted" in records.columns else found


def prefix_scan(records: DataFrame, prefix: str, key: str = "key", hidden: str = "_insight/") -> DataFrame:
    """Records whose key starts with a prefix; insight records are shown only when asked for by their own prefix."""
    found = records.where(F.startswith(F.col(key), F.lit(prefix)))
    return found if prefix.startswith(hidden) else found.where(~F.startswith(F.col(key), F.lit(hidden)))


def compact(files: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The newest record of each key over several files, its own ts kept, and one row of counts: records, kept, deduplicated."""
    kept = latest_by_key(files, key)
    counts = files.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("kept"))
    return kept, counts.withColumn("deduplicated", F.col("records") - F.col("kept"))


def rotation(files: DataFrame, as_of: int, warm_ms: int = 30 * 86_400_000, cold_ms: int = 365 * 86_400_000) -> DataFrame:
    """What rotation does with each file (tier, modified): warm files of an age go cold, cold ones of an age are deleted, the rest stay."""
    age = F.lit(as_of) - F.col("modified")
    action = F.when((F.col("tier") == "warm") & (age >= warm_ms), "to_cold").when((F.col("tier") == "cold") & (age >= cold_ms), "delete").otherwise("keep")
    return files.withColumn("action", action)


def flush_decision(size_bytes: int, dirty: int, max_bytes: int = 4 * 1024 * 1024, max_dirty: int = 1000) -> str | None:
    """Why a flush is due, or None."""
    return "size" if size_bytes > max_bytes else "dirty" if dirty > max_dirty else None


def estimated_bytes(records: DataFrame, fields: list[str], key: str = "key") -> DataFrame:
    """key and bytes: those of the key, of the fields as JSON, and 32 more."""
    size = F.octet_length(key) + F.octet_length(F.to_json(F.struct(*fields))) + 32
    return records.select(key, size.cast("long").alias("bytes"))
