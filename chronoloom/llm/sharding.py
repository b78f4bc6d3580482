"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots. Bytes and rows are summed per slot, and a versioned table maps slots to
shards. The map is the only thing that is edited when shards are added or drift apart: records never hash anew, and a
rebalance moves whole slots, as few as will do. Rows, not the map, are distributed work: the map has n_slots entries,
a parameter that does not grow with the data, so it may be planned on the driver and broadcast.

Defined results: null text has no bytes; null ids hash like any other value; repeated rows are placed one by one, in
one virtual slot; an empty table gives no rows and a map whose slots are all empty; other columns of the input, whatever
their names, play no part.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, text_or_empty, work_path

N_SLOTS = 8192
ROW_BYTES = 8


def slot_rows(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record.

    The slot hashes the record (id, checksum and size), so that neither one id nor one text that many rows share fills
    a slot alone.
    """
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any; partial sums come before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def plan_slots(sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each slot: largest slots first, each to the shard with the fewest bytes so far (ties: lower number)."""
    load = [(0, 0, s) for s in range(n_shards)]
    shard = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        total, held, s = heapq.heappop(load)
        shard[slot] = s
        heapq.heappush(load, (total + sizes[slot], held + 1, s))
    return shard


def rebalance_slots(shard: list[int], sizes: list[int], n_shards: int, slack: float = 0.01) -> list[int]:
    """An edited map: slots of shards that no longer exist move, then slots leave the fullest shard for the emptiest
    until they are within slack of the mean or no move narrows the gap. All other slots stay where they are."""
    out = list(shard)
    load = [0] * n_shards
    homeless = []
    for slot, s in enumerate(out):
        if s < n_shards:
            load[s] += sizes[slot]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda k: (-sizes[k], k)):
        out[slot] = min(range(n_shards), key=lambda s: (load[s], s))
        load[out[slot]] += sizes[slot]
    members: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, s in enumerate(out):
        members[s].append(slot)
    mean = sum(load) / n_shards
    while mean:
        full = max(range(n_shards), key=lambda s: (load[s], -s))
        low = min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        if gap <= 2 * slack * mean:
            break
        fits = [k for k in members[full] if 0 < sizes[k] < gap]
        if not fits:
            break
        slot = min(fits, key=lambda k: (abs(gap - 2 * sizes[k]), k))
        members[full].remove(slot)
        members[low].append(slot)
        out[slot] = low
        load[full] -= sizes[slot]
        load[low] += sizes[slot]
    return out


def slot_map(spark: SparkSession, shard: list[int], sizes: list[int], rows: list[int], version: int) -> DataFrame:
    """The map as a DataFrame: version, virtual_slot, shard, bytes, rows and first_row, the rows of the shard's earlier slots."""
    seen: dict[int, int] = {}
    first = []
    for s, n in zip(shard, rows, strict=True):
        first.append(seen.get(s, 0))
        seen[s] = seen.get(s, 0) + n
    entries = F.lit(json.dumps(list(zip(shard, sizes, rows, first, strict=True))))
    held = F.from_json(entries, "array<array<bigint>>")
    return (
        spark.range(1)
        .select(F.posexplode(held).alias("virtual_slot", "v"))
        .select(
            F.lit(version).alias("version"),
            F.col("virtual_slot"),
            F.col("v")[0].cast("int").alias("shard"),
            F.col("v")[1].alias("bytes"),
            F.col("v")[2].alias("rows"),
            F.col("v")[3].alias("first_row"),
        )
    )


class SlotMapStore:
    """Versions of a slot map below one path; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, table: DataFrame, version: int) -> DataFrame:
        where = f"{self.path}/version={version}"
        table.drop("version").coalesce(1).write.mode("errorifexists").parquet(where)
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}").withColumn("version", F.lit(version))

    def grow(self, version: int, n_shards: int) -> DataFrame:
        """The next version, for another number of shards, by moving as few slots as balance takes."""
        held = self.read(version).orderBy("virtual_slot").collect()  # n_slots rows, a fixed number
        sizes, rows = [r["bytes"] for r in held], [r["rows"] for r in held]
        shard = rebalance_slots([r["shard"] for r in held], sizes, n_shards)
        return self.commit(slot_map(self.spark, shard, sizes, rows, version + 1), version + 1)


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, store: str | None = None) -> DataFrame:
    """Each record's shard, by the law `bytes`: shards have near-equal sizes.

    Returns doc_id, size, text_crc32, law, shard, slot (the record's place in its shard, gapless from 0), grown_shard
    (null under this law), virtual_slot and map_version. Only the narrow record table is shuffled, once, by virtual
    slot; a place in a shard is the slot's first row in the map plus the row's rank in the slot.
    """
    spark = docs.sparkSession
    rows = materialize(slot_rows(docs, n_slots), "slot-rows")
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in slot_totals(rows).collect():  # n_slots rows at most
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["bytes"], r["rows"]
    kept = SlotMapStore(spark, store or work_path(spark, "slot-map"))
    table = kept.commit(slot_map(spark, plan_slots(sizes, n_shards), sizes, counts, 1), 1)
    ranked = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(ranked).cast("long") - 1)
        .join(F.broadcast(table.select("virtual_slot", "shard", "first_row", "version")), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_row") + F.col("rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.col("version").alias("map_version"),
        )
    )
