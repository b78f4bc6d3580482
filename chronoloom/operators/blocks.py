"""Block profiling: delta codecs' arithmetic, block metrics, regimes, codec sizes, routing by block health, and a sweep of
storage parameters.

A stream is a column of values in an order; a block is block_size consecutive values of one stream. Input: stream,
pos (from 0, without gaps) and v (whole numbers for codec sizes, any number for metrics).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalar
from chronoloom.operators.ranks import ranked

BLOCK_SIZE = 1000
PRESETS = {"balanced": (3, 1000), "max_ratio": (9, 4000), "low_latency": (1, 512)}


#: Consecutive values of a stream that one task takes as a whole; a stream is cut into as many ranges as it needs.
SPAN = 1 << 17


def _spanned(streams: DataFrame, span: int, before: int = 0) -> DataFrame:
    """streams with the range `_s` of each row; the last `before` rows of a range stand in the next one too, as not `_own`."""
    at = F.expr(f"pos DIV {int(span)}")
    if not before:
        return streams.withColumn("_s", at)
    both = F.when(F.pmod("pos", F.lit(span)) >= span - before, F.array(at, at + 1)).otherwise(F.array(at))
    return streams.withColumn("_s", F.explode(both)).withColumn("_own", F.col("_s") == at)


def _within(back: int | None = None) -> Window:
    w = Window.partitionBy("stream", "_s").orderBy("pos")
    return w if back is None else w.rowsBetween(Window.unboundedPreceding, back)


def delta(streams: DataFrame, span: int = SPAN) -> DataFrame:
    """d: the change from the value before; the first value's is the value itself."""
    rows = _spanned(streams, span, 1).withColumn("d", F.col("v") - F.coalesce(F.lag("v").over(_within()), F.lit(0)))
    return rows.where("_own").drop("_s", "_own")


def delta_of_delta(streams: DataFrame, span: int = SPAN) -> DataFrame:
    """d and dd: the change of d; for the first value both are the value, for the second dd is its change against that."""
    rows = _spanned(streams, span, 2).withColumn("d", F.col("v") - F.coalesce(F.lag("v").over(_within()), F.lit(0)))
    return rows.withColumn("dd", F.col("d") - F.coalesce(F.lag("d").over(_within()), F.lit(0))).where("_own").drop("_s", "_own")


def _earlier(column: Column) -> Column:
    """The sum of a column over a stream's earlier ranges."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("stream").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def undo_delta(rows: DataFrame, column: str = "d", span: int = SPAN) -> DataFrame:
    """v again, as the running sum of d: within a range, and over the ranges before it."""
    cut = _spanned(rows, span)
    carried = cut.groupBy("stream", "_s").agg(F.sum(column).alias("_t")).select("stream", "_s", _earlier(F.col("_t")).alias("_c"))
    return cut.withColumn("v", F.sum(column).over(_within(0))).join(carried, ["stream", "_s"]).withColumn("v", F.col("v") + F.col("_c")).drop("_s", "_c")


def undo_delta_of_delta(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """d and v again. A range that starts from d = D and v = V adds D to each of its d, and V and D for each place to its v."""
    cut = _spanned(rows, span)
    place = F.pmod("pos", F.lit(span))
    sums = cut.groupBy("stream", "_s").agg(F.count(F.lit(1)).alias("_n"), F.sum("dd").alias("_a"), F.sum(F.col("dd") * place).alias("_b"))
    sums = sums.withColumn("_d", _earlier(F.col("_a")))  # d before the range
    gained = F.col("_d") * F.col("_n") + F.col("_a") * F.col("_n") - F.col("_b")
    carried = sums.select("stream", "_s", "_d", _earlier(gained).alias("_v"))
    local = cut.withColumn("d", F.sum("dd").over(_within(0))).withColumn("v", F.sum("d").over(_within(0)))
    whole = local.join(carried, ["stream", "_s"])
    return whole.withColumn("v", F.col("v") + F.col("_v") + F.col("_d") * (place + 1)).withColumn("d", F.col("d") + F.col("_d")).drop("_s", "_d", "_v")


def run_lengths(streams: DataFrame, most: int = 255, span: int = SPAN) -> DataFrame:
    """Runs of equal values, cut at `most`: stream, start, length, v. A run may reach over many ranges."""
    rows = _spanned(streams, span, 1)
    same = F.col("v").eqNullSafe(F.lag("v").over(_within())) & F.lag("pos").over(_within()).isNotNull()
    marked = rows.withColumn("_t", F.when(~same, F.col("pos"))).where("_own")
    starts = marked.groupBy("stream", "_s").agg(F.max("_t").alias("_last"))
    earlier = Window.partitionBy("stream").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    open_run = starts.select("stream", "_s", F.last("_last", ignorenulls=True).over(earlier).alias("_open"))  # the run that a range begins in
    first = F.coalesce(F.max("_t").over(_within(0)), F.col("_open"))
    cut = marked.join(open_run, ["stream", "_s"]).withColumn("_f", first).withColumn("_c", F.floor((F.col("pos") - F.col("_f")) / most))
    return cut.groupBy("stream", "_f", "_c").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"), F.first("v").alias("v")).select("stream", "start", "length", "v")


def undo_run_lengths(runs_: DataFrame) -> DataFrame:
    """stream, pos, v of run lengths."""
    at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")
    return runs_.select("stream", at, "v")


def dictionary(keys: DataFrame, column: str) -> DataFrame:
    """Distinct keys with their ids: positions in binary order, from 0.

    Ranks are made within ranges of the keys and shifted by what lies in earlier ranges, so no task sorts all keys.
    """
    return ranked(keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct(), "key", "id")


def with_blocks(streams: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    return streams.withColumn("block", F.floor(F.col("pos") / block_size))


def _p90(values: Column) -> Column:
    """The value at index floor(0.9 n) of the sorted absolute values; 0 where there are none. A block bounds the array."""
    held = F.array_sort(values)
    n = F.size(held)
    return F.when(n > 0, F.element_at(held, F.least(n, F.floor(n * 0.9).cast("int") + 1))).otherwise(0.0)


def block_metrics(streams: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Twelve metrics and the regime of each block; changes do not reach over a block's start."""
    w = Window.partitionBy("stream", "block").orderBy("pos")
    rows = with_blocks(streams, block_size).withColumn("v", F.col("v").cast("double"))
    rows = rows.withColumn("d", F.col("v") - F.lag("v").over(w)).withColumn("dd", F.col("d") - F.lag("d").over(w))
    rows = rows.withColumn("flip", (F.signum("d") * F.signum(F.lag("d").over(w)) < 0).cast("int"))
    rows = rows.withColumn("mean", F.avg(F.abs("d")).over(Window.partitionBy("stream", "block")))
    n, nd, ndd = F.col("n"), F.col("nd"), F.col("ndd")
    share = lambda x, m, empty=0.0: F.when(m > 0, F.try_divide(x.cast("double"), m.cast("double"))).otherwise(empty)
    sums = rows.groupBy("stream", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("d").alias("nd"),
        F.count("dd").alias("ndd"),
        F.array_distinct(F.collect_list("v")).alias("uv"),
        F.collect_list(F.abs("d")).alias("ad"),
        F.size(F.array_distinct(F.collect_list("d"))).alias("ud"),
        F.collect_list(F.abs("dd")).alias("add"),
        F.size(F.array_distinct(F.collect_list("dd"))).alias("udd"),
        F.count(F.when(F.col("v") == 0, 1)).alias("zero"),
        F.sum(F.abs("d")).alias("sd"),
        F.sum("flip").alias("flips"),
        F.count(F.when(F.col("d") >= 0, 1)).alias("up"),
        F.count(F.when(F.col("d") <= 0, 1)).alias("down"),
        F.count(F.when((F.col("mean") > 0) & (F.abs("d") > F.col("mean") * 5), 1)).alias("outliers"),
        F.count(F.when(F.col("dd") == 0, 1)).alias("ddzero"),
        F.sum(F.abs("dd")).alias("sdd"),
    )
    out = sums.select(
        "stream",
        "block",
        "n",
        share(F.size("uv"), n).alias("unique_ratio"),
        share(F.col("zero"), n).alias("zero_ratio"),
        share(F.col("sd"), nd).alias("mean_abs_delta"),
        _p90(F.col("ad")).alias("p90_abs_delta"),
        share(F.col("flips"), nd - 1).alias("sign_flip_rate"),
        share(F.greatest("up", "down"), nd, 1.0).alias("monotonicity_score"),
        share(F.col("outliers"), nd).alias("outlier_score"),
        share(F.col("ud"), nd).alias("unique_delta_ratio"),
        share(F.col("udd"), ndd).alias("unique_dod_ratio"),
        share(F.col("ddzero"), ndd).alias("dod_zero_ratio"),
        share(F.col("sdd"), ndd).alias("mean_abs_dod"),
        _p90(F.col("add")).alias("p90_abs_dod"),
    )
    return out.withColumn("regime", scalar.regime(F.col("monotonicity_score"), F.col("unique_ratio"), F.col("sign_flip_rate"), F.col("outlier_score")))


def codec_sizes(streams: DataFrame, column: str = "d", block_size: int = BLOCK_SIZE) -> DataFrame:
    """Bytes of each block's whole numbers under varint, bit-pack, run-length and fixed codecs, by closed forms."""
    rows = with_blocks(streams, block_size).withColumn("x", F.col(column).cast("long"))
    w = Window.partitionBy("stream", "block").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("x") == F.lag("x").over(w), 0).otherwise(1)
    rows = rows.withColumn("_t", turn).withColumn("run", F.sum("_t").over(upto))
    rows = rows.withColumn("_c", F.floor((F.row_number().over(Window.partitionBy("stream", "block", "run").orderBy("pos")) - 1) / 255))
    per_run = rows.groupBy("stream", "block", "run", "_c").agg(
        F.count(F.lit(1)).alias("len"), F.first("x").alias("x"), F.max(scalar.zigzag(F.col("x"))).alias("z")
    )
    return per_run.groupBy("stream", "block").agg(
        F.sum("len").alias("n"),
        F.sum(F.col("len") * scalar.varint_bytes(F.col("x"))).alias("varint"),
        (F.lit(1) + F.ceil(F.sum("len") * scalar.bit_length(F.max("z")) / 8)).cast("long").alias("bitpack"),
        F.sum(scalar.varint_bytes(F.col("len")) + scalar.varint_bytes(F.col("x"))).alias("rle"),
        (F.sum("len") * 8).alias("fixed64"),
    )


def codec_choice(sizes: DataFrame, candidates: list[str]) -> DataFrame:
    """The smallest of the candidates for each block, the first of equals."""
    least = F.least(*[F.col(c) for c in candidates])
    first = F.coalesce(*[F.when(F.col(c) == least, F.lit(c)) for c in candidates])
    return sizes.select("stream", "block", "n", first.alias("codec"), least.alias("bytes"), F.try_divide(F.col("n") * 8.0, least.cast("double")).alias("ratio"))


def dictionary_sizes(streams: DataFrame, column: str = "d", block_size: int = BLOCK_SIZE, entries: int = 256) -> DataFrame:
    """Bytes under the dictionary codec: a ring of recent values, shared by a stream's blocks in order.

    Each value depends on the ring that earlier ones left, so a stream is one pass over its sorted rows; what is carried
    from batch to batch is the ring.
    """

    kept = pa.schema([("stream", pa.string()), ("block", pa.int64()), ("dict", pa.int64())])

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, block, held, done = None, None, 0, []
        ring, place, at = [], {}, 0
        for batch in batches:
            for s, b, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if s != stream or b != block:
                    if block is not None:
                        done.append({"stream": stream, "block": block, "dict": held})
                    if s != stream:
                        ring, place, at = [None] * entries, {}, 0
                    stream, block, held = s, b, 0
                if x in place:
                    code = 2 * place[x] + 1
                else:
                    code = 2 * (2 * x if x >= 0 else -2 * x - 1)
                    if ring[at] is not None:
                        place.pop(ring[at], None)
                    ring[at], place[x] = x, at
                    at = (at + 1) % entries
                held += max(1, -(-(2 * code).bit_length() // 7))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kept)
                done = []
        if block is not None:
            yield pa.RecordBatch.from_pylist([{"stream": stream, "block": block, "dict": held}], schema=kept)

    rows = with_blocks(streams, block_size).select("stream", F.col("block").cast("long").alias("block"), F.col(column).cast("long").alias("x"), "pos")
    return rows.repartition("stream").sortWithinPartitions("stream", "pos").select("stream", "block", "x").mapInArrow(size, "stream string, block long, dict long")


def item_major(snapshots: DataFrame) -> DataFrame:
    """Whether snapshots (snapshot_seq, item_id) can be laid out item by item: n_snapshots, n_items, eligible.

    All snapshots have the same items exactly if each distinct item is in each snapshot, which counts tell.
    """
    sizes = snapshots.groupBy("snapshot_seq").agg(F.count_distinct("item_id").alias("n"))
    items = snapshots.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n_items"))
    counted = sizes.agg(F.count(F.lit(1)).alias("n_snapshots"), F.min("n").alias("least"), F.max("n").alias("most"))
    eligible = (F.col("n_snapshots") > 1) & (F.col("n_items") > 1) & (F.col("least") == F.col("n_items")) & (F.col("most") == F.col("n_items"))
    return counted.crossJoin(items).select("n_snapshots", "n_items", eligible.alias("eligible"))  # one row by one row


def telemetry(blocks: DataFrame) -> DataFrame:
    """Blocks, input and output bytes and ratio for each routing decision: blocks has decision, bytes_in, bytes_out."""
    return blocks.groupBy("decision").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("bytes_in").alias("input_bytes"),
        F.sum("bytes_out").alias("output_bytes"),
        F.try_divide(F.sum("bytes_in").cast("double"), F.sum("bytes_out").cast("double")).alias("ratio"),
    )


# Routing by block health

START, MID, END, QUARANTINED = 1, 2, 4, 16


class Trouble(NamedTuple):
    """A stretch of blocks during which a stream is quarantined."""

    segment: int
    start_block: int
    end_block: int | None
    reason: str
    min_ratio: float
    max_unique: float
    probes: int = 0
    good: int = 0


class Health(NamedTuple):
    """What is carried from block to block: the usual ratio, its spread and the usual share of distinct values, of healthy
    blocks alone; the blocks seen; good probes in a row; segments so far; and the open one, if the stream is quarantined."""

    ratio: float = 2.0
    spread: float = 0.5
    unique: float = 0.5
    seen: int = 0
    good: int = 0
    segments: int = 0
    open: Trouble | None = None


class Limits(NamedTuple):
    """Thresholds of the state machine."""

    probe_every: int = 4
    needed: int = 3
    drop_sigma: float = 3.0
    recovery_sigma: float = 10.0
    alpha: float = 0.1


def health_step(h: Health, block: int, unique: float, unique_delta: float, ratio: float, limits: Limits = Limits()) -> tuple[Health, str, str | None, int, Trouble | None]:
    """The health after a block, its decision, reason and flags, and the segment that it ends, if it ends one.

    The usual values do not move while a stream is quarantined, so they are what it must come back to. A quarantined stream
    is probed at every probe_every-th block and is healthy again with the needed-th good probe in a row.
    """
    odd = None
    if ratio < h.ratio - min(limits.drop_sigma * h.spread, 0.9 * h.ratio):
        odd = "RATIO_DROP"
    elif unique > 0.5 and unique > 1.5 * h.unique and ratio < h.ratio:
        odd = "ENTROPY_BURST"
    probed = block % limits.probe_every == 0
    recovers = ratio >= h.ratio - limits.recovery_sigma * max(h.spread, 0.1)
    reason = None
    if unique > 0.85 and unique_delta > 0.85:
        reason = "ENTROPY_GATE"
    elif h.open is None:
        reason = odd
    elif not probed:
        reason = "QUARANTINE_ACTIVE"
    elif not recovers:
        reason = "RECOVERY_PROBE_FAIL"
    else:
        reason = "RECOVERY_MATCH" if h.good + 1 >= limits.needed else "RECOVERY_PENDING"
    core = reason in (None, "RECOVERY_MATCH")
    h = h._replace(seen=h.seen + 1)

    if not core and h.open is None:
        begun = Trouble(h.segments + 1, block, None, odd or "UNKNOWN", ratio, unique)
        return h._replace(open=begun, segments=begun.segment, good=0), "QUARANTINE", reason, START | QUARANTINED, None
    if not core:
        t = h.open._replace(min_ratio=min(h.open.min_ratio, ratio), max_unique=max(h.open.max_unique, unique))
        if probed:
            t = t._replace(probes=t.probes + 1, good=t.good + recovers)
            h = h._replace(good=h.good + 1 if recovers else 0)
        return h._replace(open=t), "QUARANTINE", reason, MID | QUARANTINED, None
    if h.open is not None:
        return h._replace(open=None, good=0), "CORE", reason, END, h.open._replace(end_block=block)
    if unique <= 0.8:
        if h.seen == 1:
            h = h._replace(ratio=ratio, spread=0.1 * ratio, unique=unique)
        else:
            a = limits.alpha
            h = h._replace(ratio=a * ratio + (1 - a) * h.ratio, spread=a * abs(ratio - h.ratio) + (1 - a) * h.spread, unique=a * unique + (1 - a) * h.unique)
    return h, "CORE", reason, 0, None


ROUTED = "stream string, block long, decision string, reason string, flags int, ratio double"
SEGMENTS = "stream string, segment int, start_block long, end_block long, reason string, min_ratio double, max_unique double, probes int, good int"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _watched(blocks: DataFrame, limits: Limits, schema: str, keep: Callable[[str, int, float, tuple], dict | None]) -> DataFrame:
    """Rows that keep makes of each block's step, with one stream's health carried from batch to batch; an open segment ends at a stream's last block."""
    kept = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, last, health = None, None, Health()
        for batch in batches:
            out = []
            for s, block, unique, unique_delta, ratio in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if s != stream:
                    out.append(keep(stream, last, 0.0, (health, None, None, 0, health.open and health.open._replace(end_block=last))))
                    stream, health = s, Health()
                step = health_step(health, block, unique, unique_delta, ratio, limits)
                health, last = step[0], block
                out.append(keep(s, block, ratio, step))
            if rows := [r for r in out if r is not None]:
                yield pa.RecordBatch.from_pylist(rows, schema=kept)
        if (end := keep(stream, last, 0.0, (health, None, None, 0, health.open and health.open._replace(end_block=last)))) is not None:
            yield pa.RecordBatch.from_pylist([end], schema=kept)

    cols = ["stream", F.col("block").cast("long").alias("block"), "unique_ratio", "unique_delta_ratio", F.col("ratio").cast("double").alias("ratio")]
    return blocks.select(*cols).repartition("stream").sortWithinPartitions("stream", "block").mapInArrow(run, schema)


def chm_routing(blocks: DataFrame, probe_every: int = 4) -> DataFrame:
    """Decision, reason and flags of each block (stream, block, unique_ratio, unique_delta_ratio, ratio), in block order a stream."""

    def keep(stream: str, block: int, ratio: float, step: tuple) -> dict | None:
        _, decision, reason, flags, _ = step
        return decision and {"stream": stream, "block": block, "decision": decision, "reason": reason, "flags": flags, "ratio": ratio}

    return _watched(blocks, Limits(probe_every), ROUTED, keep)


def chm_segments(blocks: DataFrame, probe_every: int = 4) -> DataFrame:
    """The segments of trouble of each stream; one still open ends at the last block."""
    return _watched(blocks, Limits(probe_every), SEGMENTS, lambda stream, block, ratio, step: step[4] and {"stream": stream, **step[4]._asdict()})


def worst_blocks(blocks: DataFrame, most: int = 10) -> DataFrame:
    """The blocks of each stream that compress worst."""
    w = Window.partitionBy("stream").orderBy("ratio", "block")
    return blocks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def write_report(blocks: DataFrame, path: str, run_id: str, probe_every: int = 4) -> None:
    """The sidecar report as JSON lines: kind (segment or worst_block), run_id and the row."""
    segments = chm_segments(blocks, probe_every).select(F.lit("segment").alias("kind"), F.to_json(F.struct("*")).alias("row"))
    worst = worst_blocks(blocks.select("stream", "block", "ratio", "unique_ratio")).select(F.lit("worst_block").alias("kind"), F.to_json(F.struct("*")).alias("row"))
    segments.unionByName(worst).withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(path)


# Storage parameters

QUICK = [(level, rows) for level in (1, 3, 6) for rows in (1000, 4000)]
DEEP = [(level, rows) for level in (1, 3, 6, 9, 12, 15) for rows in (512, 1000, 2000, 4000, 8000)]


def profile_storage(sample: DataFrame, mode: str = "quick", path: str | None = None) -> dict:
    """Write a sample with each zstd level and row-group size; returns the trials, the best and its preset, if it is one.

    best is the highest ratio, in hundredths, and of equals the fastest to write. An empty sample is an error.
    """
    import time

    from chronoloom.sources.workspace import work_path

    spark: SparkSession = sample.sparkSession
    held = sample.cache()
    try:
        n = held.count()
        if not n:
            raise ValueError("the sample is empty")
        snapshots = held.select("snapshot_seq").distinct().count() if "snapshot_seq" in held.columns else 0
        input_bytes = 8 * (snapshots + 3 * n)
        trials = []
        for level, rows in QUICK if mode == "quick" else DEEP:
            where = f"{path or work_path(spark, 'profile')}/{level}-{rows}"
            began = time.perf_counter()
            options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(level), "parquet.block.row.count.limit": str(rows), "parquet.writer.version": "PARQUET_2_0"}
            held.coalesce(1).write.mode("overwrite").options(**options).parquet(where)
            took = (time.perf_counter() - began) * 1000
            size = spark.read.format("binaryFile").load(where).agg(F.sum("length")).first()[0]
            trials.append({"level": level, "block_size": rows, "output_bytes": size, "ratio": input_bytes / size, "encode_ms": took})
        best = min(trials, key=lambda t: (-round(t["ratio"], 2), t["encode_ms"]))
        preset = next((k for k, v in PRESETS.items() if v == (best["level"], best["block_size"])), None)
        return {"input_bytes": input_bytes, "trials": trials, "best": best, "preset": preset}
    finally:
        held.unpersist()
