"""Per-item behaviour over writes and reads: counts, velocity, volatility, entropy, streaks, lifecycle and field trends.

Input: one row a write with a key column, ts (ms), seq and numeric field columns (NULL: the field was not in the write).
Everything is ordered by (ts, seq). One shuffle by key and one sort serve all windows; exponential averages are weighted
sums (a term k writes back has weight alpha * (1 - alpha)**k, which leaves the range of doubles after a few thousand
writes), so no history of a key is ever gathered into an array. A late write, as in a log replayed in time order, is in
its place; the gap between writes counts as at least 1 ms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import DAY_MS, HOUR_MS, direction, lifecycle, magnitude

VELOCITY_ALPHA = 0.35
TREND_ALPHA = 0.3
ENTROPY_WINDOW = 32
DEAD_MS = 30 * DAY_MS


def _ordered(key: str) -> Window:
    return Window.partitionBy(key).orderBy("ts", "seq")


def _ema_term(alpha: float, value: Column, place: Column, total: Column) -> Column:
    """The share of one value in the exponential average of total values; the first one is its seed."""
    weight = F.pow(F.lit(1 - alpha), (total - place).cast("double"))
    return F.when(place == 1, value * weight).otherwise(value * (alpha * weight))


def with_gaps(writes: DataFrame, key: str = "item_key") -> DataFrame:
    """writes with place (from 1), dt (ms since the key's write before, at least 1; NULL at the first) and rate (writes an hour; 1 at the first)."""
    w = _ordered(key)
    dt = F.greatest(F.lit(1), F.col("ts") - F.lag("ts").over(w))
    return (
        writes.withColumn("place", F.row_number().over(w))
        .withColumn("dt", F.when(F.col("place") > 1, dt))
        .withColumn("rate", F.when(F.col("place") == 1, 1.0).otherwise(HOUR_MS / F.col("dt").cast("double")))
    )


def with_signs(writes: DataFrame, fields: list[str], key: str = "item_key") -> DataFrame:
    """writes with delta (sum over fields of the change since that field's last value), sign, run (signed length of the
    run of equal non-zero signs up to here; zeros keep it) and sign_place (non-zero signs so far)."""
    w = _ordered(key)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    changes = [F.coalesce(F.col(f) - F.last(f, ignorenulls=True).over(before), F.lit(0.0)) for f in fields]
    signed = writes.withColumn("delta", reduce(lambda a, b: a + b, changes)).withColumn("sign", F.signum("delta").cast("int"))
    nonzero = F.when(F.col("sign") != 0, F.col("sign"))
    marked = signed.withColumn("_prev", F.last(nonzero, ignorenulls=True).over(before)).withColumn(
        "sign_place", F.sum(F.abs("sign")).over(upto)
    )
    turn = F.when((F.col("sign") != 0) & ~F.col("sign").eqNullSafe(F.col("_prev")), F.col("sign_place"))
    return (
        marked.withColumn("_start", F.max(turn).over(upto))
        .withColumn("_way", F.last(nonzero, ignorenulls=True).over(upto))
        .withColumn("run", F.coalesce(F.col("_way") * (F.col("sign_place") - F.col("_start") + 1), F.lit(0)).cast("long"))
        .drop("_prev", "_start", "_way")
    )


def _entropy(up: Column, down: Column) -> Column:
    """Shannon entropy, in bits over the bits of the distinct signs, of two counts; 0 where one is zero."""
    n = (up + down).cast("double")
    part = lambda c: -(c / n) * F.log2(c / n)
    return F.when((up > 0) & (down > 0), part(up) + part(down)).otherwise(0.0)


def item_behavior(writes: DataFrame, fields: list[str], key: str = "item_key", as_of: int | None = None) -> DataFrame:
    """One row a key: write_count, first_ts, last_ts, velocity, volatility, entropy, streak, streak_record, lifecycle.

    lifecycle is the class at the last write (emerging for a single write, resurrected after a gap of over 30 days); with
    as_of (ms), the class a reader would see then.
    """
    whole = Window.partitionBy(key)
    rows = with_signs(with_gaps(writes.select(key, "ts", "seq", *fields), key), fields, key)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("signs", F.sum(F.abs("sign")).over(whole))
    recent = (F.col("sign") != 0) & (F.col("signs") - F.col("sign_place") < ENTROPY_WINDOW)
    at_last = F.col("place") == F.col("n")
    summed = rows.groupBy(key).agg(
        F.max("n").alias("write_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(_ema_term(VELOCITY_ALPHA, F.col("rate"), F.col("place"), F.col("n"))).alias("velocity"),
        F.coalesce(F.stddev_samp("dt"), F.lit(0.0)).alias("volatility"),
        F.count(F.when(recent & (F.col("sign") > 0), 1)).alias("_up"),
        F.count(F.when(recent & (F.col("sign") < 0), 1)).alias("_down"),
        F.max(F.when(at_last, F.col("run"))).alias("streak"),
        F.max(F.abs("run")).alias("streak_record"),
        F.max(F.when(at_last, F.col("dt"))).alias("_gap"),
    )
    at_write = (
        F.when(F.col("write_count") == 1, "emerging")
        .when(F.col("_gap") > DEAD_MS, "resurrected")
        .otherwise(lifecycle(F.lit(0), F.col("velocity"), F.col("write_count")))
    )
    seen = at_write if as_of is None else lifecycle(F.lit(as_of) - F.col("last_ts"), F.col("velocity"), F.col("write_count"))
    return summed.select(
        key,
        "write_count",
        "first_ts",
        "last_ts",
        "velocity",
        "volatility",
        _entropy(F.col("_up"), F.col("_down")).alias("entropy"),
        "streak",
        "streak_record",
        seen.alias("lifecycle"),
    )


def long_fields(writes: DataFrame, fields: list[str], key: str = "item_key") -> DataFrame:
    """One row a write and field that is present: key, ts, seq, field, x."""
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields]))
    return writes.select(key, "ts", "seq", entries.alias("_e")).select(key, "ts", "seq", "_e.field", "_e.x").where("x IS NOT NULL")


def field_trends(writes: DataFrame, fields: list[str], key: str = "item_key") -> DataFrame:
    """One row a key and field: n, last, ema, min, max, z_score, direction, magnitude."""
    both = [key, "field"]
    ordered = Window.partitionBy(*both).orderBy("ts", "seq")
    rows = (
        long_fields(writes, fields, key)
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*both)))
    )
    summed = rows.groupBy(*both).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("place") == F.col("n"), F.col("x"))).alias("last"),
        F.sum(_ema_term(TREND_ALPHA, F.col("x"), F.col("place"), F.col("n"))).alias("ema"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("_mean"),
        F.stddev_samp("x").alias("_sd"),
    )
    return summed.select(*both, "n", "last", "ema", "min", "max", *_trend_columns()).drop("_mean", "_sd")


def _trend_columns() -> list[Column]:
    last, ema = F.col("last"), F.col("ema")
    return [
        F.when(F.col("_sd") > 0, (last - F.col("_mean")) / F.col("_sd")).otherwise(0.0).alias("z_score"),
        direction(last, ema).alias("direction"),
        magnitude(last, ema, F.col("min"), F.col("max")).alias("magnitude"),
    ]


def running_ema(rows: DataFrame, group: list[str], value: str, alpha: float, name: str, dealt: bool = False) -> DataFrame:
    """rows with the exponential average of value up to each row, in (ts, seq) order within group.

    A recurrence that no window function expresses: rows are dealt and sorted by group, and one pass over Arrow batches
    carries a single number, so a long series needs no more memory than a short one. With dealt, rows come straight from
    windows over the same group and order: they lie together already, and the sort below is found redundant.
    """
    kinds = dict(rows.dtypes)
    columns = rows.columns
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` double"])
    at = [columns.index(c) for c in group]
    value_at = columns.index(value)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0.0
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in at), strict=True)
            out = []
            for k, x in zip(keys, batch.column(value_at).to_pylist(), strict=True):
                held = alpha * x + (1 - alpha) * held if k == last else x
                last = k
                out.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*columns, name])

    together = rows if dealt else rows.repartition(*group)
    return together.sortWithinPartitions(*group, "ts", "seq").mapInArrow(scan, schema)


def trend_history(writes: DataFrame, fields: list[str], key: str = "item_key") -> DataFrame:
    """The field trends after each write: key, field, ts, seq, n, last, ema, min, max, z_score, direction, magnitude."""
    both = [key, "field"]
    upto = Window.partitionBy(*both).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = long_fields(writes, fields, key).select(
        *both,
        "ts",
        "seq",
        F.count(F.lit(1)).over(upto).alias("n"),
        F.col("x").alias("last"),
        F.min("x").over(upto).alias("min"),
        F.max("x").over(upto).alias("max"),
        F.avg("x").over(upto).alias("_mean"),
        F.stddev_samp("x").over(upto).alias("_sd"),
    )
    averaged = running_ema(rows, both, "last", TREND_ALPHA, "ema", dealt=True)
    return averaged.select(*both, "ts", "seq", "n", "last", "ema", "min", "max", *_trend_columns())


def write_history(writes: DataFrame, key: str = "item_key") -> DataFrame:
    """velocity and lifecycle after each write: key, ts, seq, place, dt, velocity, lifecycle."""
    rows = running_ema(with_gaps(writes.select(key, "ts", "seq"), key), [key], "rate", VELOCITY_ALPHA, "velocity", dealt=True)
    state = (
        F.when(F.col("place") == 1, "emerging")
        .when(F.col("dt") > DEAD_MS, "resurrected")
        .otherwise(lifecycle(F.lit(0), F.col("velocity"), F.col("place")))
    )
    return rows.select(key, "ts", "seq", "place", "dt", "velocity", state.alias("lifecycle"))


def lifecycle_transitions(writes: DataFrame, key: str = "item_key") -> DataFrame:
    """Writes that changed an item's lifecycle: key, ts, seq, from_state, to_state."""
    was = F.lag("lifecycle").over(_ordered(key))
    return (
        write_history(writes, key)
        .withColumn("from_state", was)
        .where(F.col("from_state") != F.col("lifecycle"))
        .select(key, "ts", "seq", "from_state", F.col("lifecycle").alias("to_state"))
    )


def access_frequency(reads: DataFrame, key: str = "item_key") -> DataFrame:
    """One row a key: read_count, last_read and access_frequency, an average of reads an hour that starts from 0 with a first gap of an hour."""
    rows = with_gaps(reads.select(key, "ts", "seq"), key).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    weight = F.pow(F.lit(1 - VELOCITY_ALPHA), (F.col("n") - F.col("place")).cast("double"))
    return rows.groupBy(key).agg(
        F.max("n").alias("read_count"),
        F.max("ts").alias("last_read"),
        F.sum(F.col("rate") * (weight * VELOCITY_ALPHA)).alias("access_frequency"),
    )


def insights(behavior: DataFrame, lifecycle_is: str | None = None, key_is: str | None = None, since: int | None = None) -> DataFrame:
    """Behaviour rows by filter, latest write first."""
    for want, condition in ((lifecycle_is, F.col("lifecycle") == lifecycle_is), (key_is, F.col("item_key") == key_is), (since, F.col("last_ts") >= (since or 0))):
        if want is not None:
            behavior = behavior.where(condition)
    return behavior.orderBy(F.desc("last_ts"), "item_key")
