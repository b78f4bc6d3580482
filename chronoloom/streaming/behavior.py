"""Behaviour over a stream of writes and reads, and the events that it raises.

Each key's state lives in the state store and is bounded; the checkpoint takes the place of a write-ahead log, and after a
restart the whole state is there again. Within a micro-batch a key's rows are taken in (ts, seq) order. Statistics across
keys are not partitioned by key: they are recomputed for the keys that a micro-batch touched, in foreachBatch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronoloom.functions import scalar
from chronoloom.operators import signals
from chronoloom.streaming import fold

UPDATES = (
    "item_key string, ts bigint, seq bigint, op string, write_count bigint, read_count bigint, velocity double, volatility double, entropy double, "
    "streak bigint, streak_record bigint, access_frequency double, lifecycle string, lifecycle_changed_at bigint, left_state string, "
    "anomalies array<struct<field: string, expected: double, actual: double, z_score: double>>"
)
EVENT_TYPES = ("lifecycle_change", "anomaly_detected", "recommendation_new", "correlation_discovered", "cluster_formed", "cluster_dissolved")
Z_THRESHOLD = 2.0
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BehaviorProcessor(StatefulProcessor):
    """Moves a key's state on by its rows and puts out its behaviour after each."""

    def __init__(self, fields: list[str], threshold: float = Z_THRESHOLD):
        self.fields, self.threshold = fields, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("behavior", "json string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = []
        for r in pdf.to_dict("records"):
            ts, values = int(r["ts"]), {}
            if r["op"] == "read":
                if state is None:
                    continue  # a read of a key that was never written changes nothing
                state, left = fold.read(state, ts)
            else:
                values = {f: float(r[f]) for f in self.fields if r[f] is not None and r[f] == r[f]}
                state, left = fold.write(state, ts, values)
            out.append(self._row(key[0], r, state, left, values))
        if state is not None:
            self.state.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out)

    def _row(self, key: str, r: dict, state: dict, left: str | None, values: dict[str, float]) -> dict:
        odd = []
        if r["op"] != "read":
            for f, t in state["fields"].items():
                z = fold.z_score(t)
                if abs(z) >= self.threshold:
                    odd.append({"field": f, "expected": t["ema"], "actual": values.get(f, t["ema"]), "z_score": z})
        return {
            "item_key": key, "ts": int(r["ts"]), "seq": int(r["seq"]), "op": r["op"], "write_count": state["n"], "read_count": state["reads"],
            "velocity": state["velocity"], "volatility": fold.volatility(state), "entropy": fold.entropy(state), "streak": state["run"],
            "streak_record": state["record"], "access_frequency": state["frequency"], "lifecycle": state["lifecycle"],
            "lifecycle_changed_at": state["changed"], "left_state": left, "anomalies": odd,
        }

    def close(self) -> None:
        pass


def behavior_updates(ops: DataFrame, fields: list[str], threshold: float = Z_THRESHOLD) -> DataFrame:
    """Behaviour after each op of a stream (item_key, ts, seq, op: write or read, and the fields)."""
    return ops.groupBy("item_key").transformWithStateInPandas(
        BehaviorProcessor(fields, threshold), outputStructType=UPDATES, outputMode="Append", timeMode="None"
    )


def behavior_events(updates: DataFrame) -> DataFrame:
    """type, item_key, ts, seq and detail (JSON) of what updates raise: a stateless map."""
    changes = updates.where("left_state IS NOT NULL").select(
        F.lit("lifecycle_change").alias("type"), "item_key", "ts", "seq", F.to_json(F.struct(F.col("left_state").alias("from"), F.col("lifecycle").alias("to"))).alias("detail")
    )
    odd = updates.select("item_key", "ts", "seq", F.explode("anomalies").alias("a")).select(
        F.lit("anomaly_detected").alias("type"), "item_key", "ts", "seq", F.to_json("a").alias("detail")
    )
    return changes.unionByName(odd).unionByName(recommendation_events(updates))


def recommendation_events(updates: DataFrame) -> DataFrame:
    """A recommendation_new for every recommendation that a write's state gives, and for every anomaly's alert."""
    written = updates.where("op = 'write'")
    common = ["target", "ts", "seq", "insight_id", "type", "confidence", "basis", "message", "expires_at"]
    found = signals.behavior_recommendations(written.withColumn("last_ts", F.col("ts")), extra=["seq"]).select(*common)
    odd = written.select("item_key", "ts", "seq", F.explode("anomalies").alias("a")).select("item_key", "ts", "seq", "a.*").withColumn("severity", scalar.severity(F.col("z_score")))
    found = found.unionByName(signals.alerts(odd).select(*common))
    detail = F.to_json(F.struct("insight_id", F.col("type").alias("kind"), "confidence", "basis", "message", "expires_at"))
    return found.select(F.lit("recommendation_new").alias("type"), F.col("target").alias("item_key"), "ts", "seq", detail.alias("detail"))


def windowed_activity(ops: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Writes and mean value of each key and window of event time; rows later than the watermark are left out."""
    timed = ops.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window).alias("w"), "item_key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(
        F.unix_millis("w.start").alias("start"), "item_key", "n", "mean"
    )


class Subscriptions:
    """Callbacks by event type, fed by micro-batches of events."""

    def __init__(self):
        self._held: dict[int, tuple[frozenset[str], Callable[[dict], None]]] = {}
        self._next = 1

    def subscribe(self, types: list[str], callback: Callable[[dict], None]) -> int:
        if unknown := set(types) - set(EVENT_TYPES):
            raise ValueError(f"unknown event types: {sorted(unknown)}")
        number, self._next = self._next, self._next + 1
        self._held[number] = (frozenset(types), callback)
        return number

    def unsubscribe(self, number: int) -> bool:
        return self._held.pop(number, None) is not None

    def deliver(self, events: DataFrame) -> None:
        """Call the subscribers with a micro-batch's events in order; events go to the driver one partition at a time."""
        wanted = set().union(*[t for t, _ in self._held.values()]) if self._held else set()
        if not wanted:
            return
        for row in events.where(F.col("type").isin(*wanted)).orderBy("ts", "seq", "type").toLocalIterator():
            self.raise_event(row.asDict(recursive=True))

    def raise_event(self, event: dict) -> None:
        """Call the subscribers of one event's type."""
        for types, callback in list(self._held.values()):
            if event["type"] in types:
                callback(event)

    def wants(self, *types: str) -> bool:
        return any(held & set(types) for held, _ in self._held.values())


def run_behavior(ops: DataFrame, fields: list[str], checkpoint: str, updates_path: str, events_path: str | None = None, subscriptions: Subscriptions | None = None, available_now: bool = True):
    """Start the stream: updates and events are appended as Parquet, a folder a batch, so that a batch run twice leaves one copy."""

    def sink(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.write.mode("overwrite").parquet(f"{updates_path}/batch={number}")
            events = behavior_events(held)
            if events_path:
                events.write.mode("overwrite").parquet(f"{events_path}/batch={number}")
            if subscriptions:
                subscriptions.deliver(events)
        finally:
            held.unpersist()

    conf = ops.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)  # the processor needs it; a query keeps what held when it started
    try:
        writer = behavior_updates(ops, fields).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(_PROVIDER, before)
