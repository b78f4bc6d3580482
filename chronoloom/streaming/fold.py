"""One key's behaviour as a state that each write or read moves on: constant time and size a row, whatever the history."""

from __future__ import annotations

import math

from chronoloom.operators.behavior import DEAD_MS, ENTROPY_WINDOW, TREND_ALPHA, VELOCITY_ALPHA

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def lifecycle_of(inactive_ms: int, velocity: float, writes: int) -> str:
    if inactive_ms > DEAD_MS:
        return "dead"
    if inactive_ms > 7 * DAY_MS:
        return "dormant"
    if velocity > 0.5:
        return "emerging" if writes < 10 else "active"
    return "declining" if velocity < 0.05 else "stable"


def new_state(ts: int) -> dict:
    return {
        "n": 0, "first": ts, "last": ts, "velocity": 1.0, "gap_mean": 0.0, "gap_m2": 0.0, "signs": [], "run": 0, "record": 0, "fields": {},
        "reads": 0, "last_read": None, "frequency": 0.0, "lifecycle": "emerging", "changed": ts,
    }


def _moves(state: dict, to: str, ts: int) -> str | None:
    """Set the lifecycle; the one before if it changed."""
    was = state["lifecycle"]
    if was == to:
        return None
    state["lifecycle"], state["changed"] = to, ts
    return was


def _trend(held: dict | None, x: float) -> tuple[dict, float]:
    """The field's next trend, and its change from its last value."""
    if held is None:
        return {"n": 1, "mean": x, "m2": 0.0, "ema": x, "min": x, "max": x, "last": x}, 0.0
    n, gap = held["n"] + 1, x - held["mean"]
    mean = held["mean"] + gap / n
    out = {
        "n": n, "mean": mean, "m2": held["m2"] + gap * (x - mean), "ema": TREND_ALPHA * x + (1 - TREND_ALPHA) * held["ema"],
        "min": min(held["min"], x), "max": max(held["max"], x), "last": x,
    }
    return out, x - held["last"]


def z_score(trend: dict) -> float:
    spread = math.sqrt(trend["m2"] / (trend["n"] - 1)) if trend["n"] > 1 else 0.0
    return (trend["last"] - trend["mean"]) / spread if spread > 0 else 0.0


def write(state: dict | None, ts: int, values: dict[str, float]) -> tuple[dict, str | None]:
    """The state after a write, and the lifecycle it left, if it left one."""
    state = state or new_state(ts)
    state["n"] += 1
    was = None
    if state["n"] > 1:
        gap = max(1, ts - state["last"])
        state["velocity"] = VELOCITY_ALPHA * (HOUR_MS / gap) + (1 - VELOCITY_ALPHA) * state["velocity"]
        k = state["n"] - 1
        off = gap - state["gap_mean"]
        state["gap_mean"] += off / k
        state["gap_m2"] += off * (gap - state["gap_mean"])
        back = state["lifecycle"] == "dead" or gap > DEAD_MS
        was = _moves(state, "resurrected" if back else lifecycle_of(0, state["velocity"], state["n"]), ts)
    state["last"] = ts
    delta = 0.0
    for f, x in values.items():
        state["fields"][f], change = _trend(state["fields"].get(f), x)
        delta += change
    sign = (delta > 0) - (delta < 0)
    if sign:
        state["signs"] = [*state["signs"], sign][-ENTROPY_WINDOW:]
        state["run"] = state["run"] + sign if state["run"] * sign > 0 else sign
        state["record"] = max(state["record"], abs(state["run"]))
    return state, was


def read(state: dict, ts: int) -> tuple[dict, str | None]:
    """The state after a read of a key that was written before."""
    gap = HOUR_MS if state["last_read"] is None else max(1, ts - state["last_read"])
    first = 1.0 if state["last_read"] is None else HOUR_MS / gap
    state["frequency"] = VELOCITY_ALPHA * first + (1 - VELOCITY_ALPHA) * state["frequency"]
    state["reads"], state["last_read"] = state["reads"] + 1, ts
    return state, _moves(state, lifecycle_of(ts - state["last"], state["velocity"], state["n"]), ts)


def volatility(state: dict) -> float:
    gaps = state["n"] - 1
    return math.sqrt(state["gap_m2"] / (gaps - 1)) if gaps > 1 else 0.0


def entropy(state: dict) -> float:
    up = state["signs"].count(1)
    down = len(state["signs"]) - up
    if not up or not down:
        return 0.0
    p, q = up / (up + down), down / (up + down)
    return -p * math.log2(p) - q * math.log2(q)
