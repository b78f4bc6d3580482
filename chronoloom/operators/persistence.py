"""Insight state as keyed records, `_insight/<kind>/<key>`, and back.

A record has numbers and texts, as every record of the store; booleans are 0 and 1. Field trends are kept too, so a
restored state is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.model import INSIGHT_PREFIX

KINDS = {
    "behavior": (["item_key"], ["write_count", "first_ts", "last_ts", "velocity", "volatility", "entropy", "streak", "streak_record"], ["lifecycle"]),
    "trend": (["item_key", "field"], ["n", "last", "ema", "min", "max", "z_score", "magnitude"], ["direction"]),
    "correlation": (["item_a", "item_b"], ["coefficient", "lag", "n", "confidence", "updated_at"], ["direction"]),
    "confidence": (["insight_type", "scope"], ["total", "correct", "accuracy", "recent_accuracy", "calibration", "disabled", "high_reliability"], []),
}


def to_records(rows: DataFrame, kind: str) -> DataFrame:
    """key, numbers and texts of insight rows; the parts of the key are texts too, so no separator is ever parsed."""
    keys, numbers, texts = KINDS[kind]
    entries = lambda names, cast: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast(cast) for n in names]))
    return rows.select(
        F.concat(F.lit(f"{INSIGHT_PREFIX}{kind}/"), F.concat_ws("|", *keys)).alias("key"), entries(numbers, "double").alias("numbers"), entries([*keys, *texts], "string").alias("texts")
    )


def from_records(records: DataFrame, kind: str, schema: DataFrame) -> DataFrame:
    """The insight rows of a kind, with the column types of another frame of that kind."""
    keys, numbers, texts = KINDS[kind]
    types = dict(schema.dtypes)
    held = records.where(F.startswith("key", F.lit(f"{INSIGHT_PREFIX}{kind}/")))
    as_type = lambda n, source: (F.col(source)[n] == 1 if types[n] == "boolean" else F.col(source)[n].cast(types[n])).alias(n)
    return held.select(*[as_type(n, "texts") for n in keys], *[as_type(n, "numbers") for n in numbers], *[as_type(n, "texts") for n in texts])
