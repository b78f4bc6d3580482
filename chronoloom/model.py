"""Data model: profiles as Spark schemas, snapshots in long and nested form, inferred schemas and categorical codes.

The canonical form of snapshots is long: snapshot_seq, ts, item key, and a typed column for each field. Missing fields are
NULL. Snapshots without items exist in a side table (snapshot_seq, ts, n_items), since a long table cannot hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(name: str, kind: T.DataType, **metadata) -> T.StructField:
    return T.StructField(name, kind, True, metadata or None)


def profile(name: str, version: int, key: T.StructField, *fields: T.StructField) -> T.StructType:
    """A schema of snapshots in long form; its id and version ride on the key column's metadata."""
    key = T.StructField(key.name, key.dataType, True, {"profile": name, "version": version})
    return T.StructType([_field("snapshot_seq", T.LongType()), _field("ts", T.LongType()), key, *fields])


OUTCOMES = {"approved": 0, "rejected": 1, "error": 2, "timeout": 3, "auto_approved": 4}
MARKET_DATA = profile(
    "market_data_v1", 1, _field("item_id", T.LongType()), _field("price", T.DoubleType()), _field("quantity", T.DoubleType())
)
TRUST_EVENTS = profile(
    "trust_events_v1",
    1,
    _field("item_key", T.StringType()),
    *[_field(n, T.DoubleType()) for n in ("score", "approvals", "rejections", "failures", "streak")],
    _field("outcome", T.StringType(), enum=OUTCOMES),
)
LIFECYCLES = {n: i for i, n in enumerate(["emerging", "active", "stable", "declining", "dormant", "dead", "resurrected"])}
BEHAVIOR = profile(
    "insight_behavior_v1",
    1,
    _field("item_key", T.StringType()),
    _field("velocity", T.DoubleType()),
    _field("entropy", T.DoubleType()),
    _field("lifecycle", T.StringType(), enum=LIFECYCLES),
    _field("writeCount", T.LongType()),
    _field("streak", T.LongType()),
)
CORRELATION = profile(
    "insight_correlation_v1",
    1,
    _field("item_key", T.StringType()),
    _field("coefficient", T.DoubleType()),
    _field("lag", T.LongType()),
    _field("confidence", T.DoubleType()),
    _field("direction", T.StringType(), enum={"positive": 0, "negative": 1}),
)
INSIGHT_PREFIX = "_insight/"


def to_long(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The item rows and the snapshots table of (snapshot_seq, ts, items MAP<key, STRUCT>)."""
    snapshots = nested.select("snapshot_seq", "ts", F.size("items").alias("n_items"))
    rows = nested.select("snapshot_seq", "ts", F.explode("items").alias("item_id", "_f")).select("snapshot_seq", "ts", "item_id", "_f.*")
    return rows, snapshots


def to_nested(rows: DataFrame, snapshots: DataFrame, key: str = "item_id") -> DataFrame:
    """Snapshots with their items as a map in key order; snapshots without items come back empty."""
    fields = [c for c in rows.columns if c not in ("snapshot_seq", "ts", key)]
    entry = F.struct(F.col(key), F.struct(*fields))
    items = rows.groupBy("snapshot_seq").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("items"))
    empty = F.map_from_arrays(F.array().cast(T.ArrayType(rows.schema[key].dataType)), F.array().cast(T.ArrayType(T.StructType([rows.schema[f] for f in fields]))))
    return snapshots.join(items, "snapshot_seq", "left").select("snapshot_seq", "ts", F.coalesce("items", empty).alias("items"))


def infer_fields(records: DataFrame) -> DataFrame:
    """field, kind and values of records (key, field, number, text): a field is numeric when every value of it is a number.

    Categorical fields list their distinct texts in order, with codes from 1; code 0 stands for missing.
    """
    kinds = records.groupBy("field").agg(F.bool_and(F.col("number").isNotNull()).alias("numeric"))
    texts = records.where("text IS NOT NULL").select("field", "text").distinct()  # before any text is gathered
    listed = texts.join(kinds.where("NOT numeric").select("field"), "field").groupBy("field").agg(F.array_sort(F.collect_list("text")).alias("values"))
    kind = F.when(F.col("numeric"), "numeric").otherwise("categorical")
    return kinds.join(listed, "field", "left").select("field", kind.alias("kind"), F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def numeric_fields(df: DataFrame, *others: str) -> list[str]:
    """Columns that hold numbers, without the named ones."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in others]


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value of a column with its code: 1 and up in order; missing is 0."""
    from chronoloom.operators.ranks import ranked

    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return ranked(values, "value", "code", 1).withColumn("code", F.col("code").cast("int"))


def encode_category(column, codes: dict[str, int]):
    """The code of a text, and 0 for a text that has none."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(0))


def decode_category(column, codes: dict[str, int]):
    """The text of a code, or NULL."""
    pairs = [F.lit(x) for text, code in codes.items() for x in (code, text)]
    return F.try_element_at(F.create_map(*pairs), column)


def is_insight(key):
    return F.startswith(key, F.lit(INSIGHT_PREFIX))


def insight_target(key):
    """The key without _insight/<kind>/."""
    return F.regexp_replace(key, r"^_insight/[^/]+/", "")
