"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: events as item writes, for the SQL side.
WRITES_SQL = """
w AS (
  SELECT CAST(user_id AS VARCHAR) AS item_key, epoch_us(ts) // 1000 AS ts, event_id AS seq, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type
  FROM events),
"""
