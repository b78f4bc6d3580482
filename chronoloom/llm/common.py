"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.sources.tables import table
from chronoloom.sources.workspace import locate, materialize, shared_dir, work_path

__all__ = ["bounded_batches", "free_name", "materialize", "shared_dir", "table", "text_or_empty", "work_path"]


BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Rows that go to a Python worker at once: so few that whole texts take little memory on both sides.

    A setting of the session, since plans are lazy and read it when they run; a lower one of the user's own stays.
    """
    locate(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_or_empty(column: str = "text"):
    """The text, with null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df lacks, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
