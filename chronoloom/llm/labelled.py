"""The bounded sample of labelled documents that the classifiers fit on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import text_or_empty


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from, max_rows: int) -> DataFrame:
    """doc_id, text, label (0 or 1) and order of at most max_rows labelled documents, those whose ids hash lowest.

    learn_from is a condition on doc_id; rows that fail it, and labels that are null, are never read from. max_rows bounds
    what is broadcast (ids and labels) and what the fit reads; which ids are taken does not depend on how rows lie. Ids
    that the labels repeat are taken once, with the larger label.
    """
    order = F.xxhash64("doc_id")
    taken = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn_from)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("order", order)
        .orderBy("order", "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.join(F.broadcast(taken), "doc_id").dropDuplicates(["doc_id"])
