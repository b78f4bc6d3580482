"""Exact deduplication that no large group of copies can slow.

Three stages, each of which groups by digest and by the whole content: copies within a task merge first (partial
aggregation), then the tasks' winners merge within salted digest groups, then the salts' winners merge globally. No task
ever gets more rows of a text than there are salts or than tasks share a salt. A digest that stood for two contents
would raise an error rather than merge them.

Defined results: null text counts as empty, and so equals the empty text; texts are equal when identical after A-Z are
lower-cased; of equal texts the row with the largest doc_id stays (null ids come last); of rows repeated with their id
one stays; rows of one id with different texts are documents of their own, each judged by its text; an empty table gives an empty result; other columns, whatever their names, play no part in the decision.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free_name, materialize, text_or_empty

N_SALTS = 32
#: Ids, 8 bytes each, up to which a list of documents is broadcast rather than joined by a shuffle.
BROADCAST_IDS = 1_000_000


def content_column(column: str = "text"):
    """The text as it is compared: A-Z in lower case, all else as it is."""
    return F.translate(text_or_empty(column), string.ascii_uppercase, string.ascii_lowercase)


def copy_groups(docs: DataFrame, n_salts: int = N_SALTS) -> DataFrame:
    """digest, keep_id and group_size of each distinct content."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        content_column().alias("_content"),
        F.pmod(F.spark_partition_id(), F.lit(n_salts)).alias("_salt"),
    ).withColumn("_digest", F.unhex(F.sha2("_content", 256)))
    salted = base.groupBy("_salt", "_digest", "_content").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    whole = (
        salted.repartition("_digest")  # the next two groupings need no further exchange
        .groupBy("_digest", "_content")
        .agg(F.max("_id").alias("_id"), F.sum("_n").alias("_n"))
    )
    return (
        whole.groupBy("_digest")
        .agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("_contents"))
        .select(
            F.col("_digest").alias("digest"),
            "keep_id",
            F.when(F.col("_contents") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("one digest stands for two contents")).cast("long"))
            .alias("group_size"),
        )
    )


def mark_copies(docs: DataFrame, n_salts: int = N_SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    Only id and digest are joined with the groups. The groups are written first, so that both sides of the join come
    straight from an exchange and the partition of a hot digest may be split.
    """
    narrow = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(content_column(), 256)).alias("digest"))
        .groupBy("doc_id", "digest")
        .agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    )
    return (
        narrow.join(materialize(copy_groups(docs, n_salts), "copy-groups"), "digest")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, n_salts: int = N_SALTS) -> DataFrame:
    """The rows that stay, with all their columns and whole original texts.

    Whole rows are not shuffled: the ids of rows that go are a narrow table, broadcast where it is counted to be small and
    joined by a shuffle beyond. Rows without an id, or whose id stands for several rows, take a way of their own, by id
    and digest.
    """
    marked = materialize(mark_copies(docs, n_salts), "marked-copies")
    several = F.col("doc_id").isNull() | (F.col("n") > 1)
    odd = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(several).select("doc_id")
    odd = materialize(odd, "odd-ids")
    gone = materialize(marked.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone-ids")
    listed, digest, other = (free_name(docs, n) for n in ("listed_id", "text_digest", "other_digest"))
    own = F.col("doc_id").cast("long")
    if odd.isEmpty():
        return docs.join(_few(gone.toDF(listed)), own == F.col(listed), "left_anti")
    out = gone.union(odd.where("doc_id IS NOT NULL")).distinct().toDF(listed)
    plain = docs.where(own.isNotNull()).join(_few(out), own == F.col(listed), "left_anti")
    rest = docs.join(odd.toDF(listed), own.eqNullSafe(F.col(listed)), "left_semi").withColumn(digest, F.sha2(content_column(), 256))
    keep = marked.where("kept").select(F.col("doc_id").alias(listed), F.col("text_sha256").alias(other))
    match = (F.col(digest) == F.col(other)) & own.eqNullSafe(F.col(listed))
    return plain.unionByName(rest.join(keep, match, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest))


def _few(ids: DataFrame) -> DataFrame:
    """Ids to broadcast, when they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
