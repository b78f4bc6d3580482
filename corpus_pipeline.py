"""A corpus pipeline over the documents table: filter, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage's rows are written as Parquet before the next stage reads them, so each starts from files, not from lineage.

Of every stage: null and empty texts are judged like any other text; rows with a null doc_id are kept or dropped by their
text, and are never near copies; repeated rows are judged alike, except that one of them stays in exact_dedup; an empty
table gives an empty result; further columns come along unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import exact_dedup, near_dedup, packing, quality, toxicity
from chronoloom.llm.common import bounded_batches, materialize, table
from chronoloom.llm.queries import byte_bpe


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels, or with one label alone, that label decides for all (0.5 keeps)."""
    bounded_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; without labels it rejects none."""
    bounded_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for A-Z and a-z, that with the largest doc_id; null ids yield to any other."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at similarity 0.8 or more hold together, that with the smallest doc_id; rows of one id stay or go together."""
    bounded_batches(spark)
    return near_dedup.drop_near_copies(docs, words_each=5, per_cent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids (ids: little-endian unsigned 32-bit), each in a sequence of its own length; an empty text is its end id."""
    bounded_batches(spark)
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("packing", packed),
]

#: The classifiers are models that SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
