"""The queries of this subpackage: each applies its operator to its whole table, and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import exact_dedup, extraction, near_dedup, neighbours, packing, pieces, quality, sharding, tokens, toxicity
from chronoloom.llm.common import bounded_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def byte_bpe() -> tokens.BpeFiles:
    path = public_tokenizers.path
    return tokens.BpeFiles(str(path("byte_bpe_50k.json")), str(path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=24)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    read = tokens.token_round_trip(table(spark, sf_dir, "documents"), byte_bpe())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return extraction.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    out = pieces.piece_round_trip(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words_each=2, per_cent=80)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    out = packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_token_files": op2_token_files,
    "op3_extraction": op3_extraction,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_near_dedup": op6_near_dedup,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_neighbours": op10_neighbours,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
          FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY content) AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY content) AS kept,
               sha256(content) AS text_sha256
        FROM t""",
    "op6_near_dedup": r"""
        WITH RECURSIVE t AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                              ELSE w END AS shingles FROM t),
        n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
          SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
          WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
        component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN component USING (doc_id)""",
}
