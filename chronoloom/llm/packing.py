"""Packing by power-of-two decomposition.

A document of n ids (its end id with them) is cut into whole windows and then into the powers of two that n's remainder
is made of, in order. Pieces of one length form a bucket; a piece is a sequence, of that length, so no sequence crosses
documents and none needs padding. Sequences are numbered bucket by bucket, longest first.

Defined results: null text counts as empty, and an empty text is one piece of the end id alone; a very long text gives
as many whole windows as it fills; rows repeated are packed one by one; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, text_or_empty
from chronoloom.llm.tokens import END_ID, BpeFiles, encoder

WINDOW = 1024
#: Rows of 20 bytes up to which the counts by task and length are broadcast.
BROADCAST_COUNTS = 1_000_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, place long"


def piece_lengths(n: int, window: int = WINDOW) -> list[int]:
    """Whole windows, then the remainder's powers of two, largest first; window is a power of two."""
    whole, rest = divmod(n, window)
    return [window] * whole + [1 << k for k in range(window.bit_length() - 2, -1, -1) if rest >> k & 1]


def document_pieces(docs: DataFrame, files: BpeFiles, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every piece with its ids (binary, little-endian unsigned 32-bit), its task and its place in the task's bucket."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bpe, places = TaskContext.get().partitionId(), encoder(files), {}
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(t.as_py())
                ids.append(end_id)
                data, start = np.array(ids, "<u4"), 0
                for length in piece_lengths(len(ids), window):
                    place = places.get(length, 0)
                    places[length] = place + 1
                    rows.append((doc_id, start, length, len(ids), data[start : start + length].tobytes(), part, place))
                    start += length
                size += len(ids)
                if size > 1_000_000:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, files: BpeFiles, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id and offset of each piece.

    The pieces are written once, in the shared folder; numbering joins them with a count for each task and bucket.
    """
    pieces = materialize(document_pieces(docs, files, window, end_id), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held, counts = counts, counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "first")
    if held.count() <= BROADCAST_COUNTS:  # 11 rows a task at most: the pieces, ids and all, need not be shuffled then
        counts = F.broadcast(counts)
    base, at = [], 0
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length")).collect():  # as many rows as window has powers
        base.append((r["length"], at))
        at += r["n"]
    base_of = F.coalesce(*[F.when(F.col("length") == n, F.lit(b)) for n, b in base], F.lit(0)) if base else F.lit(0)
    return pieces.join(counts, ["length", "part"]).select(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        (base_of + F.col("first") + F.col("place")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
