"""Toxicity scores by FTRL-proximal logistic regression over hashed words.

Features are the distinct words, word pairs and skip-grams (pairs one and two words apart) of the whole text, hashed to
2**BITS places. Each place has its own learning rate, and the L1 term keeps all but a few weights at zero; only those few
are broadcast. The fit is one sequential task over a bounded, fixed sample of labelled rows, in an order that their ids
set, so it can run again anywhere with the same result.

Defined results: null text counts as empty, and an empty text scores by the bias alone; with no labelled rows every score
is 0.5; rows repeated score alike; an empty table gives an empty result; labels, lang, source, doc_id and any other
column are no input of a score.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free_name, materialize, text_or_empty
from chronoloom.llm.labelled import labelled_sample, remainder

BITS = 20
MAX_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
TOXIC_WEIGHT = 3.0  # toxic rows are few, and missing one costs more
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
BIAS = 1 << BITS

_TO_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def places(text: str) -> np.ndarray:
    """The places of a text's features, in no order and with repeats."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    found = [h * _MIX]
    for gap in (1, 2, 3):  # neighbours, and pairs with one and two words between
        if len(h) > gap:
            found.append((h[:-gap] * _MIX + (h[gap:] ^ (h[gap:] >> np.uint64(29))) * _SECOND[gap - 1]) * _MIX)
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Examples:
    """Places and label of each example, held in a few large arrays, which memory comes back from when they go."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, list[int]]] = []

    def add(self, texts: list[str], labels: list[int]) -> None:
        found = [np.append(np.unique(places(t)), BIAS).astype(np.int32) for t in texts]
        if found:
            self.parts.append((np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]), labels))

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        for flat, ends, labels in self.parts:
            for k, label in enumerate(labels):
                yield flat[ends[k] : ends[k + 1]], label


def ftrl(examples: Iterable[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero; the bias is at place 2**BITS and bears no L1."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        l1 = np.where(at == BIAS, 0.0, L1)
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in examples:
            w = weights(at)
            g = (sigmoid(w.sum()) - label) * (TOXIC_WEIGHT if label else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BIAS + 1))
    kept = np.flatnonzero(w)
    return kept, w[kept]


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights."""

    at: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BIAS + 1)
        out[self.at] = self.weights
        return out


def score_text(text: str, dense: np.ndarray) -> float:
    at = places(text)
    at = np.unique(at[dense[at] != 0])  # only places with a weight matter
    return float(sigmoid(dense[at].sum() + dense[BIAS]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on at most max_rows labelled rows whose crc32(doc_id) mod 4 is not 2."""
    sample = labelled_sample(docs, labels, "toxic", remainder(FOLDS) != HELD_OUT, max_rows)
    held = materialize(sample.select("text", "label", "order"), "toxicity-sample")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = Examples()
        for b in batches:
            examples.add(b.column(0).to_pylist(), b.column(1).to_pylist())
        at, w = ftrl(examples)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])

    rows = held.repartition(1).sortWithinPartitions("order").select("text", "label").mapInArrow(train, "at long, w double").collect()
    return ToxicityModel(np.array([r["at"] for r in rows], np.int64), np.array([r["w"] for r in rows], np.float64))


def with_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.at, model.weights))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = ToxicityModel(*sent.value).dense()
        for s in texts:
            yield pd.Series([score_text(t, dense) for t in s], index=s.index, dtype="float64")

    return docs.withColumn(column, score(text_or_empty()))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = with_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_toxicity(docs, labels, max_rows))
    return scored.select(
        "doc_id",
        (remainder(FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs whose text is not predicted to be toxic, with all their columns, whatever these are called."""
    model = fit_toxicity(docs, labels, max_rows)
    if not len(model.at):  # without labels nothing is known of any text
        return docs
    column = free_name(docs, "toxicity_score")
    return with_toxicity(docs, model, column).where(F.col(column) < THRESHOLD).drop(column)
