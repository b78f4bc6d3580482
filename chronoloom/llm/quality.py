"""Quality scores by a Gaussian kernel over document statistics.

A document becomes a vector of statistics of its whole text. Random Fourier features approximate a Gaussian kernel on
the standardised vectors; ridge regression on them is fitted by normal equations that each partition of the sample sums
for its rows, so that what reaches the driver has a fixed size a partition. Isotonic regression, on labelled rows kept
out of the fit, turns ridge scores into probabilities of label 1.

Defined results: null text counts as empty, and an empty text has statistics of its own (zeros) and so a score; with no
labelled rows every score is 0.5, and with rows of one label alone that label; rows repeated score alike; an empty table
gives an empty result; labels, lang, source, doc_id and any other column are no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free_name, materialize, text_or_empty
from chronoloom.llm.labelled import labelled_sample, remainder

MAX_ROWS = 20_000
N_FEATURES = 384
SUMS = 8
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_CODES = np.arange(256)
_UPPER, _LOWER = (_CODES >= 65) & (_CODES <= 90), (_CODES >= 97) & (_CODES <= 122)
_DIGIT, _SPACE = (_CODES >= 48) & (_CODES <= 57), (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))
_HIGH = _CODES >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_SYMBOL = np.isin(_CODES, np.frombuffer(b"#$%&*+<=>@[]^_{|}~\\/", np.uint8))
_GROUPS = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _MARK, _SYMBOL]).astype(np.float64).T
_SINGLE = [ord(c) for c in ".,!?|:;'\"-@"]
N_STATS = 7 + len(_SINGLE) + 15


def statistics(text: str) -> np.ndarray:
    """The statistics of one whole text; zeros for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(N_STATS)
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:7] = counts @ _GROUPS / len(raw)
    out[7 : 7 + len(_SINGLE)] = counts[_SINGLE] / len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    heads = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    n = len(words)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[7 + len(_SINGLE) :] = (
        np.log1p(len(raw)),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        (lengths <= 3).mean(),
        (lengths >= 15).mean(),
        _MARK[ends].mean(),
        _SYMBOL[ends].mean(),
        _UPPER[heads].mean(),
        distinct / n,
        np.log1p(n - distinct),
        pairs / max(1, n - 1),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    )
    return out


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of labels to scores, by pooling adjacent violators; scores between knots interpolate."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(scores[order], labels[order], strict=True):
        blocks.append([y, 1.0, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y1, n1, x1 = blocks.pop()
            blocks[-1][0] += y1
            blocks[-1][1] += n1
            blocks[-1][2] += x1
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


@dataclass(frozen=True)
class QualityModel:
    """A fitted scorer; its size depends on the parameters alone."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) * self.scale, self.waves, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated probability, with a hundredth of a smooth step in it so that equal probabilities keep the raw order."""
        raw = self.raw(stats)
        smooth = 1 / (1 + np.exp(-8 * (np.clip(raw, -2, 3) - 0.5)))
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 * smooth, 0, 1)


def fourier(x: np.ndarray, waves: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    return np.hstack([np.cos(np.clip(x, -6, 6) @ waves + phases) * np.sqrt(2 / len(phases)), np.ones((len(x), 1))])


def _partials(df: DataFrame, f, width: int) -> np.ndarray:
    """Sum over partitions of the vectors that f makes of a partition's statistics and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            stats = np.array(b.column(0).to_pylist(), np.float64).reshape(-1, N_STATS)
            total += f(stats, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    rows = df.select("stats", "label").mapInArrow(run, "v binary").collect()  # SUMS rows
    return np.sum([np.frombuffer(r["v"]) for r in rows], axis=0) if rows else np.zeros(width)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, n_features: int = N_FEATURES, width: float = 0.7, ridge: float = 0.3) -> QualityModel:
    """Fit on at most max_rows labelled rows whose crc32(doc_id) mod 5 is not 0; a quarter of them calibrate."""
    sample = labelled_sample(docs, labels, "quality", remainder(FOLDS) != HELD_OUT, max_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["stats", "label", "order"])

    measured = sample.select("text", "label", "order").mapInArrow(measure, "stats array<double>, label int, order long")
    held = materialize(measured, "quality-sample").coalesce(SUMS)
    calibrates = F.pmod(F.col("order"), F.lit(4)) == 0
    fit, calibrate = held.where(~calibrates), held.where(calibrates)

    d = N_STATS
    sums = _partials(fit, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n, mean = sums[0], sums[2 : 2 + d] / max(1, sums[0])
    spread = np.sqrt(np.maximum(sums[2 + d :] / max(1, n) - mean**2, 0))
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
    rng = np.random.default_rng(8)
    waves = rng.standard_normal((d, n_features)) * width / np.sqrt(d)
    waves *= np.repeat([1.0, 2.5], [n_features // 2, n_features - n_features // 2])  # two widths of the kernel
    phases = rng.uniform(0, 2 * np.pi, n_features)
    if n == 0 or sums[1] in (0, n):
        rate = 0.5 if n == 0 else float(sums[1] / n)
        return QualityModel(mean, scale, waves, phases, np.zeros(n_features + 1), np.array([0.0]), np.array([rate]))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier((x - mean) * scale, waves, phases)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    m = n_features + 1
    eq = _partials(fit, equations, m * m + m)
    penalty = np.full(m, ridge)
    penalty[-1] = 1e-6
    weights = np.linalg.solve(eq[: m * m].reshape(m, m) + np.diag(penalty), eq[m * m :])
    rows = calibrate.select("stats", "label").collect()  # a quarter of max_rows
    model = QualityModel(mean, scale, waves, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if not rows:
        return model
    raw = model.raw(np.array([r["stats"] for r in rows]).reshape(-1, d))
    knots, values = isotonic(raw, np.array([float(r["label"]) for r in rows]))
    return QualityModel(mean, scale, waves, phases, weights, knots, values)


def with_quality(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """docs with the score of each whole text."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(model.score(np.array([statistics(t) for t in s]).reshape(-1, N_STATS)), index=s.index)

    return docs.withColumn(column, score(text_or_empty()))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = with_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_quality(docs, labels, max_rows))
    return scored.select(
        "doc_id",
        (remainder(FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs whose text is predicted to be good, with all their columns, whatever these are called."""
    column = free_name(docs, "quality_score")
    return with_quality(docs, fit_quality(docs, labels, max_rows), column).where(F.col(column) >= THRESHOLD).drop(column)
