"""Quality and toxicity: held-out accuracy, bounds and edges."""

import random
import zlib

import numpy as np
import pytest
from chronoloom.llm import labelled, quality, toxicity
from llm_helpers import prose
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700):
    r, rows, labels = random.Random(6), [], []
    for i in range(n):
        text, bad, toxic = prose(i, r.randint(5, 120)), i % 7 == 0, i % 5 == 0
        if bad:
            text = " ".join(w + r.choice(["###", "***", "$$$"]) for w in text.split()) if i % 2 else (text.upper().replace(" ", "!! ") + " ") * 2
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "moron"]))
            text = " ".join(w)
        rows.append((i, text))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, frame):
    rows, labels = corpus()
    return frame(rows), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels}


def held(i, modulus, at):
    return zlib.crc32(str(i).encode()) % modulus == at


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    found = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert all(r.held_out == held(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in found.items())
    judged = [(truth[i][0], r.predicted) for i, r in found.items() if i in truth and r.held_out]
    assert len(judged) > 60 and np.mean([a == b for a, b in judged]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found.values())


def test_toxicity_on_held_out_rows(tables):
    docs, labels, truth = tables
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in found.items())
    judged = [(truth[i][1], r.predicted) for i, r in found.items() if i in truth and r.held_out]
    assert len(judged) > 60 and np.mean([a == b for a, b in judged]) > 0.95
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(1 - r.predicted for r in found.values())


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edges(spark, edge_docs, no_docs, tables, score):
    labels = tables[1]
    found = score(edge_docs, labels).collect()
    assert len(found) == edge_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in found)
    assert score(no_docs, labels).isEmpty()
    none = spark.createDataFrame([], LABELS)
    assert all(r.score == pytest.approx(0.5, abs=0.01) for r in score(tables[0], none).collect())
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, None, 1), (2, 1, 1), (2, 0, 0), (3, 9, 9)], LABELS)
    assert score(tables[0], odd).count() == tables[0].count()


def test_other_columns_are_no_input(tables):
    docs, labels, _ = tables
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    for score in (quality.score_quality, toxicity.score_toxicity):
        a, b = ({r.doc_id: round(r.score, 9) for r in score(d, labels).collect()} for d in (docs, changed))
        assert a == b


def test_sample_is_bounded_and_stable(tables):
    docs, labels, _ = tables
    pick = lambda d: sorted(r.doc_id for r in labelled.labelled_sample(d, labels, "toxic", labelled.remainder(4) != 2, 50).collect())
    assert len(pick(docs)) == 50 and pick(docs) == pick(docs.repartition(7)) and not any(held(i, 4, 2) for i in pick(docs))


def test_the_fit_equals_a_direct_ridge_solution(tables):
    """Partition sums give the weights that one dense solution over all rows gives, and the scores that follow."""
    docs, labels, _ = tables
    model = quality.fit_quality(docs, labels)
    rows = labelled.labelled_sample(docs, labels, "quality", labelled.remainder(5) != 0, quality.MAX_ROWS).collect()
    fit, rest = [r for r in rows if r.order % 4], [r for r in rows if r.order % 4 == 0]
    x = np.array([quality.statistics(r.text) for r in fit])
    spread = x.std(0)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
    z = np.hstack([np.cos(np.clip((x - x.mean(0)) * scale, -6, 6) @ model.waves + model.phases) * np.sqrt(2 / len(model.phases)), np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], np.sqrt(0.3))
    penalty[-1] = 1e-3
    stacked = np.vstack([z, np.diag(penalty)])
    want, *_ = np.linalg.lstsq(stacked, np.concatenate([[r.label for r in fit], np.zeros(len(penalty))]), rcond=None)
    assert np.allclose(model.weights, want, atol=1e-5)
    raw = model.raw(np.array([quality.statistics(r.text) for r in rest]))
    knots, values = quality.isotonic(raw, np.array([float(r.label) for r in rest]))
    assert np.allclose(knots, model.knots) and np.allclose(values, model.values)
    (one,) = quality.score_quality(docs.where("doc_id = 11"), labels.limit(0)).collect()
    assert one.score == pytest.approx(0.5, abs=0.01)


def test_ftrl_equals_a_plain_loop():
    """The vectorised fit against the published update, one coordinate at a time, in dictionaries."""
    import math

    examples = []
    for i in range(60):
        text = prose(i, 12) + (" idiot fool" if i % 3 == 0 else "")
        examples.append((np.append(np.unique(toxicity.places(text)), toxicity.BIAS), int(i % 3 == 0)))
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == toxicity.BIAS else toxicity.L1
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for places, y in examples:
            w = {k: weight(k) for k in places.tolist()}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (toxicity.TOXIC_WEIGHT if y else 1.0)
            for k in w:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = {k: weight(k) for k in z if weight(k)}
    at, found = toxicity.ftrl(examples, epochs=3)
    assert set(at.tolist()) == set(want) and np.allclose(found, [want[k] for k in at.tolist()], atol=1e-9) and len(want) > 3


def test_isotonic_is_the_least_squares_monotone_fit():
    r = np.random.default_rng(2)
    for _ in range(30):
        x, y = r.normal(size=30), r.integers(0, 2, 30).astype(float)
        knots, values = quality.isotonic(x, y)
        assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
        order = np.argsort(x)
        means = [[y[order][i : j + 1].mean() for j in range(len(y))] for i in range(len(y))]
        want = [max(min(means[i][j] for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
        assert sorted(set(np.round(want, 9))) == sorted(set(np.round(values, 9)))


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 5))
    waves = r.standard_normal((5, 20_000))
    z = quality.fourier(x, waves, r.uniform(0, 2 * np.pi, 20_000))[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    assert np.abs(z @ z.T - want).max() < 0.05


def test_ftrl_weights_are_sparse_and_find_the_word():
    examples = []
    for i in range(400):
        text = prose(i, 30) + (" idiot" if i % 4 == 0 else "")
        examples.append((np.append(np.unique(toxicity.places(text)), toxicity.BIAS), int(i % 4 == 0)))
    at, w = toxicity.ftrl(examples)
    assert len(at) < 3000 and dict(zip(at.tolist(), w.tolist(), strict=True))[int(toxicity.places("idiot")[0])] > 1


def test_statistics_of_a_text():
    assert (quality.statistics(" \n ") == 0).all() and np.isfinite(quality.statistics("a")).all()
    assert len(quality.statistics("Some text.")) == quality.N_STATS
