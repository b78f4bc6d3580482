"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from chronoloom.llm import neighbours, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "", "") for i, v in rows], SCHEMA)


def brute(rows, is_query, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for n in np.flatnonzero([is_query(i) for i in ids]):
        d = np.sqrt(((vectors - vectors[n]) ** 2).sum(1))
        d[ids == ids[n]] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[n])] = [(int(ids[j]), float(d[j])) for j in order if d[j] < np.inf]
    return out


def test_recall_and_scores_on_clusters(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 32)) * 2
    rows = [(i, centres[i % 20] + r.normal(size=32)) for i in range(4000)]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    found = neighbours.nearest(frame(spark, rows).repartition(3), F.col("vec_id") % 100 == 0).collect()
    hits, by = 0, {}
    for x in found:
        by.setdefault(x.query_id, []).append(x)
    assert set(by) == set(want)
    for q, held in by.items():
        held.sort(key=lambda x: x.rank)
        assert [x.rank for x in held] == list(range(1, 11)) and [(x.score, x.vec_id) for x in held] == sorted((x.score, x.vec_id) for x in held)
        exact = dict(want[q])
        hits += sum(x.vec_id in exact for x in held)
        assert all(x.score == pytest.approx(exact[x.vec_id], abs=1e-12) for x in held if x.vec_id in exact)
    assert hits / (10 * len(want)) >= 0.9


def test_uniform_data_keeps_its_recall(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=16)) for i in range(3000)]
    want = brute(rows, lambda i: i % 50 == 0, 10)
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert np.mean([x.vec_id in dict(want[x.query_id]) for x in found]) >= 0.9


def test_edges(spark):
    bad = [(1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 2]), (5, [math.nan, 1, 2]), (6, [math.inf, 1, 2]), (7, [1, 2])]
    good = [(0, [1, 0, 0]), (100, [1, 0, 0]), (8, [1, 0, 0]), (9, [2, 0, 0]), (10, [0, 5, 0]), (9, [2, 0, 0])]
    found = neighbours.nearest(frame(spark, bad + good), F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in found] == [(0, 1, 8, 0), (0, 2, 100, 0), (0, 3, 9, 1), (100, 1, 0, 0), (100, 2, 8, 0), (100, 3, 9, 1)]
    few = neighbours.nearest(frame(spark, good[:3]), F.col("vec_id") % 100 == 0, k=10)
    assert few.count() == 4
    assert neighbours.nearest(frame(spark, []), F.col("vec_id") % 100 == 0).isEmpty()
    assert neighbours.nearest(frame(spark, bad), F.col("vec_id") % 100 == 0).isEmpty()


@pytest.mark.parametrize("rows_each", [64, 300])
def test_many_blocks_keep_the_recall(spark, rows_each):
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 12)) * 2
    rows = [(i, centres[i % 8] + r.normal(size=12)) for i in range(1500)]
    want = brute(rows, lambda i: i % 10 == 0, 10)
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, block_rows=rows_each).collect()
    assert len(found) == 1500 and np.mean([x.vec_id in dict(want[x.query_id]) for x in found]) >= 0.9
    assert len({(x.query_id, x.rank) for x in found}) == len({(x.query_id, x.vec_id) for x in found}) == 1500


def test_repeated_queries_and_a_hot_vector_over_blocks(spark):
    rows = [(100, [1.0, 0.0])] * 3 + [(i, [1.0, 0.0]) for i in range(1, 90)] + [(i, [float(i), 1.0]) for i in range(101, 190)]
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, k=5, block_rows=16).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in found] == [(100, k, k, 0.0) for k in range(1, 6)]


def test_cells_hold_their_points():
    r = np.random.default_rng(4)
    points = r.normal(size=(500, 3))
    cells = neighbours.Cells(points, 3)
    at = cells.of(points)
    assert np.bincount(at, minlength=8).min() > 40
    assert all(cells.distances(p)[c] == 0 and ((cells.low[c] <= p) & (p <= cells.high[c])).all() for p, c in zip(points, at, strict=True))


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.0]) for i in range(1, 900)]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert {(x.query_id, x.rank): x.vec_id for x in found} == {(q, k + 1): v[0] for q, held in want.items() for k, v in enumerate(held)}


def test_chi_square_point():
    assert neighbours.chi_square_point(0.95, 8) == pytest.approx(15.5073, abs=1e-3) and neighbours.chi_square_point(0.5, 2) == pytest.approx(1.38629, abs=1e-4)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    found = queries.op10_neighbours(spark, sf).collect()
    assert np.mean([x.vec_id in dict(want[x.query_id]) for x in found]) >= 0.9 and len(found) == 10 * len(want)
