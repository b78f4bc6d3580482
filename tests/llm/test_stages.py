"""Each stage of the pipeline on null ids and texts, repeated rows, empty tables and columns named as helpers are."""

import corpus_pipeline
import pytest
from llm_helpers import edge_texts, prose

HELPERS = "quality_score toxicity_score listed_id text_digest other_digest gone_id digest kept n label rep __quality __toxicity __id __d __digest __gone".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in HELPERS)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"user {c}" for c in HELPERS]) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (10, 0, 1), (13, 0, 1), (15, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


@pytest.fixture(scope="module")
def rows():
    return [*edge_texts(), (9, prose(2, 120)), (9, prose(2, 120) + " and more"), (30, prose(8, 60)), (31, prose(8, 60) + " tail")]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_and_whole_rows(spark, tables, rows, name, stage):
    docs = clashing(spark, rows)
    found = stage(spark, docs, tables)
    assert found.columns == docs.columns
    held = found.collect()
    before = [tuple(r) for r in docs.collect()]
    assert all(tuple(r) in before for r in held) and len(held) <= len(before)
    assert all(r[c] == f"user {c}" for r in held for c in HELPERS)
    if name == "exact_dedup":
        texts = [(r.text or "").lower() for r in held]
        assert len(texts) == len(set(texts)) and set(texts) == {(t or "").lower() for _, t in rows}
    if name == "near_dedup":
        kept = {r.doc_id for r in held}
        assert None in kept and 30 in kept and 31 not in kept


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, tables, name, stage):
    docs = clashing(spark, [])
    found = stage(spark, docs, tables)
    assert found.isEmpty() and (name == "packing" or found.columns == docs.columns)


def test_packing_stage_takes_every_row(spark, tables, rows):
    found = corpus_pipeline.STAGES[-1][1](spark, clashing(spark, rows), tables).collect()
    assert sum(r.start == 0 for r in found) == len(rows) and sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_stages_without_any_label(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark, rows[:6])
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, str(tmp_path)).count() == 6 and stages["toxicity"](spark, docs, str(tmp_path)).count() == 6
