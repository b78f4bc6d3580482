"""The pipeline against a brute-force version of each stage, and the engine without this subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import numpy as np
from chronoloom.llm import quality, queries, toxicity
from chronoloom.llm.common import materialize
from test_dedup import brute_groups, lower
from test_tokens import ids_of


def test_stages_keep_what_they_should(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents
    want = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == documents.columns
        if name == "quality":
            keep = {r.doc_id for r in quality.score_quality(before, labels).collect() if r.predicted == 1}
        elif name == "toxicity":
            keep = {r.doc_id for r in toxicity.score_toxicity(before, labels).collect() if r.predicted == 0}
        elif name == "exact_dedup":
            last = {lower(t): i for i, t in sorted(want.items())}
            keep = set(last.values())
        else:
            groups = brute_groups(list(want.items()), 5, 80)
            keep = {i for i, (_, c) in groups.items() if i == c}
        want = {i: t for i, t in want.items() if i in keep}
        assert {r.doc_id: r.text for r in docs.collect()} == want
    rows = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == set(want)
    for i, held in rows.items():
        data = b"".join(r.ids for r in sorted(held, key=lambda r: r.start))
        assert np.frombuffer(data, "<u4").tolist() == ids_of(want[i])


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1') for n in q), q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    found = subprocess.run(["grep", "-rln", "llm", str(copy / "chronoloom")], capture_output=True, text=True).stdout.split()
    assert not [f for f in found if f.endswith(".py")]
