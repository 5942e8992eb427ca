"""The pipeline's stages, each against plain Python on its own input."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from graphloom.llm.common import table
from tests.llm.test_operators import brute_classes, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns(staged):
    for name, before, after in staged[:-1]:
        assert tuple(after.columns) == corpus_pipeline.COLUMNS, name
        assert 0 < after.count() <= before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "benchmark decontamination", "mixing"]


def test_quality_keeps_good_documents(spark, staged):
    _, before, after = staged[0]
    kept = {r.doc_id for r in after.collect()}
    marked = before.join(table(spark, SF, "labels"), "doc_id").collect()
    share = [sum(r.doc_id in kept for r in marked if r.quality == q) / sum(r.quality == q for r in marked) for q in (0, 1)]
    assert share[0] < 0.3 and share[1] > 0.9
    assert all(len(r.text.split()) >= 10 for r in after.collect())


def test_lines(staged):
    _, before, after = staged[1]
    rows = before.collect()
    gone = brute_lines(rows)
    want = {}
    for r in rows:
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[(False, r.doc_id, r.text)])
        if text.split() or not gone[(False, r.doc_id, r.text)]:
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in after.collect()} == want


def test_near(staged):
    _, before, after = staged[2]
    rows = before.collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in brute_classes(rows)})


def test_decontamination(spark, staged):
    _, before, after = staged[3]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        assert (r.doc_id in left) == (not any(i in r.text for i in items))


def test_mixing(staged):
    _, before, after = staged[4]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())
    assert after.where("taken > 2 * size or taken < 0").count() == 0


def test_rest_works_without_it():
    """The entry point lists the other queries where this subpackage can't be imported."""
    root = Path(importlib.import_module("graphloom").__file__).parents[1]
    code = ("import sys; sys.modules['graphloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'f24_feature_table' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)")
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
