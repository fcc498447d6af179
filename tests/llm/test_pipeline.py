"""The pipeline on a small fixture, each stage held against a plain version."""

import os
import random

import pytest

import corpus_pipeline
from sylvan.llm import registry

from .helpers import documents
from .test_search import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = "the of and to in water stone river light house field garden".split()
    rows, marks = [], []
    for i in range(160):
        text = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(50)) + "."
        bad = i % 8 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
        marks.append((i, 0 if bad else 1, 0))
    rows += [(200 + i, rows[9 + i][1] + " more", "en", "a", 0) for i in range(6)] + [(300, 'x token = "abcdefgh12345678" ' + rows[1][1][:90], "en", "b", 0), (301, None, "en", "b", 0), (302, "", None, None, 0)]
    path = tmp_path_factory.mktemp("tables")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, path).collect(), stage(spark, before, path).schema)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == names
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = ids(seen["quality"])
    assert all(i in kept for i in range(160) if i % 8) and not any(i in kept for i in range(0, 160, 8))
    texts = [(r.doc_id, r.text) for r in seen["quality"].collect()]
    expected = {i for i, (_, c, _) in brute(texts, 5, 80).items() if c == i}
    assert ids(seen["near_duplicates"]) == expected and expected < kept
    clean = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert "abcdefgh12345678" not in "".join(t or "" for t in clean.values())
    assert len(clean) == len(expected)
    mixed = seen["mixing"].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= 3 and ids(seen["mixing"]) <= set(clean)
    assert seen["packing"].count() == seen["mixing"].count()


def test_run(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 0 and {"doc_id", "bucket", "batch", "slot"} <= set(out.columns)


ODD = [(None, "x"), (1, None), (2, ""), (3, " \n"), (4, "one two three four five six"), (4, "one two three four five six"), (4, "another text with the same id"), (5, "w " * 30000), (6, "w " * 30000)]
CLASH = ["size", "key", "bucket", "spans", "sig", "tokens", "score", "label", "copies", "__copy"]


def test_stages_on_odd_rows(spark, tmp_path):
    docs = documents(spark, ODD, [(name, "mine") for name in CLASH])
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            kept = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and all(r.size == "mine" for r in kept)
            assert len(kept) <= 3 * len(ODD) and (kept == [] or not rows.isEmpty())
        if name == "near_duplicates":
            kept = [(r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()]
            assert sorted(kept, key=str) == sorted(set(ODD) - {(6, "w " * 30000)}, key=str)
        if name == "mixing":
            assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} <= {None, 4, 5, 6}


def test_run_on_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    names = list(registry.queries())
    assert sorted(n.split("_")[0] for n in names) == sorted(f"op{i}" for i in range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
    assert os.path.exists(corpus_pipeline.__file__)
