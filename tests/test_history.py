"""Commit walks, references, mining and streams."""

import os

import pandas as pd
from pyspark.sql import functions as F

from sylvan.operators import history, mining, references
from sylvan.sources.trees import parse
from sylvan.streaming import feed


def commits(spark):
    rows = [("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["b"]), ("e", ["c", "d"]), ("z", [])]
    return spark.createDataFrame(rows, "commit string, parents array<string>")


def names(df):
    return sorted(r.commit for r in df.collect())


def test_walks(spark):
    g = commits(spark)
    assert names(history.Walk(g).after("e").commits()) == ["a", "b", "c", "d", "e"]
    assert names(history.Walk(g).after("e").before("b").commits()) == ["b", "c", "d", "e"]
    assert names(history.Walk(g).after("e").first_parents().commits()) == ["a", "b", "c", "e"]
    assert names(history.Walk(g).commits()) == ["a", "b", "c", "d", "e", "z"]
    assert names(history.Walk(g).after("c", "z").commits()) == ["a", "b", "c", "z"]


def test_lookup(spark):
    tags = spark.createDataFrame([("v1", "b"), ("a", "c")], "tag string, commit string")
    wanted = spark.createDataFrame([("v1",), ("a",), ("d",), ("nope",)], "name string")
    assert {r.name: r.commit for r in history.find_commit(commits(spark), tags, wanted).collect()} == {"v1": "b", "a": "c", "d": "d", "nope": None}


def test_references(spark):
    text = "class A { int f() { return g() + f(); } int g() { return 1; } }"
    occ = parse(spark.createDataFrame([("a", text), ("b", "class B { void h() { f(); } }")], "k string, text string"), "k", "text", "java").cache()
    decls = references.declarations(occ, ["method_declaration"])
    used = references.uses(occ, decls)
    found = references.resolve(occ, decls, used)
    assert sorted((r.root, r.name) for r in found.collect()) == [("a", "f"), ("a", "g")]
    assert [(r.root, r.name, r.other_root) for r in references.across(decls, used, found).collect()] == [("b", "f", "a")]
    assert {r.name: r.references for r in references.reference_counts(decls, found).collect()} == {"f": 1, "g": 1, "h": 0}
    relations = {r.module: r.content for r in references.relations(decls, found, occ).collect()}
    assert len(relations["a"]) == 2 and relations["a"][0].refs


def test_mined_queries_reach_the_most_general(spark, tmp_path):
    from sylvan.plans.catalog import _shapes, mined_queries

    texts = ['{"a": 1, "b": [1, {"c": 2}], "d": {"e": 3}}', '{"a": 1}']
    spark.createDataFrame([(t,) for t in texts], "props string").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.query: r.examples for r in mined_queries(spark, str(tmp_path)).collect()}
    want = {}
    for query in next(_shapes([pd.DataFrame({"props": texts})]))["query"]:
        seen, todo = {query}, [query]
        while todo:
            for _, q in mining.generalisations(todo.pop()):
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        for q in seen:
            want[q] = want.get(q, 0) + 1
    assert found == want and min(map(len, found)) < 12


def test_lattice(spark):
    examples = spark.createDataFrame([(1, "(a (b) (c))"), (2, "(a (b) (d))")], "example int, query string")
    nodes, edges = mining.lattice(examples, 2)
    cover = {r.query: r.examples for r in mining.support(examples, nodes, edges, 2).collect()}
    assert cover["(a (b))"] == 2 and cover["(a (c))"] == 1 and cover["(a)"] == 2
    assert mining.likely_smells(mining.support(examples, nodes, edges, 2), 10, least=1).first().query in ("(a (b))", "(a)")
    g = mining.groups(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "src int, dst int"))
    assert {r.node: r.component for r in g.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_incremental_ingest(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "oid string, text string")
    frame([("1", "a"), ("2", "b")]).write.parquet(source)
    for extra in ([], [("2", "b"), ("3", "c")]):
        if extra:
            frame(extra).write.mode("append").parquet(source)
        stream = spark.readStream.schema("oid string, text string").parquet(source)
        feed.start_ingest(stream, "oid", store, str(tmp_path / "cp"), lambda df: df.withColumn("n", F.length("text"))).awaitTermination()
    assert sorted(r.oid for r in spark.read.parquet(store).collect()) == ["1", "2", "3"]
    assert os.path.isdir(store)


def test_per_version_budget(spark):
    def run(_, v):
        if v == 1:
            raise ValueError("bad version")
        return v

    assert [v for v, _ in feed.per_version(spark, list(range(10)), run, 6)] == [0, 1, 2, 3]
