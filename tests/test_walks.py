"""Walks over long and branched graphs of commits, and the services that follow them."""

import random

import pytest

from sylvan.engine import Engine
from sylvan.operators import history
from sylvan.operators.metrics import MetricSpec
from sylvan.sources import trees


def plain(graph, heads):
    far, edge, n = dict.fromkeys(heads, 0), list(heads), 0
    while edge:
        n += 1
        edge = [p for p in {q for c in edge for q in graph.get(c, [])} if p not in far]
        far.update(dict.fromkeys(edge, n))
    return {c: n for c, n in far.items() if c in graph}


def frame(spark, graph):
    return spark.createDataFrame(list(graph.items()), "commit string, parents array<string>").coalesce(2)


def test_a_long_chain_takes_few_steps(spark, monkeypatch):
    graph = {str(i): [str(i - 1)] if i else [] for i in range(1000)}
    steps = []
    real = history.cut
    monkeypatch.setattr(history, "cut", lambda df: steps.append(1) or real(df))
    found = {r["commit"]: r.far for r in history.Walk(frame(spark, graph)).after("999").commits().collect()}
    assert found == {str(i): 999 - i for i in range(1000)}
    assert len(steps) < 40


@pytest.mark.parametrize("seed", [1, 2])
def test_branched_graphs(spark, seed):
    """Merges, ways of unequal length to one commit, parents named twice or not in the graph."""
    draw = random.Random(seed)
    graph = {str(i): [str(draw.randint(max(-1, i - 4), i - 1)) for _ in range(draw.choice([1, 1, 1, 1, 2, 3]))] if i else [] for i in range(40)}
    found = {r["commit"]: r.far for r in history.Walk(frame(spark, graph)).after("39", "30").commits().collect()}
    assert found == plain(graph, ["39", "30"])


@pytest.fixture
def asked(spark):
    """An engine whose trees come from a source, and the roots it was asked for, call by call."""
    graph = {str(i): [str(i - 1)] if i else [] for i in range(5)}
    occ = spark.createDataFrame([(i, p, 0 if p else None, max(p - 1, 0), min(p, 1), i + 2 - p if not p else 1, 0 if p else 1, "leaf" if p else "top", "x") for i in range(5) for p in range(i + 2)], "root long, pre long, parent long, pos long, depth int, size long, height int, type string, label string")
    occ = occ.selectExpr("*", "cast(null as string) role")
    root_of = spark.createDataFrame([(str(i), i) for i in range(5)], "commit string, root long")
    calls = []

    def of(roots):
        calls.append(sorted(r.root for r in roots.collect()))
        return occ.join(roots, "root", "left_semi")

    return Engine(frame(spark, graph), root_of, None, of=of), calls


def test_query_makes_the_trees_of_its_walk_only(asked):
    engine, calls = asked
    assert {r["commit"]: list(r["counts"]) for r in engine.query("(leaf)", "3").collect()} == {"3": [4], "2": [3], "1": [2], "0": [1]}
    assert calls == [[0, 1, 2, 3]]


def test_limits_on_the_trees_of_a_walk(asked):
    engine, calls = asked
    assert {r["commit"]: (list(r["counts"]), len(r.errors)) for r in engine.compute("(leaf)", "4", max_matches=3).collect()} == {"0": ([1], 0), "1": ([2], 0), "2": ([3], 0), "3": ([3], 1), "4": ([3], 1)}
    assert calls == [[0, 1, 2, 3, 4]]


def test_a_script_on_the_trees_of_a_walk(asked):
    engine, calls = asked
    spec = MetricSpec.of("CASE WHEN type = 'leaf' THEN 1 ELSE 0 END", "sum(value)", "own + coalesce(acc, 0)")
    assert {r["commit"]: r.n for r in engine.script(spec, "n", "2").collect()} == {"0": 1, "1": 2, "2": 3}
    assert calls == [[0, 1, 2]]


def test_a_stream_gathers_its_trees_once(asked):
    engine, calls = asked
    assert list(engine.query_stream("(leaf)", "4", chunk=2)) == [(str(i), [i + 1]) for i in (4, 3, 2, 1, 0)]
    assert calls == [[0, 1, 2, 3, 4]]


def test_trees_of_some_roots_read_each_table_once(spark):
    """Levels are written when they are sized; the plan made from them reads no table again."""
    sf = "/root/testdata/sf0.001"
    roots = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS root").filter("root % 7 = 0")
    some = trees.order_forest(spark, sf, roots)
    assert "parquet" not in some._jdf.queryExecution().toString()
    every = trees.order_forest(spark, sf).filter("root % 7 = 0")
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))


def test_a_long_chain_is_crossed_in_few_jobs(spark, monkeypatch):
    graph = {str(i): [str(i - 1)] if i else [] for i in range(300)}
    steps = []
    real = history.cut
    monkeypatch.setattr(history, "cut", lambda df: steps.append(1) or real(df))
    assert {r["commit"]: r.far for r in history.Walk(frame(spark, graph)).after("299").commits().collect()} == plain(graph, ["299"])
    assert len(steps) < 16  # one for each doubling, but not two


def test_a_limited_walk_doubles_up_to_its_limit_only(spark, monkeypatch):
    """The nearest ones are all found, over merges and with commits taken out, and few steps are prepared for them."""
    graph = {str(i): [str(i - 1)] + ([str(i - 3)] if i in (12, 27) else []) if i else [] for i in range(30)}
    steps = []
    real = history.cut
    monkeypatch.setattr(history, "cut", lambda df: steps.append(1) or real(df))
    engine = Engine(frame(spark, graph), None, None)
    far, hidden = plain(graph, ["29"]), plain(graph, graph["20"])
    nearest = sorted((n, c) for c, n in far.items())[:6]
    assert [(r.far, r["commit"]) for r in engine.walk("29", limit=6).collect()] == nearest
    left = sorted((n, c) for c, n in far.items() if c not in hidden)
    assert [(r.far, r["commit"]) for r in engine.walk("29", before="20", limit=50).collect()] == left
    chain = {str(i): [str(i - 1)] if i else [] for i in range(300)}
    steps.clear()
    assert [(r.far, r["commit"]) for r in Engine(frame(spark, chain), None, None).walk("299", limit=3).collect()] == [(0, "299"), (1, "298"), (2, "297")]
    assert len(steps) < 6
