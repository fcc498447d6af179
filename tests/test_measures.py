"""Measures summed where trees are made, and texts handed on in slices."""

import random

import pytest
from pyspark.sql import functions as F

from sylvan.operators import metrics, navigation, serialize
from sylvan.plans import catalog
from sylvan.sources import trees

NAMES = ("bytes_len", "line_count", "loc", "size_no_spaces")
TEXTS = ["", "\n", "a  b\n\n c\n", "é\x85x\n\t\n", "\n".join("w " * (i % 5) for i in range(40)), None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_measures_of_every_node(spark, texts):
    """Those of the plans over occurrences, also beside comments (Java)."""
    java = spark.createDataFrame([(7, "class A {\n  // c\n  int x;\n /* d */ /* e */\n\n int y; }\n")], "id long, text string")
    for df, lang in ((texts, "text"), (java, "java")):
        plain = trees.parse(df, "id", "text", lang)
        expected = metrics.bytes_len(metrics.line_count(metrics.loc(metrics.size_no_spaces(plain)))).select("root", "pre", *NAMES)
        found = trees.parse(df, "id", "text", lang, sums=NAMES).select("root", "pre", *NAMES)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_document_metrics_need_no_exchange(spark):
    assert "Exchange" not in plan_of(catalog.queries()["document_metrics"](spark, "/root/testdata/sf0.001"))

def test_lines_from_what_lies_before(spark, texts):
    occ = trees.parse(texts, "id", "text", "text")
    expected = navigation.line_ranges(occ).join(occ.filter("type = 'line'").select("root", "pre"), ["root", "pre"])
    kept = trees.parse(texts, "id", "text", "text", sums=("line_count",), before=("line_count",), keep=lambda row: row[7] == "line")
    assert {r.type for r in kept.collect()} == {"line"}
    found = kept.select("root", "pre", F.col("line_count_before") + 1, F.col("line_count_before") + F.col("line_count") + 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_document_lines_leave_words_where_they_are(spark):
    plan = plan_of(catalog.queries()["document_lines"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "Join" not in plan

def test_slices_hold_few_nodes(texts, monkeypatch):
    """Texts and nodes go in slices of bounded size; the rows are the same."""
    whole = sorted(trees.parse(texts, "id", "text", "text").collect(), key=lambda r: (r.root, r.pre))
    monkeypatch.setattr(trees, "TEXTS", 2)
    monkeypatch.setattr(trees, "NODES", 3)
    seen = []
    frames = trees.pieces(texts.toArrow().to_batches(), lambda r, t: [[r, i] for i in range(len(t or ""))], ["root", "i"], ["bigint"])
    seen = [b.num_rows for b in frames]
    assert max(seen) <= 3 and sum(seen) == sum(len(t or "") for t in TEXTS)
    assert sorted(trees.parse(texts, "id", "text", "text").collect(), key=lambda r: (r.root, r.pre)) == whole


def test_reprinted_texts(texts):
    """As the leaves put together on the plans do; rows of one id and empty texts each count."""
    twice = texts.union(texts)
    assert sorted(map(tuple, trees.reprinted(twice, "id", "text", "text").collect())) == sorted([(i, True) for i in range(len(TEXTS))] * 2)
    printed = {r.root: r.text for r in serialize.source(trees.parse(texts, "id", "text", "text")).collect()}
    assert all(printed.get(i, "") == (t or "") for i, t in enumerate(TEXTS))


def test_round_trip_needs_no_exchange(spark):
    assert "Exchange" not in plan_of(catalog.queries()["text_round_trip"](spark, "/root/testdata/sf0.001"))


def test_encoding_against_a_plain_one():
    """Sizes, places and heights of random pre-orders, gaps in depth included."""
    draw = random.Random(3)
    for _ in range(300):
        depths = [draw.randint(0, 4) for _ in range(draw.randint(0, 12))]
        rows = trees.encode((d, "k", None, None, 0, 0) for d in depths)
        for i, d in enumerate(depths):
            up = next((j for j in range(i - 1, -1, -1) if depths[j] < d and all(depths[k] > depths[j] for k in range(j + 1, i))), None)
            size = next((j for j in range(i + 1, len(depths)) if depths[j] <= d), len(depths)) - i
            assert rows[i][:5] == [i, up, sum(r[1] == up for r in rows[:i]) if up is not None else 0, d, size]
            assert rows[i][6] == max((r[6] + 1 for r in rows if r[1] == i), default=0)
