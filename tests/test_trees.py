"""Front-ends, navigation, metrics, patterns and serializers on small trees."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators import graph, metrics, navigation, patterns, serialize
from sylvan.sources import parsers
from sylvan.sources.trees import encode, parse

JAVA = """package a;
// first
class A {
  /* doc */
  int f(int x) {
    if (x > 0) { return g(x); }
    for (;;) { }
    return 0;
  }
  void test() { assertEquals(1, f(2)); assertTrue(f(3)); }
  void empty() {}
}
"""


@pytest.fixture(scope="module")
def occ(spark):
    return parse(spark.createDataFrame([("a", JAVA), ("b", "class B { }\n"), ("c", None)], "k string, text string"), "k", "text", "java").cache()


@pytest.mark.parametrize("text", [JAVA, "", "}{", "a(b", 'x = "un', "class C { void m() { } }", "/* open", "{{{{"])
def test_java_leaves_reprint(text):
    rows = encode(parsers.java(text))
    assert "".join(r[8] or "" for r in rows if r[4] == 1) == text


@pytest.mark.parametrize("text", ["", "\n", "a b\n\n c", " x ", "one\ttwo\n"])
def test_lines_reprint(text):
    assert "".join(r[8] or "" for r in encode(parsers.lines(text)) if r[4] == 1) == text


def test_intervals():
    rows = encode(parsers.sexp('(a (b "x") (c (d) (e)))'))
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in rows] == [
        (0, None, 0, 0, 5, 4, 2, "a", None),
        (1, 0, 0, 1, 1, 0, 0, "b", "x"),
        (2, 0, 1, 1, 3, 3, 1, "c", None),
        (3, 2, 0, 2, 1, 1, 0, "d", None),
        (4, 2, 1, 2, 1, 2, 0, "e", None),
    ]


def test_html_and_json_survive_anything():
    assert [n[1] for n in parsers.html("<p>a<br>b<ul><li>x</p>")] == ["document", "p", "text", "br", "text", "ul", "li", "text"]
    assert [n[1] for n in parsers.json_tree('{"a": [1, null], "b": "x"}')] == ["object", "pair", "array", "number", "null", "pair", "string"]
    assert [n[1] for n in parsers.json_tree("{")] == ["ERROR"]


def test_source_and_metrics(occ):
    assert dict(map(tuple, serialize.source(occ).collect())) == {"a": JAVA, "b": "class B { }\n", "c": ""}
    mcc = {(r.root, r.type): r.mcc for r in metrics.mcc(occ).filter("type IN ('program', 'class_declaration')").collect()}
    assert mcc["a", "program"] == 3 and mcc["b", "class_declaration"] == 1
    lines = {r.root: r.line_count for r in metrics.line_count(occ).filter("pre = 0").collect()}
    assert lines == {"a": JAVA.count("\n"), "b": 1, "c": 0}
    loc = {r.root: r.loc for r in metrics.loc(occ).filter("pre = 0").collect()}
    assert loc["b"] == 1 and loc["a"] == JAVA.count("\n") - 2


def test_merkle_tells_orders_apart(spark):
    df = spark.createDataFrame([("x", "(a (b) (c))"), ("y", "(a (c) (b))"), ("z", "(a (b) (c))")], "k string, text string")
    h = metrics.merkle(parse(df, "k", "text", "sexp")).filter("pre = 0").collect()
    by = {r.root: r.content for r in h}
    assert by["x"] == by["z"] != by["y"]


def test_positions(occ):
    at = JAVA.index("return 0")
    ranges = occ.sparkSession.createDataFrame([("a", at, at + 6)], "root string, range_start int, range_end int")
    assert [r.label for r in navigation.node_at_range(occ, ranges).collect()] == ["return"]
    first = {r.pre: (r.first_line, r.last_line) for r in navigation.line_ranges(occ.filter("root = 'a'")).collect()}
    method = occ.filter("root = 'a' AND type = 'method_declaration'").orderBy("pre").first()
    assert first[method.pre] == (5, 9)


def test_no_space_view(occ):
    view = navigation.without_spaces(occ.filter("root = 'b'")).orderBy("pre").collect()
    assert [r.pre for r in view] == list(range(len(view))) and all(r.type != "spaces" for r in view)
    assert view[0].size == len(view)


@pytest.mark.parametrize(
    "query, expected",
    [
        ("(method_declaration)", 3),
        ('(method_declaration name: (identifier) @n (#eq? @n "f"))', 1),
        ('(method_declaration name: (identifier (#EQ? "f")))', 1),
        ('(method_declaration name: (identifier (#NOT-EQ "f")))', 2),
        ('(method_declaration (block . "{" . "}"))', 1),
        ('(block (expression_statement (method_invocation name: (identifier) @a (#match? @a "^assert"))) . (expression_statement))', 1),
        ('(if_statement condition: (parenthesized_expression (binary_expression left: (identifier) right: (_) @r)))', 1),
        ("(expression/method_invocation arguments: (argument_list (_)+ @args))", 5),
        ("(block (statement/_)+ @s)", 3),
        ("(method_declaration body: (block . (expression_statement) @a . (expression_statement) @b .))", 1),
        ('((identifier) @x (#eq? @x "x"))', 3),
        ("(class_body ((method_declaration) @a . (method_declaration) @b))", 2),
        ("(class_declaration !name)", 0),
        ("[(if_statement) (for_statement)] @x", 2),
        ('((line_comment) . (class_declaration))', 1),
        ('(method_declaration (identifier) @n (#any-of? @n "test" "empty"))', 2),
        ('(method_declaration (identifier) @n (#not-match? @n "^(test|empty)$"))', 1),
    ],
)
def test_patterns(occ, query, expected):
    assert patterns.matches(occ.filter("root = 'a'"), query).count() == expected


def test_pattern_options(occ):
    two = "(method_declaration) (if_statement)"
    assert [r.matches for r in patterns.counts(occ.filter("root = 'b'"), two).orderBy("pattern").collect()] == [0, 0]
    assert patterns.matches(occ, two, enabled=[1]).select("pattern").distinct().first()[0] == 1
    assert patterns.matches(occ, "(program)", root_only=True).count() == 3
    assert patterns.limited(patterns.matches(occ, "(identifier)"), 2).groupBy("root").count().agg(F.max("count")).first()[0] == 2
    with pytest.raises(ValueError):
        patterns.parse("(a %")


def test_precomputed_bits_skip_nothing_that_matches(occ):
    bits = metrics.precomputed_bits(occ, [F.col("type") == "if_statement"])
    kept = patterns.skip_by_bits(bits, "bits", 1)
    assert kept.select("root").distinct().collect()[0].root == "a"
    assert patterns.matches(kept, "(if_statement)").count() == patterns.matches(occ, "(if_statement)").count()


def test_serializers(spark):
    df = spark.createDataFrame([("x", '(a (b "x") (c (d)))')], "k string, text string")
    occ = parse(df, "k", "text", "sexp")
    assert serialize.sexpressions(occ).first().sexp == '(a (b "x") (c (d)))'
    assert serialize.sexpressions(occ, labels=False, ids=True).first().sexp == "(a#0 (b#1) (c#2 (d#3)))"
    assert serialize.outline(occ).first().outline == "a\n  b x\n  c\n    d"
    assert serialize.json_trees(occ).first().json == '{"type": "a", "children": [{"type": "b", "label": "x"}, {"type": "c", "children": [{"type": "d"}]}]}'
    assert {r.kind: r.nodes for r in serialize.view(occ).collect()} == {"children": [0, 2], "labeled": [1], "typed": [3]}


def test_graph(occ):
    s = graph.Stanza("(method_declaration name: (identifier) @n) @m", {"m": ["scope"], "n": ["def"]}, [(("n", "def"), ("m", "scope"))], {("n", "def"): {"symbol": "text", "kind": "method"}})
    nodes, edges = graph.build(occ, [s])
    assert edges.count() == 3
    assert {r.attributes["symbol"] for r in nodes.filter("id LIKE '%.def'").collect()} == {"f", "test", "empty"}
