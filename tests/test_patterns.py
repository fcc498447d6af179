"""Pattern semantics on small trees: groups, runs, predicates, supertypes, hidden nodes, precomputed patterns."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators import metrics, patterns, refine
from sylvan.sources.trees import parse


def trees(spark, *texts):
    rows = [(f"t{i}", t) for i, t in enumerate(texts)]
    return parse(spark.createDataFrame(rows, "k string, text string"), "k", "text", "sexp")


def rows(found):
    return sorted((r.at, sorted((c["name"], c.pre) for c in r.captures)) for r in found.collect())


@pytest.mark.parametrize(
    "tree, query, expected",
    [
        ("(a (b) (c))", "(a ((b) . (c)))", 1),
        ("(a (b) (c))", "(a (b) . (c))", 1),
        ("(a (b) (d) (c))", "(a ((b) . (c)))", 0),
        ("(a (x) (b) (c))", "((b) @b . (c) @c)", 1),
        ("(k (a (b) (c)))", "(k (_ (b) . (c)))", 1),
        ("(a (b) (c) (b))", "(a [((b) . (c)) ((c) . (b))])", 1),
        ("(a (b) (c))", '(a (b) @x (c) @x (#any-eq? @x "n"))', 0),
        ('(a (b "m") (c "n"))', '(a (b) @x (c) @x (#any-eq? @x "n"))', 1),
        ('(a (b "m") (c "n"))', '(a (b) @x (c) @x (#eq? @x "n"))', 0),
        ('(a (b "n") (c "n"))', '(a (b) @x (c) @x (#eq? @x "n"))', 1),
        ('(a (b "m") (c "n"))', '(a (b) @x (c) @x (#any-not-eq? @x "n"))', 1),
        ('(a (b "m"))', '((b) @x (#any-of? @x "k" "m"))', 1),
        ('(a (b "1") (b "2"))', "(a (b) @x (b) @y (#eq? @x @y))", 0),
        ('(a (b "1") (b "1"))', "(a (b) @x (b) @y (#eq? @x @y))", 1),
        ('(a (b "1") (b "2"))', "(a (b) @x (b) @y (#not-eq? @x @y))", 1),
        ("(a (b) (b))", "(a (b)+ @x (#is? local) (#set! k \"v\"))", 1),
    ],
)
def test_matches(spark, tree, query, expected):
    assert patterns.matches(trees(spark, tree), query).count() == expected


def test_runs_are_one_row_and_the_longest(spark):
    # a0 b1 b2 c3 b4
    occ = trees(spark, "(a (b) (b) (c) (b))")
    find = lambda q: rows(patterns.matches(occ, q))
    assert find("(a (b)+ @r)") == [(0, [("r", 1), ("r", 2), ("r", 4)])]
    assert find("(a (b)+ @r (c) @c)") == [(0, [("c", 3), ("r", 1), ("r", 2)])]
    assert find("(a (b)* @r . (c) @c)") == [(0, [("c", 3), ("r", 1), ("r", 2)])]
    assert find("(a (c) @c (b)+ @r .)") == [(0, [("c", 3), ("r", 4)])]
    assert find("(a (d)* @r (c) @c)") == [(0, [("c", 3)])]
    assert find("(a (d)+ @r (c) @c)") == []
    assert find("(a . (c)+ @r)") == []
    assert find("(a (c)+ @r . (b) @b)") == [(0, [("b", 4), ("r", 3)])]
    assert find("(a [(b) (c)]+ @r)") == [(0, [("r", 1), ("r", 2), ("r", 3), ("r", 4)])]
    assert find("(a (c)? @c (b) @b .)") == [(0, [("b", 4), ("c", 3)])]


def test_runs_with_inner_captures_and_predicates(spark):
    occ = trees(spark, '(a (b (x "1")) (b (x "2")) (c))', '(a (b (x "1")) (b (x "1")))')
    q = "(a (b (x) @x)+ @b (#%s @x \"1\"))"
    assert rows(patterns.matches(occ, "(a (b (x) @x)+ @b)").filter("root = 't0'")) == [(0, [("b", 1), ("b", 3), ("x", 2), ("x", 4)])]
    roots = lambda q: sorted(r.root for r in patterns.matches(occ, q).collect())
    assert (roots(q % "eq?"), roots(q % "any-eq?"), roots(q % "not-eq?")) == (["t1"], ["t0", "t1"], [])


def test_unknown_names_raise(spark):
    occ = trees(spark, "(a (b))")
    for query in ("(nonsense/b)", "(a (b) @x (#eq? @y \"1\"))", "(a (b) @x (#near? @x))", "(a ((b) (c))+)"):
        with pytest.raises(ValueError):
            patterns.matches(occ, query).count()
    near = {"#near?": lambda texts, far: F.exists(texts, lambda t: t.isNull()) & F.lit(far == "3")}
    assert patterns.matches(occ, '(a (b) @x (#near? @x "3"))', predicates=near).count() == 1
    assert patterns.matches(occ, '(a (b) @x (#near? @x "4"))', predicates=near).count() == 0


def test_hidden_nodes_are_looked_through(spark):
    occ = trees(spark, "(a (_h (_h (b) (c)) (d)) (e))").withColumn("is_hidden", F.col("type") == "_h")
    assert [patterns.matches(occ, q).count() for q in ("(a (b) . (c) . (d) . (e) .)", "(a . (b))", "(_h)", "(a (b) . (e))")] == [1, 1, 0, 0]
    assert patterns.matches(occ.drop("is_hidden"), "(a . (_h) . (e) .)").count() == 1


def test_precomputed_patterns_skip_nothing_that_matches(spark):
    occ = trees(spark, "(p (m (n)) (k))", "(p (m) (k))", "(p (k))")
    ready = "(m (n))\n(k)"
    assert patterns.shared_patterns("(p (m (n)) @x (k)) (k) (p (k)?)", ready) == [[0, 1], [1], []]
    bits = patterns.match_bits(occ, ready)
    assert {r.root: r.bits for r in bits.filter("pre = 0").collect()} == {"t0": 3, "t1": 2, "t2": 2}
    for q in ("(p (m (n)) @x (k))", "(k)", "(p (k)? @o)", "(p)"):
        assert rows(patterns.with_precomputed(bits, q, ready)) == rows(patterns.matches(occ, q))


def test_duplicates_do_not_come_from_steps_without_captures(spark):
    occ = trees(spark, "(a (b) (b) (c))")
    assert rows(patterns.matches(occ, "(a (b) (c) @c)")) == [(0, [("c", 3)])]
    assert rows(patterns.matches(occ, "[(a (b)) (a (c))] @a")) == [(0, [("a", 0)])]


@pytest.mark.parametrize("query", ["(a . (b !f) @x name: [(c) (d)]+ _ .)", '(a "+" (s/b (#EQ? "x")) @y)', "[(a (b)) (c)] @t", "((a) @x . (b))"])
def test_patterns_print_as_they_are_read(query):
    (p,) = patterns.parse(query)
    again = patterns.parse(patterns.to_text(p.root))[0]
    assert patterns.to_text(again.root) == patterns.to_text(p.root)


def test_refinements():
    q = '(a (b) @x . (c (d) @y) (#eq? @x "1"))'
    assert refine.select(q, (1,)) == "(c (d) @y)"
    assert refine.remove(q, [(0,)]) == "(a (c (d) @y))"
    assert refine.remove(q, [(1, 0)]) == '(a (b) @x . (c)) (#eq? @x "1")'
    assert refine.capture(q, (1,), "z") == '(a (b) @x . (c (d) @y) @z) (#eq? @x "1")'
    assert refine.uncapture(q, "x") == "(a (b) . (c (d) @y))"
    assert refine.rename(q, {"x": "y", "y": "x"}) == '(a (b) @y . (c (d) @x)) (#eq? @y "1")'
    assert refine.union([q, "(k)", q]).count("\n") == 1
    assert refine.regenerate(q, [("delete", (0,)), ("replace", (1, 0), "(e)"), ("insert", (2,), "(f)")]) == "(a (c (e)) (f))"
    for bad in (lambda: refine.remove(q, [()]), lambda: refine.capture(q, (), "x"), lambda: refine.rename(q, {"x": "y"}), lambda: refine.select("(a) (b)", ())):
        with pytest.raises(ValueError):
            bad()


def test_metrics_as_text(spark):
    occ = trees(spark, "(a (b (c)) (d))")
    spec = metrics.MetricSpec.of("CASE WHEN type = 'c' THEN 5 ELSE 1 END", "sum(value)", "own + coalesce(acc, 0)")
    assert {r.pre: r.v for r in metrics.bottom_up(occ, spec, "v").collect()} == {0: 8, 1: 6, 2: 5, 3: 1}
    deep = trees(spark, "(a " * 30 + ")" * 30)
    assert {r.v for r in metrics.bottom_up(deep, metrics.MetricSpec.of("1", "sum(value)", "own + coalesce(acc, 0)"), "v").collect()} == set(range(1, 31))
    one, two = trees(spark, "(a (b) (c))"), trees(spark, "(a (c) (b))")
    top = lambda df: df.filter("pre = 0").first()[2]
    assert top(metrics.bag_hash(one)) == top(metrics.bag_hash(two)) and top(metrics.merkle(one)) != top(metrics.merkle(two))
