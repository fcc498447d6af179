"""Edit scripts and mappings as rows, following nodes by mappings, types and folds."""

from pyspark.sql import functions as F

from sylvan.operators import diff, history, metrics, patterns, serialize
from sylvan.sources import types
from sylvan.sources.trees import parse

SOURCES = [("a", '(f (g "x") (h "y"))'), ("b", '(f (h "y") (g "x"))'), ("c", '(f (h "z"))'), ("e", "")]


def trees(spark):
    occ = parse(spark.createDataFrame(SOURCES, "key string, text string"), "key", "text", "sexp").filter("type <> 'spaces'")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "none")], "pair int, src_root string, dst_root string")
    return occ, pairs


def test_action_rows_agree_with_summaries(spark):
    occ, pairs = trees(spark)
    rows = diff.actions(pairs, occ, "simple").groupBy("pair", "kind").count().collect()
    summary = {r.pair: r for r in diff.diff_pairs(pairs, occ, "simple").collect()}
    assert set(summary) == {1, 2}
    for pair, r in summary.items():
        counted = {x.kind: x["count"] for x in rows if x.pair == pair}
        assert {k: r[k + "s"] for k in ("insert", "update", "move", "delete") if r[k + "s"]} == counted


def test_mapping_against_itself_has_no_difference(spark):
    occ, pairs = trees(spark)
    links = diff.mappings(pairs, occ, "simple")
    assert links.count() and all(r.missing == r.additional == 0 for r in diff.compare_mappings(links, links).collect())
    fewer = links.filter("src > 0")
    assert all(r.missing == 1 and r.additional == 0 for r in diff.compare_mappings(fewer, links).collect())


def test_scripts_as_text(spark):
    occ, pairs = trees(spark)
    for r in diff.script_text(diff.actions(pairs, occ, "simple")).collect():
        assert all(x.split()[0] in ("insert", "update", "move", "delete") for x in r.script.split("\n"))


def test_following_falls_back_to_an_ancestor(spark):
    occ, pairs = trees(spark)
    links = spark.createDataFrame([(1, 0, 0)], "pair int, src long, dst long")
    wanted = spark.createDataFrame([("a", 0), ("a", 2), ("zz", 0)], "root string, pre long")
    out = {(r.root, r.pre): (r.next_pre, r.status) for r in history.follow(wanted, pairs, links, occ).collect()}
    assert out == {("a", 0): (0, "direct"), ("a", 2): (0, "missing"), ("zz", 0): (None, "last")}


def test_types_and_supertypes_in_patterns(spark):
    rows = [("r", 0, None, 0, 0, 2, 1, "block", None), ("r", 1, 0, 0, 1, 1, 0, "binary_expression", "x")]
    occ = spark.createDataFrame(rows, "root string, pre long, parent long, pos int, depth int, size long, height int, type string, label string").withColumn("role", F.lit(None).cast("string"))
    typed = types.typed(occ)
    n = lambda q: patterns.matches(typed, q).count()
    assert (n("(expression/binary_expression) @x"), n("(statement/binary_expression) @x"), n("(statement/_) @x")) == (1, 0, 1)
    assert {r.type: r.supertypes for r in types.dimension(occ).collect()} == {"block": ["statement"], "binary_expression": ["expression"]}
    assert types.declarations(occ).count() == 0


def test_a_filtered_fold_leaves_out_whole_subtrees(spark):
    occ, _ = trees(spark)
    kept = metrics.top_down(occ, F.lit(0), lambda above: above + 1, "level", F.col("depth") < 2)
    assert kept.filter("level > 1").count() == 0
    joined = kept.join(occ, ["root", "pre"])
    assert joined.filter("level <> depth").count() == 0 and joined.count() == occ.filter("depth < 2").count()


def test_indentation(spark):
    df = spark.createDataFrame([("  a\n    b\nc",)], "t string")
    assert df.select(serialize.reindented(F.col("t"), "  ", "\t")).first()[0] == "\ta\n\t  b\nc"
    assert df.select(serialize.indentation(F.lit("\n\n   "))).first()[0] == "   "
