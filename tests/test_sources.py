"""Front-ends on valid, broken and very deep texts; repositories, grammars, folders."""

import json
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylvan.operators import diff, serialize
from sylvan.sources import parsers, projects, types
from sylvan.sources.java import java
from sylvan.sources.trees import encode

DEEP = 100_000


def reprinted(lang, text):
    return "".join(r[8] or "" for r in encode(parsers.FRONT_ENDS[lang](text)) if r[4] == 1)


@pytest.mark.parametrize(
    "statement, kind",
    [
        ("a = b ? c : d;", "ternary_expression"),
        ("x >>>= 2;", "assignment_expression"),
        ("int[] a = new int[3][];", "array_creation_expression"),
        ("Object o = (A & B) () -> {};", "cast_expression"),
        ("f(x -> x + 1, Foo::new, int[]::new);", "method_reference"),
        ("for (final String s : xs) s.f();", "enhanced_for_statement"),
        ("switch (x) { case 1, 2 -> f(); default -> { } }", "switch_rule"),
        ("try (R r = f(); s) { } catch (A | B e) { } finally { }", "try_with_resources_statement"),
        ("if (o instanceof Foo f && f.x > 1) return;", "instanceof_expression"),
        ("new A<>() { int x; }.f();", "object_creation_expression"),
        ('String s = """\n a "b" """;', "string_literal"),
        ("List<Map<String, ? extends T[]>> l;", "wildcard"),
        ("Class<?> c = String[].class;", "class_literal"),
        ("synchronized (this) { }", "synchronized_statement"),
        ("record P(int x) { P { } }", "record_declaration"),
        ("a: while (true) break a;", "labeled_statement"),
        ("é ß = ü;", "local_variable_declaration"),
        ("int x = switch (d) { case MON -> 1; default -> { yield 2; } };", "yield_statement"),
    ],
)
def test_java_statements(statement, kind):
    text = "class T { void t() { " + statement + " } }"
    kinds = Counter(n[1] for n in java(text))
    assert kinds[kind] and not kinds["ERROR"] and reprinted("java", text) == text


@pytest.mark.parametrize("text", ["class A { void f() { x = 1 int y; if ( } void g() {} }", "int f( {", "((((", "'", '"x', "@", "<T>", "x ->", "new int", "}}} class A {}", "switch(x){ int y; }"])
def test_broken_java_is_reprinted(text):
    kinds = Counter(n[1] for n in java(text))
    assert reprinted("java", text) == text and kinds["ERROR"]


def test_one_broken_statement_spoils_nothing_else():
    names = [n[1] for n in java("class A { void f() { x = 1 int y; } void g() { h(); } }")]
    assert names.count("method_declaration") == 2 and "method_invocation" in names


@pytest.mark.parametrize("lang, text", [("java", "x = " + "(" * DEEP + "1" + ")" * DEEP + ";"), ("java", "{" * DEEP), ("java", "a" + "+a" * DEEP + ";"), ("json", "[" * DEEP + "]" * DEEP), ("cpp", "{(" * DEEP), ("sexp", "(a " * DEEP), ("html", "<b>" * DEEP), ("xml", "<b>" * DEEP + "</b>" * DEEP)])
def test_deep_texts(lang, text):
    rows = encode(parsers.FRONT_ENDS[lang](text))
    assert max(r[3] for r in rows) >= DEEP - 1
    if lang in ("java", "cpp"):
        assert "".join(r[8] or "" for r in rows if r[4] == 1) == text


def test_json_agrees_with_the_standard_reader():
    for text in ['{"a": [1, -2.5e3, true, null, "x\\n\\u00e9"], "b": {}}', "[]", "3", '"s"', "[1,]", '{"a"}', "01", "[1 2]", "nul", '"\x01"', "{,}", '{"a":1}x']:
        try:
            value = json.loads(text)
        except ValueError:
            assert [n[1] for n in parsers.json_tree(text)] == ["ERROR"], text
            continue
        kinds = Counter(n[1] for n in parsers.json_tree(text))

        def count(v, seen):
            seen[{dict: "object", list: "array", str: "string"}.get(type(v), "x") if not isinstance(v, bool) else str(v).lower()] += 1
            for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
                seen["pair"] += isinstance(v, dict)
                count(x, seen)
            return seen

        want = count(value, Counter())
        assert all(kinds[k] == n for k, n in want.items() if k != "x")


@pytest.mark.parametrize("algorithm", ["simple", "greedy_100", "hybrid", "xy", "subtree", "change_distiller"])
def test_long_chains_differ_without_recursion(algorithm):
    def chain(n, last):
        spec = ("a", last)
        for _ in range(n):
            spec = ("a", None, [spec])
        return diff.Tree.nested(spec)

    n = 1500
    s, d = chain(n, "x"), chain(n, "y")
    if algorithm == "greedy_100":
        d = chain(n, "x")
    script = diff.edit_script(s, d, diff.match(s, d, algorithm))
    (made,) = diff.apply(s, d, script)
    want = diff.nested(d)
    for _ in range(n):
        assert made[:2] == want[:2] and len(made[2]) == len(want[2]) == 1
        made, want = made[2][0], want[2][0]


def test_leaves_by_granularity():
    spec = ("block", None, [("if_statement", None, [("x", "c"), ("expression_statement", None, [("y", "call"), ("z", ";")])]), ("return_statement", None, [("w", "r")])])
    t = diff.Tree.nested(spec)
    assert [t.type[i] for i in diff.leaves_of(t, "all")] == ["x", "y", "z", "w"]
    assert [t.type[i] for i in diff.leaves_of(t, "statements")] == ["x", "expression_statement", "return_statement"]


def test_recovery_of_hybrid_and_xy():
    s = diff.Tree.nested(("r", None, [("a", "1", [("b", "2"), ("c", "3")]), ("d", "4")]))
    d = diff.Tree.nested(("r", None, [("a", "9", [("b", "8"), ("c", "7")]), ("d", "6")]))
    for how, limit, links in (("hybrid", 100, 5), ("hybrid", 2, 5), ("xy", 100, 3), ("simple", 100, 5), ("zs", 1, 1)):
        m = diff.Mapping()
        m.link(0, 0)
        diff.recover(s, d, m, 0, 0, how, limit)
        assert len(m.src) == links, (how, limit)
    m.cut(0)
    assert not m.src and not m.mirrored().src


def test_a_git_repository(spark, tmp_path):
    repo = str(tmp_path / "repo")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], cwd=repo, check=True, capture_output=True)
    (tmp_path / "repo").mkdir()
    git("init", "-q")
    for i, text in enumerate(["class A {}", "class A { int x; }"]):
        (tmp_path / "repo" / "A.java").write_text(text)
        (tmp_path / "repo" / "same.txt").write_text("same")
        git("add", ".")
        git("commit", "-q", "-m", f"commit {i}")
    commits, entries, blobs = projects.read_repository(spark, repo)
    rows = {r.message: r for r in commits.collect()}
    assert rows["commit 1"].parents == [rows["commit 0"].commit] and rows["commit 0"].parents == []
    assert entries.count() == 4 and sorted(r.text for r in blobs.collect()) == sorted(["class A {}", "class A { int x; }", "same"])
    assert projects.with_fork(commits, commits.filter("message = 'commit 0'")).count() == 2
    pulls = spark.createDataFrame([(1, rows["commit 1"].commit, "h", True), (2, "zz", "h", True), (3, rows["commit 0"].commit, "h", False)], "number int, merge string, head string, merged boolean")
    assert [r.number for r in projects.pull_requests(pulls, commits).collect()] == [1]


def test_folder_pairs(spark):
    before = spark.createDataFrame([("a.java", "class A { int x; }"), ("gone.java", "class G {}")], "path string, text string")
    after = spark.createDataFrame([("a.java", "class A { int y; }"), ("new.java", "class N {}")], "path string, text string")
    pairs, occ = projects.folder_pairs(before, after), projects.parse_sides(before, after)
    (row,) = diff.diff_pairs(pairs, occ, "greedy").collect()
    assert row.pair == "a.java" and row.updates == 1 and row.inserts == row.deletes == 0


def test_types_of_a_grammar(spark):
    text = json.dumps([{"type": "expression", "named": True, "subtypes": [{"type": "call", "named": True}]}, {"type": "call", "named": True, "fields": {"name": {}}}, {"type": "_literal", "named": True}, {"type": "+", "named": False}])
    rows = {r.type: r for r in types.of_grammar(spark, text, "toy").collect()}
    assert rows["call"].supertypes == ["expression"] and rows["call"].fields == ["name"] and rows["_literal"].is_hidden and not rows["+"].is_named


def test_relations_and_tables_round_trip(spark, tmp_path):
    at = lambda f, o: {"file": f, "offset": o, "len": 1}
    (tmp_path / "r.json").write_text(json.dumps([{"module": "m", "content": [{"decl": at("a", 1), "refs": [at("b", 2), at("b", 3)]}, {"decl": at("a", 9), "refs": []}]}]))
    rows = serialize.read_relations(spark, str(tmp_path / "r.json"))
    assert sorted((r.offset, r.ref_offset) for r in rows.collect() if r.ref_offset) == [(1, 2), (1, 3)] and rows.filter("ref_file IS NULL").count() == 1
    serialize.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_strings(spark):
    from sylvan.functions import scalars

    assert scalars.common_run("xabcy", "zabcab") == "abc" and scalars.common_run("", "a") == ""
    assert scalars.hunks([(0, 1), (1, 2), (4, 3)]) == [(0, 2, 1, 3), (4, 5, 3, 4)]
    assert sorted(scalars.pearson_table(3)) == list(range(256))
    df = spark.createDataFrame([("abc",), ("",), ("é",)], "t string")
    table = scalars.pearson_table(1)

    def plain(t):
        h = 0
        for c in t:
            h = table[h ^ (ord(c) & 255)]
        return h

    assert [r[0] for r in df.select(scalars.pearson(F.col("t"), 1)).collect()] == [plain(t) for t in ("abc", "", "é")]
    assert all(0 <= r[0] < 100 for r in df.select(scalars.hash16(F.col("t"), 100)).collect())


def test_a_reference_needs_its_semicolon():
    """Without one it is part of the text around it, in one node with it; also at the end and in front of a tag."""
    nodes = [(n[1], n[2]) for n in parsers.html("<p>a &am</p><b>x &quo y&amp;z</b><i>&lt</i>&#39;&#39 &am")]
    assert [n for n in nodes if n[0] in ("text", "entity")] == [("text", "a &am"), ("text", "x &quo y"), ("entity", "amp"), ("text", "z"), ("text", "&lt"), ("entity", "39"), ("text", "&#39 &am")]
    for text in ("a&am<b>c &quo;d</b>", "&#39;x&#39y"):
        assert all(n[2] in (text[n[4] : n[5]], text[n[4] + 1 : n[5] - 1], text[n[4] + 2 : n[5] - 1]) for n in parsers.html(text) if n[1] in ("text", "entity"))
