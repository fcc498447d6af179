"""Project scans, further front-ends and the engine's entry points."""

import pytest
from pyspark.sql import functions as F

from sylvan.engine import Engine
from sylvan.operators.metrics import MetricSpec
from sylvan.sources import parsers, projects
from sylvan.sources.trees import encode, parse

POM = "<project><!-- <module>no</module> --><modules><module>core</module></modules></project>"
FILES = [
    ("pom.xml", POM),
    ("core/pom.xml", "<project><build><sourceDirectory>src</sourceDirectory></build></project>"),
    ("core/src/A.java", "class A { void m() { if (x) { y(); } } }"),
    ("core/src/test/java/T.java", "class T { }"),
    ("src/main/java/B.java", "class B { }"),
    ("Makefile", "all: a.o b.o\n\tcc -o all a.o b.o\nCC = gcc\n# note\nclean:\n\trm *.o\n"),
    ("doc.md", "text"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def test_maven(files):
    m = {r.folder: r for r in projects.maven_modules(files).collect()}
    assert m[""].modules == ["core"] and m[""].holds_main and not m[""].holds_test and m[""].holds_modules
    assert m["core"].main == "core/src" and m["core"].holds_main and m["core"].holds_test is False or m["core"].test
    where = {r.path: (r.module, r.scope) for r in projects.module_of(files, projects.maven_modules(files)).collect()}
    assert where["core/src/A.java"] == ("core", "main") and where["src/main/java/B.java"] == ("", "main") and where["doc.md"] == ("", "other")


def test_make(files):
    assert sorted(((r.target, r.prerequisite) for r in projects.make_targets(files).collect()), key=str) == [("all", "a.o"), ("all", "b.o"), ("clean", None)]


def test_ingest(files, spark, tmp_path):
    entries, blobs = projects.contents(files.unionByName(files.filter("path = 'doc.md'").withColumn("path", F.lit("copy.md"))))
    assert entries.count() == 8 and blobs.count() == 7
    assert projects.unseen(blobs, blobs.limit(3)).count() == 4
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_text("class X { }")
    read = projects.read_files(spark, str(tmp_path), "*.java")
    assert read.first().text == "class X { }"
    occ = projects.parse_files(files)
    assert occ.filter("type = 'class_declaration'").count() == 3
    v = entries.withColumn("version", F.lit("v1"))
    trees = projects.version_trees(v, parse(blobs.filter("text LIKE 'class%'"), "blob", "text", "java"))
    assert trees.select("root").distinct().count() == 3
    assert projects.child_by_name(v, "core", "pom.xml").first().place == 0


@pytest.mark.parametrize("lang, text, kind", [("cpp", "#include <a>\nnamespace n { struct S { int f() { return 1; } }; }\n", "struct_declaration"), ("c", "#define A 1\nint main() { for (;;) { } }\n", "for_statement"), ("ts", "export class A { m() { return 1; } }", "export_declaration")])
def test_bracket_languages(lang, text, kind):
    rows = encode(parsers.FRONT_ENDS[lang](text))
    assert "".join(r[8] or "" for r in rows if r[4] == 1) == text and kind in {r[7] for r in rows}


def test_xml():
    rows = encode(parsers.xml('<?xml v?><a x="1"><b>t</b><c/></d></a><!--n-->'))
    assert [(r[3], r[7], r[8]) for r in rows] == [
        (0, "document", None), (1, "instruction", "xml v"), (1, "element", None), (2, "tag_name", "a"), (2, "attribute", "1"),
        (2, "element", None), (3, "tag_name", "b"), (3, "text", "t"), (2, "element", None), (3, "tag_name", "c"), (2, "ERROR", "</d>"), (1, "comment", "n"),
    ]


def test_engine(spark):
    texts = [("r1", "class A { void a() { } }"), ("r2", "class A { void a() { } void b() { } }"), ("r3", "class A { void b() { x(); } }")]
    occ = parse(spark.createDataFrame(texts, "k string, text string"), "k", "text", "java").cache()
    commits = spark.createDataFrame([("c1", []), ("c2", ["c1"]), ("c3", ["c2"])], "commit string, parents array<string>")
    e = Engine(commits, spark.createDataFrame([("c1", "r1"), ("c2", "r2"), ("c3", "r3")], "commit string, root string"), occ)
    assert {r.commit: r.counts for r in e.query("(method_declaration) (if_statement)", "c3").collect()} == {"c1": [1, 0], "c2": [2, 0], "c3": [1, 0]}
    assert list(e.query_stream("(method_declaration)", "c3", 2)) == [("c3", [1]), ("c2", [2])]
    assert e.query_differential("(method_declaration)", "c2", "c3").count() == 2
    spec = MetricSpec(F.lit(1), F.sum("value"), lambda own, acc: own + F.coalesce(acc, F.lit(0)))
    sizes = {r.commit: r.n for r in e.script(spec, "n", "c3").collect()}
    assert sizes["c2"] == occ.filter("root = 'r2' AND pre = 0").first()["size"]
    d = e.diff("c1", "c2").first()
    assert d.inserts > 0 and d.deletes == 0
    assert e.file("c1").first().text == texts[0][1]
    assert {r.commit for r in e.track("c1", [0, 4, 2], "c3").collect()} >= {"c1"}
    assert e.commit("c3", (1, 2)).first().ancestors == ["c2", "c1"]
    assert e.view("c1").count() >= 2 and e.labels(occ.filter("root = 'r1'")).count() > 3
