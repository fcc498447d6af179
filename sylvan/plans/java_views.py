"""Registered queries over a small Java project and small labelled trees, with the rows they must give.

What SQL can't express on the tables (grammars, reference solving, tree matching) is held
against rows worked out by hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators import diff, java_references, metrics, navigation, references, serialize, smells, tracking
from sylvan.operators.lineage import cut
from sylvan.plans.catalog import query
from sylvan.sources import projects, types
from sylvan.sources.trees import parse

FILES = {
    "pom.xml": "<project><modules><module>core</module></modules></project>",
    "core/pom.xml": "<project><!-- <module>no</module> --></project>",
    "core/src/main/java/p/A.java": """package p;
import q.Util;
public class A extends B implements Runnable {
  int count = 1;
  static A make(int n) { A a = new A(); a.count = n; return a; }
  // about twice
  int twice(int n) {
    if (n > 0) { for (int i = 0; i < n; i++) { count += i; } } else { return n > 1 ? n : base(n); }
    switch (n) { case 1: break; default: count--; }
    try { Util.log(count); } catch (RuntimeException e) { throw e; }
    return this.count * 2;
  }
  public void run() { twice(make(3).count); }
}
""",
    "core/src/main/java/p/B.java": "package p;\nclass B { int base(int n) { while (n > 0 && n < 9) n--; return n; } }\n",
    "core/src/main/java/q/Util.java": "package q;\npublic class Util { public static void log(int x) { do { x--; } while (x > 0); } }\n",
    "core/src/test/java/p/ATest.java": """package p;
class ATest {
  ATest() { }
  @Test void same() { assertThat(1); assertThat(1); }
  @Test void slow() { Thread.sleep(10); System.out.println("x"); }
  @Ignored @Test void nothing() {}
  @Test void text() { assertEquals(a.toString(), b); assertThat(x, x); }
  @Test void fails() { try { f(); fail(); } catch (E e) { } if (b) { assertSame(1, 2); } }
}
""",
    "native/Makefile": "all: x.o y.o\n\tcc -o all\nclean:\n\trm all\n",
    "native/x.cpp": "int main() { if (1) { return 0; } }\n",
}
NAMES = {name: name.rsplit("/", 1)[-1] for name in FILES}


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL that gives rows."""
    value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) t({columns})"


def files(spark) -> DataFrame:
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


def java_trees(spark) -> DataFrame:
    return cut(projects.parse_files(files(spark).filter(F.col("path").endswith(".java"))))


def short(column) -> F.Column:
    return F.element_at(F.split(column, "/"), -1)


@query(expected("file, type, name, mcc, jacoco", [
    ("A.java", "method_declaration", "make", 1, 1), ("A.java", "method_declaration", "twice", 8, 6), ("A.java", "method_declaration", "run", 1, 1), ("A.java", "class_declaration", "A", 8, 6),
    ("B.java", "method_declaration", "base", 2, 3), ("B.java", "class_declaration", "B", 2, 3), ("Util.java", "method_declaration", "log", 2, 2), ("Util.java", "class_declaration", "Util", 2, 2),
]))
def java_complexity(spark, sf_dir):
    """Complexity of methods and classes: forks plus one, and as JaCoCo counts."""
    occ = java_trees(spark).filter(~F.col("root").contains("/test/"))
    names = occ.filter("role = 'name'").select("root", F.col("parent").alias("pre"), F.col("label").alias("name"))
    one = metrics.mcc(occ).filter(F.col("type").isin("method_declaration", "class_declaration"))
    two = metrics.mcc_jacoco(occ).select("root", "pre", F.col("mcc").alias("jacoco"))
    return one.join(names, ["root", "pre"]).join(two, ["root", "pre"]).select(short(F.col("root")).alias("file"), "type", "name", "mcc", "jacoco")


@query(expected("file, type, n", [
    ("A.java", "method_invocation", 4), ("A.java", "binary_expression", 4), ("A.java", "ternary_expression", 1), ("A.java", "field_access", 3), ("A.java", "assignment_expression", 2),
    ("A.java", "update_expression", 2), ("A.java", "switch_label", 2), ("A.java", "object_creation_expression", 1), ("A.java", "local_variable_declaration", 2), ("A.java", "superclass", 1),
    ("A.java", "super_interfaces", 1), ("A.java", "line_comment", 1), ("B.java", "while_statement", 1), ("B.java", "binary_expression", 3), ("B.java", "update_expression", 1),
    ("Util.java", "do_statement", 1), ("Util.java", "binary_expression", 1), ("Util.java", "update_expression", 1), ("Util.java", "modifiers", 2), ("A.java", "modifiers", 3),
]))
def java_grammar_nodes(spark, sf_dir):
    """What the Java grammar makes of expressions, statements and clauses."""
    kinds = "method_invocation binary_expression ternary_expression field_access assignment_expression update_expression switch_label object_creation_expression local_variable_declaration superclass super_interfaces line_comment while_statement do_statement modifiers".split()
    occ = java_trees(spark).filter(~F.col("root").contains("/test/"))
    return occ.filter(F.col("type").isin(kinds)).groupBy(short(F.col("root")).alias("file"), "type").agg(F.count("*").alias("n"))


@query(expected("path, same", [(p, True) for p in FILES if p.endswith((".java", ".cpp"))]))
def source_round_trips(spark, sf_dir):
    """Files of bracket languages are reprinted by their leaves, whatever the grammar makes of them."""
    printed = serialize.source(projects.parse_files(files(spark))).select(F.col("root").alias("path"), F.col("text").alias("printed"))
    rows = files(spark).filter(F.col("path").rlike("[.](java|cpp)$"))
    return rows.join(printed, "path").select("path", (F.col("text") == F.col("printed")).alias("same"))


@query(expected("file, statements, member_imports, leaves", [("A.java", 15, 1, 260), ("B.java", 3, 0, 53), ("Util.java", 2, 0, 53)]))
def java_counts_below(spark, sf_dir):
    """Statements, imports and leaves below the roots; white space and comments are leaves too."""
    occ = metrics.counts_below(java_trees(spark).filter(~F.col("root").contains("/test/")))
    return occ.filter("pre = 0").select(short(F.col("root")).alias("file"), "statements", "member_imports", "leaves")


@query(expected("file, name, use, line, declared_file, declared_type", [
    ("A.java", "B", "type", 3, "B.java", "class_declaration"), ("A.java", "A", "type", 5, "A.java", "class_declaration"), ("A.java", "A", "type", 5, "A.java", "class_declaration"), ("A.java", "A", "type", 5, "A.java", "class_declaration"),
    ("A.java", "a", "value", 5, "A.java", "variable_declarator"), ("A.java", "count", "member", 5, "A.java", "variable_declarator"), ("A.java", "n", "value", 5, "A.java", "formal_parameter"), ("A.java", "a", "value", 5, "A.java", "variable_declarator"),
    ("A.java", "n", "value", 8, "A.java", "formal_parameter"), ("A.java", "i", "value", 8, "A.java", "variable_declarator"), ("A.java", "n", "value", 8, "A.java", "formal_parameter"), ("A.java", "i", "value", 8, "A.java", "variable_declarator"),
    ("A.java", "count", "value", 8, "A.java", "variable_declarator"), ("A.java", "i", "value", 8, "A.java", "variable_declarator"), ("A.java", "n", "value", 8, "A.java", "formal_parameter"), ("A.java", "n", "value", 8, "A.java", "formal_parameter"),
    ("A.java", "base", "method", 8, "B.java", "method_declaration"), ("A.java", "n", "value", 8, "A.java", "formal_parameter"), ("A.java", "n", "value", 9, "A.java", "formal_parameter"), ("A.java", "count", "value", 9, "A.java", "variable_declarator"),
    ("A.java", "Util", "value", 10, "Util.java", "class_declaration"), ("A.java", "log", "method", 10, "Util.java", "method_declaration"), ("A.java", "count", "value", 10, "A.java", "variable_declarator"), ("A.java", "e", "value", 10, "A.java", "catch_formal_parameter"),
    ("A.java", "count", "member", 11, "A.java", "variable_declarator"), ("A.java", "twice", "method", 13, "A.java", "method_declaration"), ("A.java", "make", "method", 13, "A.java", "method_declaration"), ("A.java", "count", "member", 13, "A.java", "variable_declarator"),
    ("B.java", "n", "value", 2, "B.java", "formal_parameter"), ("B.java", "n", "value", 2, "B.java", "formal_parameter"), ("B.java", "n", "value", 2, "B.java", "formal_parameter"), ("B.java", "n", "value", 2, "B.java", "formal_parameter"),
    ("Util.java", "x", "value", 2, "Util.java", "formal_parameter"), ("Util.java", "x", "value", 2, "Util.java", "formal_parameter"),
]))
def java_references_solved(spark, sf_dir):
    """Uses with what they refer to: scopes, imports, inherited members, members of an expression's type."""
    occ = java_trees(spark).filter(~F.col("root").contains("/test/"))
    found = java_references.solve(occ)
    lines = navigation.line_ranges(occ).select("root", "pre", F.col("first_line").alias("line"))
    kinds = occ.select(F.col("root").alias("declared_root"), F.col("pre").alias("declared"), F.col("type").alias("declared_type"))
    rows = found.join(lines, ["root", "pre"]).join(kinds, ["declared_root", "declared"])
    return rows.select(short(F.col("root")).alias("file"), "name", "use", "line", short(F.col("declared_root")).alias("declared_file"), "declared_type")


@query(expected("term, n, leaf, arguments", [
    ("invocation", 4, "base,log,make,twice", 4), ("constructor_invocation", 1, "", 0), ("scoped", 3, "count,count,count", None), ("this", 1, "this", None), ("primitive", 6, "int,int,int,int,int,void", None),
]))
def java_reference_terms(spark, sf_dir):
    """Kinds of reference terms in a file, their leaves, and how many arguments invocations have."""
    found = java_references.terms(java_trees(spark).filter(F.col("root").endswith("/A.java")))
    rows = found.filter(F.col("term").isin("invocation", "constructor_invocation", "scoped", "this", "primitive")).filter("NOT (term = 'scoped' AND leaf IN ('Util', 'q'))")
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("leaf")), ",").alias("leaf"), F.sum("arguments").alias("arguments"))


@query(expected("kind, name, file, uses", [
    ("field", "count", "A.java", 6), ("method", "twice", "A.java", 1), ("method", "make", "A.java", 1), ("method", "run", "A.java", 0), ("type", "A", "A.java", 3), ("type", "B", "B.java", 1), ("method", "base", "B.java", 1), ("type", "Util", "Util.java", 1), ("method", "log", "Util.java", 1),
]))
def java_reference_counts(spark, sf_dir):
    """How often members and types are referred to, from anywhere in the project."""
    occ = java_trees(spark).filter(~F.col("root").contains("/test/"))
    decls = java_references.declarations(occ).filter("kind <> 'local'")
    solved = java_references.solve(occ).select(F.col("declared_root").alias("root"), "declared")
    counted = references.reference_counts(decls.select("root", F.col("declared").alias("pre"), "name"), solved)
    kinds = decls.select("root", F.col("declared").alias("pre"), "kind")
    return counted.join(kinds, ["root", "pre"]).select("kind", "name", short(F.col("root")).alias("file"), F.col("references").alias("uses"))


@query(expected("smell, n", [
    ("assertion_roulette", 1), ("exception_handling", 1), ("conditional_logic", 1), ("constructor_initialization", 1), ("duplicated_assert", 1), ("empty_test", 1), ("ignored_test", 1), ("magic_number_test", 1),
    ("redundant_assertion", 1), ("redundant_print", 1), ("sensitive_equality", 1), ("sleepy_test", 1),
]))
def java_smells(spark, sf_dir):
    """The smell catalogue on the test class; default_test and mystery_guest find nothing there."""
    occ = java_trees(spark)
    occ = cut(occ.join(metrics.merkle(occ), ["root", "pre"]))
    return smells.find(occ, content="content").groupBy("smell").agg(F.count("*").alias("n"))


@query(expected("path, module, scope", [("core/src/main/java/p/A.java", "core", "main"), ("core/src/main/java/p/B.java", "core", "main"), ("core/src/main/java/q/Util.java", "core", "main"), ("core/src/test/java/p/ATest.java", "core", "test"), ("core/pom.xml", "core", "other"), ("pom.xml", "", "other"), ("native/Makefile", "", "other"), ("native/x.cpp", "", "other")]))
def project_modules(spark, sf_dir):
    """Files with the Maven module they belong to and whether they are main or test sources."""
    return projects.module_of(files(spark), projects.maven_modules(files(spark))).select("path", "module", "scope")


@query(expected("folder, modules, is_module, holds_main, holds_test, holds_modules", [("", "core", True, False, False, True), ("core", "", True, True, True, False)]))
def maven_module_flags(spark, sf_dir):
    found = projects.maven_modules(files(spark))
    return found.select("folder", F.array_join("modules", ",").alias("modules"), "is_module", "holds_main", "holds_test", "holds_modules")


@query(expected("folder, target, prerequisite", [("native", "all", "x.o"), ("native", "all", "y.o"), ("native", "clean", None)]))
def makefile_targets(spark, sf_dir):
    return projects.make_targets(files(spark))


@query(expected("path, lang, new, place", [("core/src/main/java/p/B.java", "java", True, 1), ("core/src/main/java/p/A.java", "java", False, 0)]))
def incremental_files(spark, sf_dir):
    """Contents a store lacks, and places of files in their folder by name."""
    entries, blobs = projects.contents(files(spark))
    known = blobs.filter(F.col("text").contains("class A "))
    fresh = projects.unseen(blobs, known).select("blob", F.lit(True).alias("new"))
    versions = entries.withColumn("version", F.lit("v"))
    at = [projects.child_by_name(versions, "core/src/main/java/p", n) for n in ("A.java", "B.java")]
    rows = reduce(DataFrame.unionByName, at).join(fresh, "blob", "left")
    return rows.select("path", projects.language(F.col("path")).alias("lang"), F.coalesce("new", F.lit(False)).alias("new"), "place")


@query(expected("type, shared, supertypes, is_named", [("if_statement", "branch", "statement", True), ("line_comment", "comment", "", True), ("class_declaration", "type_declaration", "declaration", True), ("identifier", "identifier", "", True), ("{", "other", "", False), ("binary_expression", "other", "expression", True), ("local_variable_declaration", "other", "statement,declaration", True), ("spaces", "other", "", False)]))
def types_dimension(spark, sf_dir):
    """What types are, by rules on their names."""
    wanted = ["if_statement", "line_comment", "class_declaration", "identifier", "{", "binary_expression", "local_variable_declaration", "spaces"]
    return types.dimension(java_trees(spark)).filter(F.col("type").isin(wanted)).select("type", "shared", F.array_join("supertypes", ",").alias("supertypes"), "is_named")


@query(expected("predicate, n", [("is_branch", 8), ("is_comment", 1), ("is_type_decl", 1), ("is_file", 1), ("is_nl", 14)]))
def script_predicates(spark, sf_dir):
    """What scripts ask of nodes, counted in one file."""
    occ = java_trees(spark).filter(F.col("root").endswith("/A.java"))
    names = ["is_branch", "is_comment", "is_type_decl", "is_file", "is_nl"]
    counted = [occ.filter(types.predicate(n)).groupBy().agg(F.count("*").alias("n")).withColumn("predicate", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, counted)


@query(expected("file, declarations", [("A.java", 8), ("B.java", 2), ("Util.java", 2)]))
def declared_nodes(spark, sf_dir):
    occ = types.declarations(java_trees(spark).filter(~F.col("root").contains("/test/"))).filter(F.col("type").rlike("^(class|method|field|package|import)_declaration$|^variable_declarator$") & (F.col("type") != "package_declaration") & (F.col("type") != "import_declaration"))
    return occ.groupBy(short(F.col("root")).alias("file")).agg(F.count("*").alias("declarations"))


@query(expected("file, loc", [("A.java", 13), ("B.java", 2), ("Util.java", 2)]))
def java_lines_of_code(spark, sf_dir):
    """Line breaks, but not the one behind a comment."""
    occ = metrics.loc(java_trees(spark).filter(~F.col("root").contains("/test/")))
    return occ.filter("pre = 0").select(short(F.col("root")).alias("file"), "loc")


# Small labelled trees: published examples of tree differences.

_B = ("0", "b", [("0", "c"), ("0", "d")])
EXAMPLES = {
    "delete": (("0", "a", [("0", "e", [("0", "f")]), _B]), ("0", "a", [("0", "e"), _B])),
    "rename": (("0", "a", [("0", "e", [("0", "f")]), _B]), ("0", "a", [("0", "e", [("0", "g")]), _B])),
    "move": (("0", "a", [("0", "e", [("0", "f")]), _B]), ("0", "a", [("0", "e"), ("0", "b", [("0", "c"), ("0", "f"), ("0", "d")])])),
    "subdelete": (("0", "a", [("0", "e", [("0", "f", [("0", "g")])]), _B]), ("0", "a", [("0", "e"), _B])),
    "zs_paper": (("0", "f", [("0", "d", [("0", "q"), ("0", "c", [("0", "b")])]), ("0", "e")]), ("0", "f", [("0", "c", [("0", "d", [("0", "a"), ("1", "b")])]), ("0", "e")])),
    "gt_java_code": (("0", "a", [("0", "b"), ("0", "c", [("0", "d"), ("0", "e"), ("0", "f"), ("0", "r1")])]), ("0", "z", [("0", "a", [("0", "b"), ("0", "c", [("0", "d"), ("1", "y"), ("0", "f"), ("0", "r2")])])])),
    "gt_slides": (("0", "6", [("0", "5", [("0", "2", [("0", "1")]), ("0", "3"), ("0", "4")])]), ("0", "6", [("0", "2", [("0", "1")]), ("0", "4", [("0", "3")]), ("0", "5")])),
    "gumtree": (("0", "a", [("0", "e", [("0", "f")]), _B, ("0", "g")]), ("0", "z", [_B, ("1", "h", [("0", "e", [("0", "y")])]), ("0", "g")])),
    "gumtree_ambiguous": (("0", "a", [("0", "e", [("0", "f")]), _B, ("0", "g")]), ("0", "z", [_B, ("1", "h", [("0", "e", [("0", "y")])]), ("0", "g"), _B])),
    "bottom_up": (
        ("0", None, [("1", None, [("2", "public"), ("3", "foo"), ("4", None, [("5", f"s{i}") for i in range(1, 5)])])]),
        ("0", None, [("1", None, [("2", "private"), ("3", "bar"), ("4", None, [("5", f"s{i}") for i in range(1, 6)])])]),
    ),
}


def examples(spark) -> tuple[DataFrame, DataFrame]:
    """(pairs, occ) of EXAMPLES."""
    rows = []
    for name, sides in EXAMPLES.items():
        for side, spec in zip(("src", "dst"), sides):
            t = diff.Tree.nested(spec)
            depth: list[int] = []
            for i, p in enumerate(t.parent):
                depth.append(0 if p is None else depth[p] + 1)
                rows.append((f"{name}/{side}", i, p, 0 if p is None else t.children[p].index(i), depth[i], t.size[i], t.height[i], t.type[i], t.label[i]))
    occ = spark.createDataFrame(rows, "root string, pre long, parent long, pos int, depth int, size long, height int, type string, label string")
    pairs = spark.createDataFrame([(n, f"{n}/src", f"{n}/dst") for n in EXAMPLES], "pair string, src_root string, dst_root string")
    return pairs, occ


@query(expected("example, algorithm, inserts, updates, moves, deletes", [
    ("delete", "simple", 0, 0, 0, 1), ("rename", "simple", 0, 1, 0, 0), ("move", "zs", 1, 0, 0, 1), ("subdelete", "simple", 0, 0, 0, 2),
    ("delete", "zs", 0, 0, 0, 1), ("rename", "zs", 0, 1, 0, 0), ("subdelete", "zs", 0, 0, 0, 2),
    ("delete", "greedy", 0, 0, 0, 1), ("rename", "greedy", 0, 1, 0, 0), ("subdelete", "greedy", 0, 0, 0, 2),
]))
def example_scripts(spark, sf_dir):
    """Edit scripts of small examples whose least scripts are plain: one rename, one or two deletions; optimal mapping has no moves."""
    pairs, occ = examples(spark)
    wanted = pairs.filter(F.col("pair").isin("delete", "rename", "subdelete"))
    runs = [("simple", wanted), ("greedy", wanted), ("zs", pairs.filter(F.col("pair").isin("delete", "rename", "subdelete", "move")))]
    parts = [diff.diff_pairs(p, occ, a).withColumn("algorithm", F.lit(a)) for a, p in runs]
    return reduce(DataFrame.unionByName, parts).select(F.col("pair").alias("example"), "algorithm", "inserts", "updates", "moves", "deletes")


@query(expected("example, algorithm, links", [
    ("gt_java_code", "zs", 6), ("gt_slides", "zs", 5),
    ("gumtree", "subtree", 3), ("gumtree_ambiguous", "subtree", 3), ("bottom_up", "subtree", 0),
]))
def example_links(spark, sf_dir):
    """Numbers of links: published counts of optimal mappings and of equal subtrees from height one."""
    pairs, occ = examples(spark)
    pick = lambda *names: pairs.filter(F.col("pair").isin(*names))
    parts = [diff.diff_pairs(pick("gt_java_code", "gt_slides"), occ, "zs").withColumn("algorithm", F.lit("zs")), diff.diff_pairs(pick("gumtree", "gumtree_ambiguous", "bottom_up"), occ, "subtree").withColumn("algorithm", F.lit("subtree"))]
    return reduce(DataFrame.unionByName, parts).select(F.col("pair").alias("example"), "algorithm", "links")


@query(expected("example, algorithm, same", [(e, a, True) for e in EXAMPLES for a in diff.ALGORITHMS]))
def example_scripts_apply(spark, sf_dir):
    """Whatever algorithm links two trees, the script turns one into the other."""
    pairs, occ = examples(spark)
    parts = [diff.verified(pairs, occ, a).withColumn("algorithm", F.lit(a)) for a in diff.ALGORITHMS]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("pair", "example")


@query(expected("src, dst, src_node, dst_node, same", [
    (0, 1, "0 a", "0 a", True), (1, 2, "0 b", "0 b", True), (2, 3, "0 c", "0 c", True), (3, 4, "0 d", "0 d", True), (5, 6, "0 f", "0 f", True), (6, 7, "0 r1", "0 r2", False),
    (4, None, "0 e", None, False), (None, 0, None, "0 z", False), (None, 5, None, "1 y", False),
]))
def example_mapping_view(spark, sf_dir):
    """The published optimal mapping of one example, with both ends of each link and the nodes without one."""
    pairs, occ = examples(spark)
    pairs = pairs.filter("pair = 'gt_java_code'")
    return diff.mapping_view(pairs, diff.mappings(pairs, occ, "zs"), occ).drop("pair")


@query(expected("kind, n", [("update", 1), ("delete", 1), ("insert", 2)]))
def example_action_summary(spark, sf_dir):
    """Actions by kind for the same example under the optimal mapping: r1 becomes r2, e goes, z and y come."""
    pairs, occ = examples(spark)
    return diff.summary(diff.actions(pairs.filter("pair = 'gt_java_code'"), occ, "zs")).filter("kind <> 'move'").select("kind", "n")


@query(expected("pair, same, missing, additional", [("gumtree", 3, 0, 2), ("gumtree_ambiguous", 3, 0, 2)]))
def example_mapping_comparison(spark, sf_dir):
    """Links of equal subtrees held against those and two more."""
    pairs, occ = examples(spark)
    pairs = pairs.filter("pair LIKE 'gumtree%'")
    found = diff.mappings(pairs, occ, "subtree")
    more = pairs.select("pair", F.explode(F.array(F.lit(100), F.lit(101)).cast("array<long>")).alias("src"), F.lit(7).cast("long").alias("dst"))
    return diff.compare_mappings(found.unionByName(more), found)


@query(expected("pair, side, nodes", [("gumtree", "src", 4), ("gumtree", "dst", 5), ("bottom_up", "src", 9), ("bottom_up", "dst", 10), ("gumtree_ambiguous", "src", 7), ("gumtree_ambiguous", "dst", 11)]))
def example_open_nodes(spark, sf_dir):
    """What unique equal subtrees leave to later phases: all but b with its two leaves, which the ambiguous example has twice."""
    pairs, occ = examples(spark)
    pairs = pairs.filter("pair IN ('gumtree', 'gumtree_ambiguous', 'bottom_up')")
    hashed = cut(occ.join(metrics.merkle(occ), ["root", "pre"]))
    return diff.open_nodes(pairs, hashed).groupBy("pair", "side").agg(F.count("*").alias("nodes"))


VERSIONS = [
    ("v0", "class A { int f(int x) { return x; } void g() { f(1); } }"),
    ("v1", "class A { int f(int x) { return x; } void g() { f(2); } }"),
    ("v2", "class A { int f(int x) { return x + 1; } void g() { f(2); } }"),
]


@query(expected("watch, last_root, steps, status, changed", [
    ("", "v2", 2, "last", ""), ("top,meth,typ", "v1", 1, "changed", "top,typ"), ("child,sim_child,sim_parent", "v2", 2, "changed", "child,sim_child,sim_parent"),
    ("parent,file", "v1", 1, "changed", "parent,file"), ("upd,exact_child,exact_parent,pack,dependency,references,declaration,dependent", "v2", 2, "last", ""),
]))
def tracked_method(spark, sf_dir):
    """The method f followed through three versions of a class, for several things to watch."""
    occ = tracking.hashed(parse(spark.createDataFrame(VERSIONS, "k string, text string"), "k", "text", "java"))
    versions = spark.createDataFrame([("c", i, v) for i, (v, _) in enumerate(VERSIONS)], "chain string, rank int, root string")
    links = tracking.link_trees(tracking.successive(versions), occ, "greedy")
    solved = cut(java_references.solve(occ).select("root", "pre", "declared_root", "declared"))
    named = occ.filter("root = 'v0' AND label = 'f' AND role = 'name'").select("root", F.col("parent").alias("pre"))
    method = cut(named.join(occ.filter("type = 'method_declaration'"), ["root", "pre"]).select(F.lit(1).alias("element"), "root", "pre"))
    out = []
    for watch in ("", "top,meth,typ", "child,sim_child,sim_parent", "parent,file", "upd,exact_child,exact_parent,pack,dependency,references,declaration,dependent"):
        flags = watch.split(",") if watch else []
        found = tracking.track(method, versions, links, occ, flags, solved)
        out.append(found.select(F.lit(watch).alias("watch"), "last_root", "steps", "status", F.array_join("changed", ",").alias("changed")))
    return reduce(DataFrame.unionByName, out)
