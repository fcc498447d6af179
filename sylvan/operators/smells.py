"""The test-smell catalogue and demonstration queries, for Java trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators import patterns


def test_method(body: str, marks: str = '(marker_annotation name: (_) (#EQ? "Test"))') -> str:
    """A method marked as a test, with a body."""
    return f"(method_declaration (modifiers {marks}) name: (_) body: (_ {body})) @root"


def call(name: str, rest: str = "", before: str = "") -> str:
    """A statement that calls a method by name."""
    return f'(expression_statement (method_invocation {before} name: (identifier) (#EQ? "{name}") {rest}))'


NUMBER = "[(decimal_integer_literal) (hex_integer_literal) (octal_integer_literal) (binary_integer_literal) (decimal_floating_point_literal)]"
#: Names that the smells look for: fixed values.
ASSERTS = ("assertThat", "assertSame", "assertEquals")
#: What each smell looks for; of several patterns any one counts.
SMELLS = {
    "assertion_roulette": test_method(f"{call('assertThat')} . {call('assertThat')}"),
    "exception_handling": f"(try_statement (block {call('fail')}) (catch_clause))",
    "conditional_logic": "\n".join(f"(if_statement consequence: (_ {call(a)}) !alternative)" for a in ASSERTS),
    "empty_test": test_method('"{" . "}"'),
    "constructor_initialization": f"(class_declaration body: (_ (constructor_declaration) {test_method('')}))",
    "default_test": "\n".join(f'(class_declaration name: (_) (#EQ? "{n}") body: (_ {test_method("")}))' for n in ("ExampleUnitTest", "ExampleInstrumentedTest")),
    "duplicated_assert": test_method(f"{call('assertThat')} @first {call('assertThat')} @second (#eq? @first @second)"),
    "ignored_test": test_method("", '(marker_annotation name: (_) (#EQ? "Ignored")) (marker_annotation name: (_) (#EQ? "Test"))'),
    "magic_number_test": test_method(call("assertThat", f"(argument_list {NUMBER})")),
    "mystery_guest": test_method('(expression_statement (assignment_expression right: (method_invocation object: (identifier) (#EQ? "File") name: (identifier) (#EQ? "createTempFile"))))'),
    "redundant_print": test_method(call("println")),
    "redundant_assertion": test_method(call("assertThat", "(argument_list (_) @a (_) @b (#eq? @a @b))")),
    "sensitive_equality": test_method(call("assertEquals", '(argument_list (method_invocation name: (identifier) (#EQ? "toString")))')),
    "sleepy_test": test_method(call("sleep", before='object: (identifier) (#EQ? "Thread")')),
}
#: Demonstration queries.
DEMOS = {
    "class_declarations": "(class_declaration)",
    "public_subclasses_that_begin_with_a_method": '(class_declaration (modifiers "public") superclass: (_) interfaces: (_) body: (class_body . (method_declaration)))',
    "tested_classes": '(program (package_declaration (_) @pkg) (class_declaration (modifiers "public") name: (_) @name body: (_ (method_declaration (modifiers (marker_annotation name: (_) @mark)) name: (_) @meth))) (#any-eq? @mark "Test"))',
}


def find(occ: DataFrame, names: list[str] | None = None, content: str | None = None) -> DataFrame:
    """(smell, root, at): the smells in all trees, each place once.

    With content hashes (see metrics.merkle) two assertions are duplicates if their subtrees
    are equal; without them by their texts, which nodes with children lack.
    """
    out = None
    for name in names or sorted(SMELLS):
        found = patterns.matches(occ, SMELLS[name], content=content).select(F.lit(name).alias("smell"), "root", "at").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def removed(found: DataFrame, versions: DataFrame, occ: DataFrame, content: str = "content") -> DataFrame:
    """(chain, rank, smell, root, at, fate): smells that a version has and the next doesn't at equal content.

    found(smell, root, at); versions(chain, rank, root); occ with content hashes. fate: gone
    where the next version has no match of that smell with equal content, and moved where it
    has fewer of them than this one.
    """
    hashed = found.join(occ.select("root", F.col("pre").cast("long").alias("at"), content), ["root", "at"])
    here = versions.join(hashed, "root")
    nxt = here.groupBy("chain", (F.col("rank") - 1).alias("rank"), "smell", content).agg(F.count("*").alias("__next"))
    last = versions.groupBy("chain").agg(F.max("rank").alias("__last"))
    counted = here.join(here.groupBy("chain", "rank", "smell", content).agg(F.count("*").alias("__here")), ["chain", "rank", "smell", content])
    both = counted.join(last, "chain").filter(F.col("rank") < F.col("__last")).join(nxt, ["chain", "rank", "smell", content], "left")
    fate = F.when(F.col("__next").isNull(), "gone").when(F.col("__next") < F.col("__here"), "moved")
    return both.withColumn("fate", fate).filter("fate IS NOT NULL").select("chain", "rank", "smell", "root", "at", "fate")
