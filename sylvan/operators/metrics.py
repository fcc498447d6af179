"""Metrics of subtrees.

Sums over descendants need no recursion: with nodes in pre-order, the sum over a subtree is
a difference of two running sums. Metrics that aren't sums go up level by level.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut

#: Node types that fork control flow and those that keep a complexity: fixed values.
FORKS = ["ternary_expression", "if_statement", "for_statement", "enhanced_for_statement", "while_statement", "catch_clause", "switch_label", "try_statement", "try_with_resources_statement", "do_statement"]
MEASURED = ["program", "class_declaration", "interface_declaration", "enum_declaration", "record_declaration", "method_declaration"]
COMMENTS = ["comment", "line_comment", "block_comment"]
#: Levels after which values still waiting for their parents are gathered.
COMPACT = 8


def subtree_sums(occ: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its value over each node and all below it. One window, one join by tree."""
    run = Window.partitionBy("root").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    own, upto, to = (lambda n: f"__own_{n}"), (lambda n: f"__run_{n}"), (lambda n: f"__to_{n}")
    rows = occ.withColumns({own(n): v for n, v in values.items()}).withColumns({upto(n): F.sum(own(n)).over(run) for n in values})
    ends = rows.select("root", F.col("pre").alias("__end"), *(F.col(upto(n)).alias(to(n)) for n in values))
    joined = rows.withColumn("__end", F.col("pre") + F.col("size") - 1).join(ends, ["root", "__end"])
    summed = joined.withColumns({n: F.col(to(n)) - F.col(upto(n)) + F.col(own(n)) for n in values})
    return summed.drop("__end", *(f(n) for n in values for f in (own, upto, to)))


def subtree_sum(occ: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over each node and all below it."""
    return subtree_sums(occ, {name: value})


def size_no_spaces(occ: DataFrame) -> DataFrame:
    """Adds size_no_spaces: nodes of the subtree that aren't white space."""
    return subtree_sum(occ, F.when(F.col("type") == "spaces", 0).otherwise(1), "size_no_spaces")


def mcc(occ: DataFrame, forks: list[str] = FORKS) -> DataFrame:
    """Adds mcc: forks in the subtree plus one (McCabe)."""
    return subtree_sum(occ, F.when(F.col("type").isin(forks), 1).otherwise(0), "mcc").withColumn("mcc", F.col("mcc") + 1)


#: What JaCoCo counts beside forks, and what it doesn't: fixed values.
SHORT_CIRCUIT, NOT_BRANCHES = ["&&", "||"], ["try_statement", "try_with_resources_statement", "catch_clause"]


def mcc_jacoco(occ: DataFrame) -> DataFrame:
    """Adds mcc: branches as JaCoCo counts them, with short-circuit operators and without handlers, plus one."""
    return mcc(occ, [f for f in FORKS if f not in NOT_BRANCHES] + SHORT_CIRCUIT)


def bytes_len(occ: DataFrame) -> DataFrame:
    """Adds bytes_len: UTF-8 length of the subtree's text, from its leaves."""
    return subtree_sum(occ, F.when(F.col("size") == 1, F.octet_length(F.coalesce("label", F.lit("")))).otherwise(0), "bytes_len")


def line_count(occ: DataFrame) -> DataFrame:
    """Adds line_count: line breaks in the subtree. Not saturated."""
    breaks = F.length(F.regexp_replace(F.coalesce("label", F.lit("")), "[^\n]", ""))
    return subtree_sum(occ, F.when(F.col("size") == 1, breaks).otherwise(0), "line_count")


def loc(occ: DataFrame) -> DataFrame:
    """Adds loc: white-space nodes with a line break, but for those right after a comment.

    A comment and the sibling right after it count nothing, with all below them.
    """
    siblings = Window.partitionBy("root", "parent").orderBy("pos")
    comment = F.col("type").isin(COMMENTS)
    muted = occ.withColumn("__mute", comment | F.coalesce(F.lag(comment).over(siblings), F.lit(False)))
    # Intervals nest: whatever began earlier and ends later is an ancestor.
    before = Window.partitionBy("root").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("__mute"), F.col("pre") + F.col("size"))).over(before) > F.col("pre"), F.lit(False))
    rows = muted.withColumn("__under", covered)
    counts = (F.col("type") == "spaces") & F.col("label").contains("\n") & ~F.col("__mute") & ~F.col("__under")
    return subtree_sum(rows, F.when(counts, 1).otherwise(0), "loc").drop("__mute", "__under")


def counts_below(occ: DataFrame) -> DataFrame:
    """Adds statements, member_imports and leaves: how many of each lie in the subtree. Not saturated."""
    count = lambda condition: F.when(condition, 1).otherwise(0)
    kind = F.col("type")
    return subtree_sums(occ, {"statements": count(kind.rlike("_statement$|^local_variable_declaration$")), "member_imports": count(kind == "import_declaration"), "leaves": count(F.col("size") == 1)})


@dataclass(frozen=True)
class MetricSpec:
    """A bottom-up metric: init on each node, acc over its children's values, finish of both.

    init: Column of the node. acc: aggregate Column over the children's `value` (ordered by
    pos if needed). finish: (own, accumulated) -> Column; accumulated is null on leaves.
    """

    init: Column
    acc: Column
    finish: Callable[[Column, Column], Column]

    @classmethod
    def of(cls, init: str, acc: str, finish: str) -> MetricSpec:
        """From SQL texts: init over a node's columns, acc an aggregate of `value`, finish of `own` and `acc` (null on leaves)."""
        named = re.sub(r"\b(own|acc)\b", r"__\1", finish)
        return cls(F.expr(init), F.expr(acc), lambda own, acc: F.expr(named))


def bottom_up(occ: DataFrame, spec: MetricSpec, name: str, levels: int | None = None) -> DataFrame:
    """(root, pre, name): the metric of every node, one grouped join for each level of height.

    levels is the greatest height; it is looked up if not given. Each node knows the height
    of its parent, so a level reads just the values it needs, and values are written once
    (and, while their parents are far up, again every COMPACT levels).
    """
    plain = occ.select("root", "pre", "parent", "pos", "height", spec.init.alias("__own"))
    tall = plain.filter("height > 0").select("root", F.col("pre").alias("parent"), F.col("height").alias("__up"))
    rows = cut(plain.join(tall, ["root", "parent"], "left"))
    if levels is None:
        levels = rows.agg(F.max("height")).first()[0] or 0
    columns = ["root", "parent", "pre", "pos", "__up", "value"]
    leaves = rows.filter("height = 0").withColumn("__acc", F.lit(None)).withColumn("value", spec.finish(F.col("__own"), F.col("__acc"))).select(*columns)
    done, pending = [leaves], [leaves]
    for h in range(1, levels + 1):
        below = reduce(DataFrame.unionByName, (p.filter(F.col("__up") == h) for p in pending))
        up = below.groupBy("root", F.col("parent").alias("pre")).agg(spec.acc.alias("__acc"))
        new = rows.filter(F.col("height") == h).join(up, ["root", "pre"]).withColumn("value", spec.finish(F.col("__own"), F.col("__acc"))).select(*columns)
        new = cut(new) if h < levels else new
        done.append(new)
        pending.append(new)
        if h % COMPACT == 0 and h < levels:
            pending = [cut(reduce(DataFrame.unionByName, (p.filter(F.col("__up") > h) for p in pending)))]
    return reduce(DataFrame.unionByName, done).select("root", "pre", F.col("value").alias(name))


def top_down(occ: DataFrame, start: Column, step: Callable[[Column], Column], name: str, keep: Column | None = None, levels: int | None = None) -> DataFrame:
    """(root, pre, name): a state handed down, start at roots and step(parent's state) below.

    Nodes for which keep doesn't hold are left out with all below them. One join for each
    level of depth; levels is the greatest depth, looked up if not given. With bottom_up on
    what is left, this is a fold with a filter on the way down.
    """
    rows = cut(occ if keep is None else occ.filter(F.coalesce(keep, F.lit(False))))
    if levels is None:
        levels = rows.agg(F.max("depth")).first()[0] or 0
    level = rows.filter("depth = 0").select("root", "pre", start.alias("__state"))
    out = level
    for d in range(1, levels + 1):
        above = level.select("root", F.col("pre").alias("parent"), F.col("__state").alias("__above"))
        level = cut(rows.filter(F.col("depth") == d).join(above, ["root", "parent"]).select("root", "pre", step(F.col("__above")).alias("__state")))
        out = out.unionByName(level)
    return out.withColumnRenamed("__state", name)


def merkle(occ: DataFrame, name: str = "content", labels: bool = True, levels: int | None = None) -> DataFrame:
    """(root, pre, name): hash of type, label and ordered children; equal hashes, equal subtrees.

    labels=False gives the structural hash. Unlike a sum of child hashes it tells orders apart.
    """
    own = F.concat_ws("\x1f", "type", F.coalesce("label", F.lit("\x00")) if labels else F.lit(""))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value), "\x1e")
    return bottom_up(occ, MetricSpec(own, ordered, lambda o, a: F.sha2(F.concat_ws("\x1d", o, a), 256)), name, levels)


def precomputed_bits(occ: DataFrame, conditions: list[Column]) -> DataFrame:
    """Adds bits: bit i is set if condition i holds for a node of the subtree."""
    out = subtree_sums(occ, {f"__b{i}": F.when(c, 1).otherwise(0) for i, c in enumerate(conditions)})
    bits = sum((F.when(F.col(f"__b{i}") > 0, 1 << i).otherwise(0) for i in range(len(conditions))), F.lit(0))
    return out.withColumn("bits", bits).drop(*(f"__b{i}" for i in range(len(conditions))))


def store_statistics(occ: DataFrame, hashes: DataFrame, content: str = "content") -> DataFrame:
    """(height, nodes, distinct_nodes): how much deduplication saves at each height."""
    return occ.join(hashes, ["root", "pre"]).groupBy("height").agg(F.count("*").alias("nodes"), F.countDistinct(content).alias("distinct_nodes"))


def path_totals(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """Totals on every level of a path (module, folder, file): a rollup."""
    return df.rollup(*path).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def bag_hash(occ: DataFrame, name: str = "bag", labels: bool = True, levels: int | None = None) -> DataFrame:
    """(root, pre, name): a 32-bit hash in which the order of children doesn't count: their hashes are added."""
    own = F.xxhash64("type", F.coalesce("label", F.lit("\x00")) if labels else F.lit(""))
    added = F.pmod(F.sum("value"), F.lit(2**32)).cast("long")
    return bottom_up(occ, MetricSpec(own, added, lambda o, a: F.pmod(F.xxhash64(o, F.coalesce(a, F.lit(0).cast("long"))), F.lit(2**32))), name, levels)
