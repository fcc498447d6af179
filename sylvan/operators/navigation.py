"""Moving about in trees: joins and windows on occurrences (see sources.trees)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut
from sylvan.operators.metrics import subtree_sum, top_down


def children(occ: DataFrame) -> DataFrame:
    """(root, pre, child, pos, role): edges of all trees."""
    return occ.filter(F.col("parent").isNotNull()).select("root", F.col("parent").alias("pre"), F.col("pre").alias("child"), "pos", "role")


def child_at(occ: DataFrame, i: int) -> DataFrame:
    """The i-th child of each node; negative i counts from the last, -1."""
    kids = children(occ)
    if i >= 0:
        return kids.filter(F.col("pos") == i)
    last = Window.partitionBy("root", "pre").orderBy(F.desc("pos"))
    return kids.withColumn("back", F.row_number().over(last)).filter(F.col("back") == -i).drop("back")


def child_counts(occ: DataFrame) -> DataFrame:
    """(root, pre, children) of inner nodes."""
    return children(occ).groupBy("root", "pre").agg(F.count("*").alias("children"))


def child_by_role(occ: DataFrame, role: str) -> DataFrame:
    """(root, pre, child): children that play a role."""
    return children(occ).filter(F.col("role") == role).select("root", "pre", "child")


def has_child_with_role(occ: DataFrame, role: str) -> DataFrame:
    """Nodes with such a child: a semi join."""
    return occ.join(child_by_role(occ, role).select("root", "pre"), ["root", "pre"], "left_semi")


def within(ancestor: str, descendant: str) -> Column:
    """Join condition: descendant lies strictly below ancestor in the same tree."""
    a, d = F.col, F.col
    return (a(f"{ancestor}.root") == d(f"{descendant}.root")) & (d(f"{descendant}.pre") > a(f"{ancestor}.pre")) & (d(f"{descendant}.pre") < a(f"{ancestor}.pre") + a(f"{ancestor}.size"))


def ancestors(occ: DataFrame, of: DataFrame) -> DataFrame:
    """(root, pre, ancestor, ancestor_type, up): for nodes of(root, pre); up = levels above.

    Climbs from node to parent, an equi-join for each level: work is that of the result.
    """
    edges = cut(occ.select("root", "pre", "parent", "type", "depth"))
    now = of.select("root", "pre").distinct().join(edges, ["root", "pre"]).select("root", "pre", F.col("parent").alias("ancestor"), "depth")
    levels = now.agg(F.max("depth")).first()[0] or 0
    parent = edges.select("root", F.col("pre").alias("ancestor"), F.col("type").alias("ancestor_type"), F.col("parent").alias("__next"))
    out = None
    for up in range(1, levels + 1):
        level = now.filter("ancestor IS NOT NULL").join(parent, ["root", "ancestor"])
        level = cut(level) if up < levels and up % 4 == 0 else level
        rows = level.select("root", "pre", "ancestor", "ancestor_type", F.lit(up).alias("up"))
        out = rows if out is None else out.unionByName(rows)
        now = level.select("root", "pre", F.col("__next").alias("ancestor"), "depth")
    return out if out is not None else now.select("root", "pre", "ancestor", F.lit("").alias("ancestor_type"), F.lit(0).alias("up")).limit(0)


def descendants(occ: DataFrame, of: DataFrame) -> DataFrame:
    """(root, pre, descendant, type): of nodes of(root, pre).

    Climbs from all nodes of these trees and keeps the wanted ancestors, so a large tree
    costs its nodes times their depth.
    """
    wanted = of.select("root", "pre").distinct()
    mine = occ.join(wanted.select("root").distinct(), "root", "left_semi")
    pairs = ancestors(mine, mine).select("root", F.col("ancestor").alias("pre"), F.col("pre").alias("descendant"))
    found = pairs.join(wanted, ["root", "pre"], "left_semi")
    return found.join(occ.select("root", F.col("pre").alias("descendant"), "type"), ["root", "descendant"]).select("root", "pre", "descendant", "type")


def descendant_count(occ: DataFrame) -> DataFrame:
    """(root, pre, descendants): from the intervals alone, without a join."""
    return occ.select("root", "pre", (F.col("size") - 1).alias("descendants"))


def leftmost_leaf(occ: DataFrame) -> DataFrame:
    """Adds lld: the post-order number of the left-most leaf below each node."""
    return occ.withColumn("lld", F.col("post") - F.col("size") + 1)


def key_roots(occ: DataFrame) -> DataFrame:
    """(root, lld, post): the highest node for each left-most leaf."""
    return leftmost_leaf(occ).groupBy("root", "lld").agg(F.max("post").alias("post"))


def breadth_first(occ: DataFrame) -> DataFrame:
    """Adds bfs: the breadth-first number of each node in its tree."""
    return occ.withColumn("bfs", F.row_number().over(Window.partitionBy("root").orderBy("depth", "pre")) - 1)


def paths(occ: DataFrame) -> DataFrame:
    """(root, pre, path): child numbers from the root down to each node, handed down level by level."""
    return top_down(occ, F.array().cast("array<int>"), lambda above: F.array_append(above, F.col("pos").cast("int")), "path")


def packed_path(path: Column) -> Column:
    """A path as text, two hex digits a step below 255; longer steps follow an ff in eight digits."""
    step = lambda x: F.when(x < 255, F.lpad(F.hex(x), 2, "0")).otherwise(F.concat(F.lit("FF"), F.lpad(F.hex(x), 8, "0")))
    return F.array_join(F.transform(path, step), "")


def unpacked_path(text: Column) -> Column:
    """The path that packed_path() wrote."""
    steps = F.regexp_extract_all(text, F.lit("FF[0-9A-F]{8}|[0-9A-E][0-9A-F]|F[0-9A-E]"), F.lit(0))
    return F.transform(steps, lambda x: F.conv(F.when(F.length(x) > 2, F.substring(x, 3, 8)).otherwise(x), 16, 10).cast("int"))


def node_at_range(occ: DataFrame, ranges: DataFrame) -> DataFrame:
    """The deepest node that covers each range of ranges(root, range_start, range_end)."""
    hit = occ.join(ranges, "root").filter((F.col("start") <= F.col("range_start")) & (F.col("end") >= F.col("range_end")))
    deepest = Window.partitionBy("root", "range_start", "range_end").orderBy(F.desc("depth"), "pre")
    return hit.withColumn("r", F.row_number().over(deepest)).filter("r = 1").drop("r")


def line_ranges(occ: DataFrame) -> DataFrame:
    """(root, pre, first_line, last_line), from 1: line breaks in leaves before and inside."""
    breaks = F.when(F.col("size") == 1, F.length(F.regexp_replace(F.coalesce("label", F.lit("")), "[^\n]", ""))).otherwise(0)
    run = Window.partitionBy("root").orderBy("pre")
    rows = occ.withColumn("breaks", breaks).withColumn("before", F.coalesce(F.sum("breaks").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = rows.select("root", F.col("pre").alias("end_pre"), (F.col("before") + F.col("breaks")).alias("after"))
    joined = rows.withColumn("end_pre", F.col("pre") + F.col("size") - 1).join(last, ["root", "end_pre"])
    return joined.select("root", "pre", (F.col("before") + 1).alias("first_line"), (F.col("after") + 1).alias("last_line"))


def without_spaces(occ: DataFrame) -> DataFrame:
    """The no-space view: white-space nodes left out, siblings and orders numbered anew.

    Adds pos_with_spaces, so that paths convert either way by a projection.
    """
    order = Window.partitionBy("root").orderBy("pre")
    counted = subtree_sum(occ, F.when(F.col("type") == "spaces", 1).otherwise(0), "__gaps")
    ranked = counted.filter(F.col("type") != "spaces").withColumn("size", F.col("size") - F.col("__gaps")).drop("__gaps")
    ranked = ranked.withColumn("new", F.row_number().over(order) - 1)
    ranked = ranked.withColumnRenamed("pos", "pos_with_spaces").withColumn("pos", F.row_number().over(Window.partitionBy("root", "parent").orderBy("pos_with_spaces")) - 1)
    up = ranked.select("root", F.col("pre").alias("parent"), F.col("new").alias("new_parent"))
    out = ranked.join(up, ["root", "parent"], "left").withColumn("pre", F.col("new")).withColumn("parent", F.col("new_parent")).drop("new", "new_parent")
    return out.withColumn("post", F.col("pre") + F.col("size") - 1 - F.col("depth"))


def hide(occ: DataFrame, hidden: DataFrame) -> DataFrame:
    """Leaves nodes of hidden(root, pre) out of the view (an anti join), numbering the rest anew as `rank`."""
    rest = occ.join(hidden.select("root", "pre"), ["root", "pre"], "left_anti")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("pre")) - 1)


def enclosing(occ: DataFrame, of: DataFrame, types: list[str]) -> DataFrame:
    """(root, pre, ancestor): the nearest ancestor of one of the types, for nodes of(root, pre)."""
    held = F.struct(F.when(F.col("type").isin(types), F.col("pre")).alias("own"), F.lit(None).cast("long").alias("above"))
    handed = top_down(occ, held, lambda s: F.struct(F.when(F.col("type").isin(types), F.col("pre")).alias("own"), F.coalesce(s.own, s.above).cast("long").alias("above")), "__s")
    return handed.join(of.select("root", "pre").distinct(), ["root", "pre"], "left_semi").select("root", "pre", F.col("__s.above").alias("ancestor")).filter("ancestor IS NOT NULL")


def sibling_neighbours(occ: DataFrame) -> DataFrame:
    """(root, pre, previous, next): the siblings beside each node, null at either end."""
    siblings = Window.partitionBy("root", "parent").orderBy("pos")
    return occ.select("root", "pre", F.lag("pre").over(siblings).alias("previous"), F.lead("pre").over(siblings).alias("next"))


def text_positions(occ: DataFrame) -> DataFrame:
    """(root, pre, first_char, past_char): where each node's text lies in the text of its tree.

    A node's text is that of the leaves below it; one running sum over the leaves gives both ends.
    """
    here = F.when(F.col("size") == 1, F.length(F.coalesce("label", F.lit("")))).otherwise(0)
    run = Window.partitionBy("root").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    rows = occ.select("root", "pre", (F.col("pre") + F.col("size") - 1).alias("end_pre"), here.alias("chars")).withColumn("past_char", F.sum("chars").over(run))
    ends = rows.select("root", F.col("pre").alias("end_pre"), "past_char")
    return rows.withColumn("first_char", F.col("past_char") - F.col("chars")).drop("past_char").join(ends, ["root", "end_pre"]).select("root", "pre", "first_char", "past_char")


def positions(occ: DataFrame) -> DataFrame:
    """(root, pre, post, bfs, path, first_char, past_char): every way to say where a node is, to convert between."""
    order = breadth_first(occ).select("root", "pre", "post", "bfs")
    return order.join(paths(occ), ["root", "pre"]).join(text_positions(occ), ["root", "pre"])


def shared_path(a: Column, b: Column) -> Column:
    """The path of the lowest node above two paths."""
    from sylvan.functions.scalars import common_prefix

    return common_prefix(a, b)
