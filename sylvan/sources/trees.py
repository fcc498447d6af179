"""Trees as a relation of occurrences.

One row for each node of each tree, with interval encoding: a node's descendants are the
rows of the same root whose `pre` lies in (pre, pre + size).

Columns: root, pre, parent (pre of it, null at the root), pos (place among siblings), depth,
size, post, height, type, label, role, start, end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut
from sylvan.sources.measures import OWN, measure
from sylvan.sources.parsers import FRONT_ENDS

OCC = "pre int, parent int, pos int, depth int, size int, post int, height int, type string, label string, role string, start int, end int"


def encode(nodes) -> list[list]:
    """Rows of OCC from pre-order nodes (depth, type, label, role, start, end)."""
    rows, open_, children = [], [], []  # children: how many each open node has so far
    nodes = list(nodes)
    last = len(nodes) - 1

    def close():
        row = rows[open_.pop()]
        children.pop()
        row[4] = len(rows) - row[0]
        row[5] = len(rows) - 1 - len(open_)
        if open_:
            parent = rows[open_[-1]]
            parent[6] = max(parent[6], row[6] + 1)

    parent, above = None, -1  # the innermost open node and its depth
    for i, (depth, kind, label, role, start, end) in enumerate(nodes):
        while above >= depth:
            close()
            parent = open_[-1] if open_ else None
            above = rows[parent][3] if open_ else -1
        pos = 0
        if open_:
            pos = children[-1]
            children[-1] += 1
        if i == last or nodes[i + 1][0] <= depth:  # a leaf
            rows.append([i, parent, pos, depth, 1, i - len(open_), 0, kind, label, role, start, end])
            if open_ and not rows[parent][6]:
                rows[parent][6] = 1
        else:
            rows.append([i, parent, pos, depth, 1, 0, 0, kind, label, role, start, end])
            open_.append(i)
            children.append(0)
            parent, above = i, depth
    while open_:
        close()
    return rows


#: Texts a worker takes at a time, and nodes it hands on at a time: what it holds besides one tree.
TEXTS, NODES = 64, 20_000


def pieces(batches, of_row, names: list[str], types: list[str]):
    """Record batches of what of_row(values) yields for each row of some batches: NODES rows at most in one."""
    import pyarrow as pa

    known = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    for batch in batches:
        kinds, rows = [batch.schema.field(0).type, *(known[t] for t in types)], []

        def frames(rows, kinds=kinds):
            for i in range(0, len(rows), NODES):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + NODES]), kinds)], names)

        for at in range(0, batch.num_rows, TEXTS):
            for values in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS).columns)):
                rows += of_row(*values)
                if len(rows) >= NODES:
                    yield from frames(rows)
                    rows = []
        yield from frames(rows)


def per_text(df: DataFrame, columns: list[str], of_row, schema: str) -> DataFrame:
    """(root, ...): rows that of_row(values of columns) yields as lists, for each row of df; schema is theirs without root.

    A worker holds few texts and NODES rows of results at once, however long a batch is.
    """
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kind = df.schema[columns[0]].dataType.simpleString()
    return df.select(*columns).mapInArrow(lambda batches: pieces(batches, of_row, ["root", *names], list(types)), f"root {kind}, {schema}")


def parse(df: DataFrame, root: str, text: str, lang: str, sums: tuple[str, ...] = (), before: tuple[str, ...] = (), keep=None) -> DataFrame:
    """Occurrences of the trees of df's texts; null texts are empty. One pass, no shuffle.

    sums names measures (sources.measures.OWN) to add to each node, summed over its subtree, and
    before those to add as <name>_before, summed over all nodes ahead of it. keep(row of OCC)
    says which nodes to hand on: all trees are parsed and measured whole, and nodes that nobody
    asks for need not leave the worker.

    Parse distinct contents, then join on the content key, to share work between versions:
    see `distinct_contents`.
    """
    front = FRONT_ENDS[lang]
    unknown = {*sums, *before} - OWN.keys()
    if unknown:
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    schema = ", ".join([OCC, *(f"{n} bigint" for n in sums), *(f"{n}_before bigint" for n in before)])
    return per_text(df, [root, text], lambda r, t: [[r, *row] for row in measure(encode(front(t or "")), sums, before, keep)], schema)


def reprinted(df: DataFrame, root: str, text: str, lang: str) -> DataFrame:
    """(root, same): whether the leaves of each text's tree, in order, are the text; null texts are empty."""
    front = FRONT_ENDS[lang]
    return per_text(df, [root, text], lambda r, t: [[r, "".join(row[8] or "" for row in encode(front(t or "")) if row[4] == 1) == (t or "")]], "same boolean")


def distinct_contents(df: DataFrame, text: str) -> DataFrame:
    """(content, text): each distinct text once, keyed by its SHA-256."""
    return df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content"), F.coalesce(F.col(text), F.lit("")).alias(text)).dropDuplicates(["content"])


def forest(levels: list[tuple[DataFrame, list[str]]], once: bool = False) -> DataFrame:
    """Occurrences of trees given level by level.

    levels: (df, order): df has root, key, up (the parent's key; none on the first level),
    type, label; order sorts siblings. Keys are unique within a level. Only windows within
    a parent and joins on keys are used; the number of levels is fixed, so there is no
    recursion. Offsets are not set. once: each level is written as soon as it is sized, as the
    levels around it read it again; for trees that are few beside the tables they come from.
    """
    sized = None
    stack = []
    for df, order in reversed(levels):
        first = "up" not in df.columns
        here = df if not first else df.withColumn("up", F.lit(None).cast("long"))
        if sized is not None:
            under = sized.groupBy("root", F.col("up").alias("key")).agg(F.sum("size").alias("below"), F.max("height").alias("tall"))
            here = here.join(under, ["root", "key"], "left")
        else:
            here = here.withColumns({"below": F.lit(0).cast("long"), "tall": F.lit(-1)})
        here = here.withColumns({"size": F.coalesce("below", F.lit(0)) + 1, "height": F.coalesce("tall", F.lit(-1)) + 1}).drop("below", "tall")
        siblings = Window.partitionBy("root", "up").orderBy(*order)
        sized = here.withColumns({"pos": F.row_number().over(siblings) - 1, "ahead": F.coalesce(F.sum("size").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        sized = cut(sized) if once else sized
        stack.append(sized)
    out, above = None, None
    columns = ["root", "key", "up", "type", "label", "pos", "size", "height"]
    for depth, level in enumerate(reversed(stack)):
        if above is None:
            here = level.withColumns({"pre": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})
        else:
            here = level.join(above.select("root", F.col("key").alias("up"), F.col("pre").alias("parent")), ["root", "up"]).withColumn("pre", F.col("parent") + 1 + F.col("ahead"))
        here = here.select(*columns, "pre", "parent", F.lit(depth).alias("depth"))
        above = here
        out = here if out is None else out.unionByName(here)
    return out.withColumns({"post": F.col("pre") + F.col("size") - 1 - F.col("depth"), "role": F.lit(None).cast("string")})


def order_forest(spark, sf_dir: str, roots: DataFrame | None = None) -> DataFrame:
    """The driver tables as trees: a customer's orders and their lines; only those of roots(root), if given."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    customers = t("customer").select(F.col("c_custkey").alias("root"), F.col("c_custkey").alias("key"), F.lit("customer").alias("type"), F.col("c_mktsegment").alias("label"))
    orders = t("orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("up"), F.lit("order").alias("type"), F.col("o_orderstatus").alias("label"), "o_orderdate")
    lines = t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    owner = lambda: orders.select("root", F.col("key").alias("l_orderkey"))
    if roots is None:
        lines = lines.join(owner(), "l_orderkey")
    else:
        customers, orders = (x.join(roots.select("root").hint("shuffle_hash"), "root", "left_semi") for x in (customers, orders))
        orders = cut(orders)
        lines = lines.join(owner().hint("shuffle_hash"), "l_orderkey")
    lines = lines.select("root", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("key"), F.col("l_orderkey").alias("up"), F.lit("lineitem").alias("type"), "label", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return forest([(customers, ["key"]), (orders, ["o_orderdate", "key"]), (lines, ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])], once=roots is not None)
