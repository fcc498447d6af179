"""Queries mined from examples: a lattice of ever more general patterns."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators.diff import Tree
from sylvan.operators.lineage import cut

def to_query(tree: Tree, i: int = 0, labels: bool = True, hidden: frozenset[str] = frozenset(("spaces",))) -> str:
    """A pattern that matches the subtree at i: named nodes nest, labelled leaves get a text test."""
    kids = [to_query(tree, c, labels, hidden) for c in tree.children[i] if tree.type[c] not in hidden]
    if not tree.type[i][0].isalpha() and tree.type[i][0] != "_":
        return '"' + tree.type[i].replace('"', '\\"') + '"'
    own = ""
    if labels and not kids and tree.label[i] is not None:
        own = ' (#EQ? "' + tree.label[i].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '")'
    return "(" + " ".join([tree.type[i], *kids]) + own + ")"


def generalisations(query: str) -> list[tuple[str, str]]:
    """(kind, query) one step more general: a leaf removed (rm), or a text test dropped (eq)."""
    out, depth, starts, quoted = [], 0, [], False
    spans = []
    for at, c in enumerate(query):
        if c == '"' and (at == 0 or query[at - 1] != "\\"):
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            starts.append(at)
            depth += 1
        elif c == ")":
            spans.append((starts.pop(), at + 1, depth))
            depth -= 1
    tidy = lambda q: " ".join(q.split()).replace(" )", ")")
    for a, b, d in spans:
        body = query[a:b]
        if body.startswith("(#"):
            out.append(("eq", tidy(query[:a] + query[b:])))
        elif d > 1 and body.count("(") - body.count("(#") == 1:
            out.append(("rm", tidy(query[:a] + query[b:])))
    return sorted(set(out))


def _generalised(frames):
    import pandas as pd

    for pdf in frames:
        rows = [(q, made, kind) for q in pdf["query"] for kind, made in generalisations(q)]
        yield pd.DataFrame(rows, columns=["src", "dst", "kind"])


def lattice(examples: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(query, level), edges(src, dst, kind)) from examples(example, query).

    Without rounds it goes on until no new query is left to generalise. Each round
    generalises the distinct queries of the round before by one step; equal queries from
    different examples meet by a distinct, so work is shared between examples.
    """

    now = examples.select("query").distinct().withColumn("level", F.lit(0))
    nodes, edges = now, None
    for i in count(1) if rounds is None else range(1, rounds + 1):
        made = now.select("query").mapInPandas(_generalised, "src string, dst string, kind string").distinct()
        edges = made if edges is None else edges.unionByName(made)
        now = cut(made.select(F.col("dst").alias("query")).distinct().join(nodes.select("query"), "query", "left_anti").withColumn("level", F.lit(i)))
        if rounds is None and now.isEmpty():
            break
        nodes = nodes.unionByName(now)
    return nodes, edges


def support(examples: DataFrame, nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(query, examples): how many examples each query of the lattice covers.

    Without rounds examples are handed up until none reaches a new query.
    """
    covers = new = examples.select("example", "query").distinct()
    for _ in count() if rounds is None else range(rounds):
        up = new.join(edges, F.col("query") == F.col("src")).select("example", F.col("dst").alias("query")).distinct()
        new = cut(up.join(covers, ["example", "query"], "left_anti"))
        if rounds is None and new.isEmpty():
            break
        covers = covers.unionByName(new)
    return nodes.join(covers.groupBy("query").agg(F.countDistinct("example").alias("examples")), "query")


def likely_smells(supported: DataFrame, total: int, least: int = 5) -> DataFrame:
    """Queries that cover more than `least` examples but less than half, most covering, then longest, first."""
    return supported.filter((F.col("examples") > least) & (2 * F.col("examples") < total)).orderBy(F.desc("examples"), F.desc(F.length("query")), "query")


def groups(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of edges(src, dst), by least labels.

    Labels jump to their label's label each round, so long chains need few rounds.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    both = cut(both)
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("src")).select("node", F.least("component", "near").alias("component"))
        jump = step.join(step.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
        jump = cut(jump)
        if jump.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").isEmpty():
            return jump
        labels = jump


def lattice_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: queries, edges, tops (nothing more general), bottoms (nothing more special), widest level."""
    up = edges.groupBy(F.col("src").alias("query")).agg(F.count("*").alias("out"))
    down = edges.select(F.col("dst").alias("query"), F.lit(True).alias("made")).distinct()
    each = nodes.join(up, "query", "left").join(down, "query", "left")
    levels = each.groupBy("level").agg(F.count("*").alias("n"), F.coalesce(F.sum("out"), F.lit(0)).alias("out"), F.count_if(F.col("out").isNull()).alias("top"), F.count_if(F.col("made").isNull()).alias("bottom"))
    return levels.agg(F.sum("n").alias("queries"), F.sum("out").alias("edges"), F.sum("top").alias("tops"), F.sum("bottom").alias("bottoms"), F.max("n").alias("widest"))


def covering_tops(supported: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(query, examples): queries of at least so many examples that no more special one covers as well."""
    more = edges.join(supported.select(F.col("query").alias("src"), F.col("examples").alias("s")), "src")
    equal = more.join(supported.select(F.col("query").alias("dst"), F.col("examples").alias("d")), "dst").filter("s = d").select(F.col("dst").alias("query")).distinct()
    return supported.filter(F.col("examples") >= least).join(equal, "query", "left_anti").select("query", "examples")
