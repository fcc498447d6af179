"""Graphs built from pattern matches: each stanza gives nodes and edges for its captures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.operators.patterns import matches


@dataclass
class Stanza:
    """query with node: capture -> variable names, edges: ((capture, var), (capture, var)).

    attributes: (capture, var) -> {name: "text" for the node's text, or a constant}.
    """

    query: str
    nodes: dict[str, list[str]] = field(default_factory=dict)
    edges: list[tuple[tuple[str, str], tuple[str, str]]] = field(default_factory=list)
    attributes: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)


def captured(found: DataFrame, name: str) -> Column:
    return F.get(F.filter("captures", lambda c: c["name"] == name), 0)["pre"]


def build(occ: DataFrame, stanzas: list[Stanza]) -> tuple[DataFrame, DataFrame]:
    """(nodes(root, id, attributes), edges(root, src, dst)); ids are "pre.variable".

    A scoped variable is shared by all stanzas that name it on the same tree node.
    """
    text = F.col("text") if "text" in occ.columns else F.col("label")
    texts = occ.select("root", F.col("pre").cast("long").alias("__pre"), F.coalesce(text, F.lit("")).alias("__text"))
    nodes = edges = None
    for s in stanzas:
        found = matches(occ, s.query)
        ident = lambda c, v, f=found: F.concat_ws(".", captured(f, c).cast("string"), F.lit(v))
        for c, names in s.nodes.items():
            for v in names:
                given = s.attributes.get((c, v), {})
                rows = found.select("root", captured(found, c).alias("__pre"), ident(c, v).alias("id")).filter("__pre IS NOT NULL").distinct().join(texts, ["root", "__pre"])
                pairs = [x for k, value in given.items() for x in (F.lit(k), F.col("__text") if value == "text" else F.lit(value))]
                rows = rows.select("root", "id", (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("attributes"))
                nodes = rows if nodes is None else nodes.unionByName(rows)
        for (a, va), (b, vb) in s.edges:
            rows = found.filter(captured(found, a).isNotNull() & captured(found, b).isNotNull()).select("root", ident(a, va).alias("src"), ident(b, vb).alias("dst")).distinct()
            edges = rows if edges is None else edges.unionByName(rows)
    return nodes, edges
