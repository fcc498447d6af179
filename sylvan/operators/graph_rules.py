"""Graph rules as text: stanzas of a pattern and statements, compiled to node and edge rows.

    global ROOT
    attribute definition = node => type = "def", symbol = (source-text node)
    (class_declaration name: (_) @name) @c {
      node @c.defs
      attr (@c.defs) definition = @name
      edge @c.defs -> ROOT
      if some @name { node n  edge n -> @c.defs } else { ... }
    }

Each stanza is one pattern query; its statements are projections of the matches. A scoped
variable (@x.name) is one graph node for each tree node and name, whichever stanzas name it,
so no order between stanzas matters. A local variable is one graph node for each match.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut
from sylvan.operators.patterns import matches

_TOKEN = re.compile(r'\s+|;[^\n]*|"(?:[^"\\]|\\.)*"|=>|->|[(){}=,]|@[\w-]+(?:\.[\w-]+)?|[\w-]+(?:\.[\w-]+)?')


@dataclass
class Rules:
    """names of globals, shorthands (name -> (parameter, attributes)) and stanzas (pattern, statements)."""

    globals: dict[str, str | None] = field(default_factory=dict)
    shorthands: dict[str, tuple[str, list]] = field(default_factory=dict)
    stanzas: list[tuple[str, list]] = field(default_factory=list)


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at : at + 10]!r} at {at}")
        at = m.end()
        if not m[0].isspace() and not m[0].startswith(";"):
            out.append(m[0])
    return out


def _query_end(text: str, at: int) -> int:
    """Where the statements of a stanza begin: the first { outside a string or comment."""
    m = re.compile(r'"(?:[^"\\]|\\.)*"|;[^\n]*|\{|[^"{;]+|"').match
    while at < len(text):
        hit = m(text, at)
        if hit[0] == "{":
            return at
        at = hit.end()
    raise ValueError("a stanza without statements")


def _block_end(text: str, at: int) -> int:
    depth, m = 0, re.compile(r'"(?:[^"\\]|\\.)*"|;[^\n]*|[{}]|[^"{};]+|"').match
    while at < len(text):
        hit = m(text, at)
        depth += {"{": 1, "}": -1}.get(hit[0], 0)
        at = hit.end()
        if not depth:
            return at
    raise ValueError("statements without an end")


def parse(text: str) -> Rules:
    """Rules of a text; ValueError where it can't be read."""
    rules, at = Rules(), 0
    blank = re.compile(r"(?:\s+|;[^\n]*)*")
    while (at := blank.match(text, at).end()) < len(text):
        line = re.compile(r"(global|attribute)\b([^\n]*)").match(text, at)
        if line and line[1] == "global":
            name, *default = _tokens(line[2])
            rules.globals[name] = json.loads(default[1]) if default else None
            at = line.end()
        elif line:
            tokens = _tokens(line[2])
            if tokens[1:2] != ["="] or tokens[3:4] != ["=>"]:
                raise ValueError(f"unexpected attribute {line[2]!r}")
            rules.shorthands[tokens[0]] = (tokens[2], _attributes(tokens, 4)[0])
            at = line.end()
        else:
            start = _query_end(text, at)
            end = _block_end(text, start)
            rules.stanzas.append((text[at:start].strip(), _statements(_tokens(text[start + 1 : end - 1]), 0)[0]))
            at = end
    return rules


def _value(tokens, i):
    if tokens[i] == "(":
        if tokens[i + 1] != "source-text" or tokens[i + 3] != ")":
            raise ValueError(f"unknown function {tokens[i + 1]!r}")
        return ("text", tokens[i + 2]), i + 4
    return (("const", json.loads(tokens[i])) if tokens[i].startswith('"') else ("ref", tokens[i])), i + 1


def _attributes(tokens, i):
    out = []
    while i < len(tokens) and tokens[i] not in ("}", "node", "edge", "attr", "if", "var", "let"):
        name, value, i = tokens[i], ("const", "true"), i + 1
        if i < len(tokens) and tokens[i] == "=":
            value, i = _value(tokens, i + 1)
        out.append((name, value))
        if i < len(tokens) and tokens[i] == ",":
            i += 1
        else:
            break
    return out, i


def _statements(tokens, i):
    out = []
    while i < len(tokens) and tokens[i] != "}":
        t = tokens[i]
        if t == "node":
            out.append(("node", tokens[i + 1]))
            i += 2
        elif t == "edge":
            if tokens[i + 2] != "->":
                raise ValueError("an edge needs ->")
            out.append(("edge", tokens[i + 1], tokens[i + 3]))
            i += 4
        elif t == "attr":
            end = tokens.index(")", i)
            of = tokens[i + 2 : end]
            attributes, i = _attributes(tokens, end + 1)
            out.append(("attr", of, attributes))
        elif t in ("let", "var"):
            value, j = _value(tokens, i + 3)
            out.append(("let", tokens[i + 1], value))
            i = j
        elif t == "if":
            how, capture = tokens[i + 1], tokens[i + 2]
            if how not in ("some", "none") or tokens[i + 3] != "{":
                raise ValueError("if some @x { or if none @x { is wanted")
            then, i = _statements(tokens, i + 4)
            other: list = []
            i += 1
            if i < len(tokens) and tokens[i] == "else":
                other, i = _statements(tokens, i + 2)
                i += 1
            out.append(("if", how, capture[1:], then, other))
        else:
            raise ValueError(f"unexpected {t!r}")
    return out, i


EMPTY = "map<string,string>"


def build(occ: DataFrame, source: str | Rules, given: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(root, id, attributes), edges(root, src, dst, attributes)) of all trees.

    Scoped nodes are "pre.name", local ones "at/captures/stanza.name", globals have the id
    that `given` says, or their default, or their own name. Attributes stated more than once
    for a node keep the greatest value. A repeated capture stands for its first node.
    """
    rules = parse(source) if isinstance(source, str) else source
    values = {n: (given or {}).get(n, default if default is not None else n) for n, default in rules.globals.items()}
    text = F.col("text") if "text" in occ.columns else F.col("label")
    texts = occ.select("root", F.col("pre").cast("long").alias("__pre"), F.coalesce(text, F.lit("")).alias("__text"))
    nodes, edges, node_facts, edge_facts = [], [], [], []
    for number, (query, statements) in enumerate(rules.stanzas):
        found = cut(matches(occ, query))
        here = F.concat(F.col("at").cast("string"), F.lit("/"), F.array_join(F.transform("captures", lambda c: c.pre.cast("string")), ","), F.lit(f"/{number}"))
        node_of = lambda c: F.get(F.filter("captures", lambda x: x["name"] == c), 0)["pre"]
        names: dict[str, tuple] = {}

        def ident(ref: str, names=names, node_of=node_of, here=here) -> Column:
            while ref in names:
                ref = names[ref][1]
            if ref.startswith("@"):
                capture, _, variable = ref[1:].partition(".")
                return F.concat_ws(".", node_of(capture).cast("string"), F.lit(variable or "node")) if variable else node_of(capture).cast("string")
            return F.lit(values[ref]) if ref in values else F.concat(here, F.lit("." + ref))

        def expand(attributes, bound=None):
            for name, value in attributes:
                if bound and value[0] in ("ref", "text") and value[1] in bound:
                    value = (value[0], bound[value[1]]) if value[0] == "text" else ("ref", bound[value[1]])
                if name in rules.shorthands:
                    parameter, inner = rules.shorthands[name]
                    yield from expand(inner, {parameter: value[1]})
                else:
                    yield name, value

        def states(statements, rows, found=found, ident=ident, node_of=node_of, names=names):
            for s in statements:
                if s[0] == "if":
                    there = node_of(s[2]).isNotNull()
                    states(s[3], rows.filter(there if s[1] == "some" else ~there))
                    states(s[4], rows.filter(~there if s[1] == "some" else there))
                elif s[0] == "let":
                    names[s[1]] = s[2]
                elif s[0] == "node":
                    nodes.append(rows.select("root", ident(s[1]).alias("id")))
                elif s[0] == "edge":
                    edges.append(rows.select("root", ident(s[1]).alias("src"), ident(s[2]).alias("dst")))
                else:
                    for name, (kind, value) in expand(s[2]):
                        of = [ident(x).alias(c) for x, c in zip((x for x in s[1] if x != "->"), ("src", "dst"))]
                        facts = rows.select("root", *of, F.lit(name).alias("name"), (node_of(value[1:].split(".")[0]) if kind == "text" else F.lit(None).cast("long")).alias("__pre"), (F.lit(value) if kind == "const" else F.lit("") if kind == "text" else ident(value)).alias("value"))
                        facts = facts.join(texts, ["root", "__pre"], "left").withColumn("value", F.coalesce("__text", "value")).drop("__pre", "__text")
                        (edge_facts if len(of) > 1 else node_facts).append(facts)

        states(statements, found)

    def together(rows, keys, facts, columns):
        if not rows:
            return occ.select("root", *(F.lit("").alias(k) for k in keys), F.create_map().cast(EMPTY).alias("attributes")).limit(0)
        each = reduce(DataFrame.unionByName, rows).filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).distinct()
        if not facts:
            return each.withColumn("attributes", F.create_map().cast(EMPTY))
        said = reduce(DataFrame.unionByName, facts).withColumnsRenamed(columns).groupBy("root", *keys, "name").agg(F.max("value").alias("value"))
        maps = said.groupBy("root", *keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
        return each.join(maps, ["root", *keys], "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast(EMPTY)))

    return together(nodes, ["id"], node_facts, {"src": "id"}), together(edges, ["src", "dst"], edge_facts, {})
