"""Registered queries of the pattern language, one for each of its parts, on the forest of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvan.operators import graph, graph_rules, navigation, patterns, references, serialize
from sylvan.operators.lineage import cut
from sylvan.plans.catalog import FOREST, load, query
from sylvan.sources.trees import distinct_contents, order_forest, parse

LINES = f"""{FOREST}, ln AS MATERIALIZED (SELECT *, lead(pre) OVER w AS nx, lead(label) OVER w AS nl FROM occ WHERE type = 'lineitem' WINDOW w AS (PARTITION BY root, parent ORDER BY pos))"""


def _named(found, *names):
    return found.select("root", "at", *(graph.captured(found, n).alias(n) for n in names))


def _joined(found, name):
    """The nodes of a capture as text."""
    nodes = F.transform(F.filter("captures", lambda c: c["name"] == name), lambda c: c.pre.cast("string"))
    return found.select("root", "at", F.array_join(nodes, ",").alias(name))


@query(f"WITH {FOREST} SELECT root, parent AS at, string_agg(pre::VARCHAR, ',' ORDER BY pos) AS r FROM occ WHERE type = 'lineitem' AND label = 'R' GROUP BY 1, 2")
def pattern_runs(spark, sf_dir):
    """A repeated step is one row with all siblings it matches."""
    return _joined(patterns.matches(order_forest(spark, sf_dir), '(order (lineitem (#EQ? "R"))+ @r)'), "r")


@query(f"WITH {FOREST}, n AS (SELECT * FROM occ WHERE type = 'lineitem' AND label = 'N') SELECT n.root, n.parent AS at, n.pre AS n, coalesce((SELECT string_agg(r.pre::VARCHAR, ',' ORDER BY r.pos) FROM occ r WHERE r.root = n.root AND r.parent = n.parent AND r.label = 'R' AND r.pos < n.pos), '') AS r FROM n")
def pattern_runs_before(spark, sf_dir):
    """A run that may be empty, as long as it can be before the step behind it."""
    found = patterns.matches(order_forest(spark, sf_dir), '(order (lineitem (#EQ? "R"))* @r (lineitem (#EQ? "N")) @n)')
    nodes = F.transform(F.filter("captures", lambda c: c["name"] == "r"), lambda c: c.pre.cast("string"))
    return found.select("root", "at", graph.captured(found, "n").alias("n"), F.array_join(nodes, ",").alias("r"))


@query(f"WITH {LINES} SELECT root, parent AS at, pre AS a, nx AS b FROM ln WHERE nx IS NOT NULL AND label <> nl")
def pattern_unequal_captures(spark, sf_dir):
    return _named(patterns.matches(order_forest(spark, sf_dir), "(order (lineitem) @a . (lineitem) @b (#not-eq? @a @b))"), "a", "b")


@query(f"WITH {FOREST} SELECT root, parent AS at, bool_or(label = 'R') AS some_r, bool_and(label = 'R') AS all_r, bool_or(label ~ '[AN]') AS some_an FROM occ WHERE type = 'lineitem' GROUP BY 1, 2")
def pattern_some_or_all(spark, sf_dir):
    """Predicates on runs that hold for some or for all nodes."""
    occ = cut(order_forest(spark, sf_dir))
    held = lambda test, name: patterns.matches(occ, f"(order (lineitem)+ @x {test})").select("root", "at", F.lit(True).alias(name))
    out = patterns.matches(occ, "(order (lineitem)+ @x)").select("root", "at")
    for test, name in (('(#any-eq? @x "R")', "some_r"), ('(#eq? @x "R")', "all_r"), ('(#any-match? @x "[AN]")', "some_an")):
        out = out.join(held(test, name), ["root", "at"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query(f"WITH {FOREST} SELECT root, pre AS x, label ~ '^[FO]$' AND label NOT IN ('O', 'X') AS kept FROM occ WHERE type = 'order' AND label ~ '[FOP]' AND label IN ('F', 'O', 'P') AND NOT (label ~ 'X')")
def pattern_late_tests(spark, sf_dir):
    """Text predicates after the match: match, not-match, any-of, not-any-of."""
    occ = cut(order_forest(spark, sf_dir))
    wide = patterns.matches(occ, '((order) @x (#match? @x "[FOP]") (#any-of? @x "F" "O" "P") (#not-match? @x "X"))').select("root", F.col("at").alias("x"))
    narrow = patterns.matches(occ, '((order) @x (#match? @x "^[FO]$") (#not-any-of? @x "O" "X"))').select("root", F.col("at").alias("x"), F.lit(True).alias("kept"))
    return wide.join(narrow, ["root", "x"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query(f"WITH {LINES} SELECT root, parent AS at, pre AS a, nx AS b FROM ln WHERE label = 'R' AND nl <> 'R' AND nl NOT IN ('N')")
def pattern_immediate_tests(spark, sf_dir):
    """Predicates during the match, on the node they follow: EQ, NOT-EQ, NOT-MATCH."""
    q = '(order (lineitem (#EQ? "R")) @a . (lineitem (#NOT-EQ? "R") (#NOT-MATCH? "N")) @b)'
    return _named(patterns.matches(order_forest(spark, sf_dir), q), "a", "b")


@query("SELECT * FROM (VALUES (0, 'kind', 'test'), (0, 'local', 'true'), (1, 'local', 'false'), (1, 'x', 'true')) t(pattern, name, value)")
def pattern_metadata(spark, sf_dir):
    """Properties that a query sets for its patterns; they don't take part in matching."""
    found = patterns.parse('((a) @x (#set! kind "test") (#is? local)) ((b) (c) (#is-not? local) (#set! x))')
    rows = [(i, k, str(v).lower() if isinstance(v, bool) else v) for i, p in enumerate(found) for k, v in p.properties.items()]
    return spark.createDataFrame(rows, "pattern int, name string, value string")


@query(f"WITH {FOREST} SELECT root, parent AS at, count(*) AS n FROM occ WHERE type = 'lineitem' GROUP BY 1, 2 HAVING count(*) FILTER (label = 'R') >= 3")
def pattern_general_predicate(spark, sf_dir):
    """A predicate of one's own, given as a function of captured texts."""
    often = {"#often?": lambda texts, word, n: F.size(F.filter(texts, lambda t: t == word)) >= int(n)}
    found = patterns.matches(order_forest(spark, sf_dir), '(order (lineitem)+ @x (#often? @x "R" "3"))', predicates=often)
    return found.select("root", "at", F.size("captures").cast("long").alias("n"))


@query(f"WITH {FOREST} SELECT root, parent AS at, pre AS g FROM occ WHERE type = 'order' AND label = 'F' AND size > 1")
def pattern_supertypes_and_roles(spark, sf_dir):
    """(supertype/type), a role before a step, a role that must not be there."""
    occ = order_forest(spark, sf_dir)
    occ = occ.withColumn("supertypes", F.when(F.col("size") > 1, F.array(F.lit("group"))).otherwise(F.array(F.lit("leaf"))))
    occ = occ.withColumn("role", F.when(F.col("type") == "order", F.concat(F.lit("is_"), F.col("label"))))
    return _named(patterns.matches(occ, "(group/customer is_F: (group/_ !is_O) @g !nothing)"), "g")


@query(f"WITH {FOREST}, l AS (SELECT root, pre AS a, lead(pre) OVER (PARTITION BY root ORDER BY pre) AS b FROM occ WHERE type = 'lineitem') SELECT root, 0::BIGINT AS at, a, b FROM l WHERE b IS NOT NULL")
def pattern_through_hidden_nodes(spark, sf_dir):
    """With orders hidden, all lines of a customer are siblings; orders without lines are gone too."""
    occ = order_forest(spark, sf_dir).withColumn("is_hidden", F.col("type") == "order")
    return _named(patterns.matches(occ, "(customer (lineitem) @a . (lineitem) @b)"), "a", "b")


@query(f"WITH {LINES} SELECT root, parent AS at, pre AS a, nx AS b FROM ln WHERE label = 'R' AND nl = 'A' UNION ALL SELECT root, parent, pre, nx FROM ln WHERE label = 'N' AND nl = 'N'")
def pattern_groups(spark, sf_dir):
    """Groups of siblings, as alternatives, below any parent."""
    q = '[((lineitem (#EQ? "R")) @a . (lineitem (#EQ? "A")) @b) ((lineitem (#EQ? "N")) @a . (lineitem (#EQ? "N")) @b)]'
    return _named(patterns.matches(order_forest(spark, sf_dir), q), "a", "b")


@query(f"WITH {FOREST} SELECT root, 0 AS pattern, pre AS at FROM occ WHERE pre = 0 AND type = 'customer' UNION ALL SELECT root, 2, pre FROM occ WHERE pre = 0 AND label = 'BUILDING'")
def pattern_at_roots(spark, sf_dir):
    """Matches at tree roots alone, with one of three patterns switched off."""
    return patterns.matches(order_forest(spark, sf_dir), '(customer) (customer) (_ (#EQ? "BUILDING"))', root_only=True, enabled=[0, 2]).select("root", "pattern", "at")


@query(f"WITH {FOREST} SELECT root, parent AS at, pre AS x FROM occ WHERE type = 'lineitem' AND label = 'R'")
def pattern_with_detected_parts(spark, sf_dir):
    """Precomputed patterns found inside a query by themselves; trees without them are skipped."""
    ready = '(lineitem (#EQ? "R"))\n(order (lineitem))'
    occ = cut(patterns.match_bits(order_forest(spark, sf_dir), ready))
    return _named(patterns.with_precomputed(occ, '(order (lineitem (#EQ? "R")) @x)', ready), "x")


@query(
    "SELECT * FROM (VALUES ('select', '(c (d) @y)'), ('remove', '(a (c (d) @y))'), ('capture', '(a (b) @x . (c (d) @y) @z) (#eq? @x \"1\")'), ('uncapture', '(a (b) . (c (d) @y))'), "
    "('rename', '(a (b) @y . (c (d) @x)) (#eq? @y \"1\")'), ('union', '(a (b) @x . (c (d) @y)) (#eq? @x \"1\")\n(k)'), ('regenerate', '(a (c (e)) (f))')) t(refinement, result)"
)
def refined_queries(spark, sf_dir):
    """Refinements of one query text."""
    from sylvan.operators import refine

    q = '(a (b) @x . (c (d) @y) (#eq? @x "1"))'
    rows = [
        ("select", refine.select(q, (1,))),
        ("remove", refine.remove(q, [(0,)])),
        ("capture", refine.capture(q, (1,), "z")),
        ("uncapture", refine.uncapture(q, "x")),
        ("rename", refine.rename(q, {"x": "y", "y": "x"})),
        ("union", refine.union([q, "(k)", q])),
        ("regenerate", refine.regenerate(q, [("delete", (0,)), ("replace", (1, 0), "(e)"), ("insert", (2,), "(f)")])),
    ]
    return spark.createDataFrame(rows, "refinement string, result string")


RULES = """
global ROOT
attribute definition = node => kind = "def", text = (source-text node)
(customer) @c { node @c.scope  edge @c.scope -> ROOT }
(customer (order) @o) @c { node @o.scope  edge @o.scope -> @c.scope  attr (@o.scope) definition = @o }
(order (lineitem (#EQ? "R"))? @l) @o {
  if some @l { node use  edge use -> @o.scope  attr (use) kind = "use" } else { node @o.quiet  edge @o.quiet -> @o.scope }
}
"""
SCOPES = f"""{FOREST}, r AS MATERIALIZED (SELECT o.root, o.pre, l.pre AS line FROM occ o LEFT JOIN occ l ON l.root = o.root AND l.parent = o.pre AND l.label = 'R' AND l.type = 'lineitem' WHERE o.type = 'order')"""


@query(
    f"""WITH {SCOPES} SELECT root, '0.scope' AS src, 'ROOT' AS dst FROM occ WHERE pre = 0 UNION ALL SELECT root, pre || '.scope', '0.scope' FROM occ WHERE type = 'order'
UNION ALL SELECT root, pre || '/' || line || ',' || pre || '/2.use', pre || '.scope' FROM r WHERE line IS NOT NULL UNION ALL SELECT root, pre || '.quiet', pre || '.scope' FROM r WHERE line IS NULL"""
)
def graph_rule_edges(spark, sf_dir):
    """Edges that graph rules as text build: scoped and local nodes, a global, branches."""
    return graph_rules.build(order_forest(spark, sf_dir), RULES)[1].select("root", "src", "dst")


@query(
    f"""WITH {SCOPES} SELECT root, '0.scope' AS id, NULL AS kind, NULL AS text FROM occ WHERE pre = 0 UNION ALL SELECT root, pre || '.scope', 'def', label FROM occ WHERE type = 'order'
UNION ALL SELECT root, pre || '/' || line || ',' || pre || '/2.use', 'use', NULL FROM r WHERE line IS NOT NULL UNION ALL SELECT root, pre || '.quiet', NULL, NULL FROM r WHERE line IS NULL"""
)
def graph_rule_nodes(spark, sf_dir):
    """Nodes that graph rules as text build, with their attributes by a shorthand."""
    nodes = graph_rules.build(order_forest(spark, sf_dir), RULES)[0]
    return nodes.select("root", "id", F.try_element_at("attributes", F.lit("kind")).alias("kind"), F.try_element_at("attributes", F.lit("text")).alias("text"))


# Navigation


@query(f"WITH {FOREST} SELECT root, parent AS pre, pre AS child, 'child' AS what FROM occ WHERE type = 'lineitem' AND label = 'R' UNION ALL SELECT DISTINCT root, parent, NULL::BIGINT, 'has' FROM occ WHERE type = 'lineitem' AND label = 'A'")
def children_by_role(spark, sf_dir):
    """Children that play a role, and nodes that have one of another role."""
    occ = cut(order_forest(spark, sf_dir).withColumn("role", F.when(F.col("type") == "lineitem", F.col("label"))))
    has = navigation.has_child_with_role(occ, "A").select("root", "pre", F.lit(None).cast("long").alias("child"), F.lit("has").alias("what"))
    return navigation.child_by_role(occ, "R").withColumn("what", F.lit("child")).unionByName(has)


TEXTS = f"""{FOREST}, t AS MATERIALIZED (SELECT root, pre, size, depth, type, sum(CASE WHEN size = 1 THEN length(label) ELSE 0 END) OVER (PARTITION BY root ORDER BY pre) AS past, CASE WHEN size = 1 THEN length(label) ELSE 0 END AS n FROM occ),
p AS MATERIALIZED (SELECT a.root, a.pre, a.depth, a.type, (a.past - a.n)::BIGINT AS s, b.past::BIGINT AS e FROM t a JOIN t b ON b.root = a.root AND b.pre = a.pre + a.size - 1)"""


@query(f"WITH {TEXTS}, g AS (SELECT root, s, lead(e) OVER (PARTITION BY root ORDER BY pre) AS e2 FROM p WHERE type = 'lineitem') SELECT g.root, g.s AS range_start, g.e2 AS range_end, max_by(p.pre, p.depth * 1000000 - p.pre) AS pre FROM g JOIN p ON p.root = g.root AND p.s <= g.s AND p.e >= g.e2 WHERE e2 IS NOT NULL GROUP BY 1, 2, 3")
def nodes_at_ranges(spark, sf_dir):
    """The deepest node over each two successive lines: their order, or the customer where they lie in two."""
    from pyspark.sql import Window

    occ = cut(order_forest(spark, sf_dir))
    occ = cut(occ.join(navigation.text_positions(occ).withColumnsRenamed({"first_char": "start", "past_char": "end"}), ["root", "pre"]))
    after = F.lead("end").over(Window.partitionBy("root").orderBy("pre"))
    ranges = occ.filter("type = 'lineitem'").select("root", F.col("start").alias("range_start"), after.alias("range_end")).filter("range_end IS NOT NULL")
    return navigation.node_at_range(occ, ranges).select("root", "range_start", "range_end", "pre")


@query(
    f"""WITH {TEXTS}, x AS (SELECT root, pre, row_number() OVER (PARTITION BY root ORDER BY depth, pre) - 1 AS bfs, pre + size - 1 - depth AS post FROM occ),
y AS (SELECT o.root, o.pre, CASE o.depth WHEN 0 THEN '' WHEN 1 THEN printf('%02X', o.pos) ELSE printf('%02X%02X', q.pos, o.pos) END AS packed FROM occ o LEFT JOIN occ q ON q.root = o.root AND q.pre = o.parent)
SELECT p.root, p.pre, post, bfs, packed, s AS first_char, e AS past_char FROM p JOIN x USING (root, pre) JOIN y USING (root, pre)"""
)
def node_positions(spark, sf_dir):
    """Every way to say where a node is, with paths packed to text; those that don't unpack again are left out."""
    at = navigation.positions(cut(order_forest(spark, sf_dir))).withColumn("packed", navigation.packed_path(F.col("path")))
    return at.filter(navigation.unpacked_path(F.col("packed")) == F.col("path")).drop("path")


@query(f"WITH {FOREST}, l AS (SELECT root, pre, parent, pos, lead(parent) OVER w AS np, lead(pos) OVER w AS nx FROM occ WHERE type = 'lineitem' WINDOW w AS (PARTITION BY root ORDER BY pre)) SELECT l.root, l.pre, CASE WHEN np = l.parent THEN o.pos::VARCHAR ELSE '' END AS above FROM l JOIN occ o ON o.root = l.root AND o.pre = l.parent WHERE np IS NOT NULL")
def shared_paths(spark, sf_dir):
    """The common path of each two successive lines."""
    from pyspark.sql import Window

    occ = cut(order_forest(spark, sf_dir))
    at = navigation.paths(occ).join(occ.filter("type = 'lineitem'").select("root", "pre"), ["root", "pre"])
    both = at.withColumn("next", F.lead("path").over(Window.partitionBy("root").orderBy("pre"))).filter("next IS NOT NULL")
    return both.select("root", "pre", F.array_join(navigation.shared_path(F.col("path"), F.col("next")).cast("array<string>"), "/").alias("above"))


DOC = r"""d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)"""


@query(f"WITH {DOC} SELECT doc_id, len(l)::BIGINT AS lines, (len(l) - 1)::BIGINT AS ended, (len(l) * (len(l) + 1) // 2)::BIGINT AS starts FROM d")
def document_lines(spark, sf_dir):
    """Line ranges of the nodes of parsed texts: how many lines, how many end in a break, the sum of their numbers."""
    occ = parse(load(spark, sf_dir, "documents"), "doc_id", "text", "text", sums=("line_count",), before=("line_count",), keep=lambda row: row[7] == "line")
    first = F.col("line_count_before") + 1
    return occ.groupBy(F.col("root").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum("line_count").alias("ended"), F.sum(first).alias("starts"))


@query(
    f"WITH {DOC} SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes_len, (len(l) - 1)::BIGINT AS line_count, (len(l) - 1)::BIGINT AS loc, "
    "(1 + len(l) + len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x1c-\\x1f]+')))::BIGINT AS size_no_spaces FROM d"
)
def document_metrics(spark, sf_dir):
    """Metrics at the roots of parsed texts, summed up where each tree is made."""
    names = ("bytes_len", "line_count", "loc", "size_no_spaces")
    occ = parse(load(spark, sf_dir, "documents"), "doc_id", "text", "text", sums=(*names, "spaces"), keep=lambda row: row[1] is None)
    return occ.filter(F.col("size") - F.col("spaces") == F.col("size_no_spaces")).select(F.col("root").alias("doc_id"), *names)


@query(r"SELECT doc_id, regexp_replace(text, '(^|\n)the ', '\1* ', 'g') AS text, regexp_extract(text, '(?:^|\n)([ \t]*)[^\n]*$', 1) AS last FROM documents")
def indented_documents(spark, sf_dir):
    """Texts with another indentation, and that of their last line."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", serialize.reindented(F.col("text"), "the ", "* ").alias("text"), serialize.indentation(F.col("text")).alias("last"))


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) JOIN (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark WHERE item_id % 2 = 0) USING (w)")
def documents_that_may_contain(spark, sf_dir):
    """Documents with some word of a wanted set: a left semi join stands for the bloom filter."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("root"), F.split("text", " ").alias("terms"))
    wanted = load(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select(F.explode(F.split("text", " ")).alias("term")).distinct()
    return references.may_contain(d, wanted).select(F.col("root").alias("doc_id"))


@query("SELECT sha256(props) AS content, '(object (pair ' || '\"' || regexp_extract(props, '\"([^\"]*)\"', 1) || '\" value: (number \"' || regexp_extract(props, ':\\s*([0-9]+)', 1) || '\")))' AS sexp FROM (SELECT DISTINCT props FROM events)")
def event_shapes(spark, sf_dir):
    """Event properties, each distinct text parsed once, with roles and labels."""
    contents = distinct_contents(load(spark, sf_dir, "events"), "props")
    return serialize.sexpressions(parse(contents, "content", "props", "json"), roles=True).select(F.col("root").alias("content"), "sexp")
