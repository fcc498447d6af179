"""More registered queries: views, folds, neighbours, differences and relations of trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvan.operators import aggregates, diff, history, metrics, navigation, patterns, serialize
from sylvan.operators.lineage import cut
from sylvan.plans.catalog import FOREST, load, query
from sylvan.sources.trees import order_forest


@query(f"WITH {FOREST} SELECT root, parent AS pre, pre AS child FROM occ WHERE pos = 0 AND parent IS NOT NULL")
def first_children(spark, sf_dir):
    return navigation.child_at(order_forest(spark, sf_dir), 0).select("root", "pre", "child")


@query(f"WITH {FOREST} SELECT root, parent AS pre, count(*) AS children FROM occ WHERE parent IS NOT NULL GROUP BY 1, 2")
def child_counts(spark, sf_dir):
    return navigation.child_counts(order_forest(spark, sf_dir))


@query(f"WITH {FOREST} SELECT root, pre, size - 1 AS descendants FROM occ")
def descendant_counts(spark, sf_dir):
    return navigation.descendant_count(order_forest(spark, sf_dir))


@query(f"WITH {FOREST} SELECT root, pre, lag(pre) OVER w AS previous, lead(pre) OVER w AS next FROM occ WINDOW w AS (PARTITION BY root, parent ORDER BY pos)")
def sibling_neighbours(spark, sf_dir):
    return navigation.sibling_neighbours(order_forest(spark, sf_dir))


@query(f"WITH {FOREST} SELECT root, pre, parent AS ancestor FROM occ WHERE type = 'lineitem'")
def enclosing_orders(spark, sf_dir):
    occ = order_forest(spark, sf_dir)
    return navigation.enclosing(occ, occ.filter("type = 'lineitem'"), ["order"])


@query(f"WITH {FOREST} SELECT root, pre, row_number() OVER (PARTITION BY root ORDER BY pre) - 1 AS rank FROM occ WHERE NOT (type = 'lineitem' AND label = 'R')")
def hidden_view(spark, sf_dir):
    occ = order_forest(spark, sf_dir)
    return navigation.hide(occ, occ.filter("type = 'lineitem' AND label = 'R'")).select("root", "pre", "rank")


@query(
    f"WITH {FOREST}, t AS (SELECT root, pre, size, sum(CASE WHEN size = 1 THEN length(label) ELSE 0 END) OVER (PARTITION BY root ORDER BY pre) AS past, CASE WHEN size = 1 THEN length(label) ELSE 0 END AS n FROM occ) "
    "SELECT a.root, a.pre, (a.past - a.n)::BIGINT AS first_char, b.past::BIGINT AS past_char FROM t a JOIN t b ON b.root = a.root AND b.pre = a.pre + a.size - 1"
)
def text_positions(spark, sf_dir):
    return navigation.text_positions(order_forest(spark, sf_dir))


@query(f"WITH {FOREST} SELECT root, string_agg(repeat('  ', depth) || type || ' ' || label, chr(10) ORDER BY pre) AS outline FROM occ GROUP BY 1")
def tree_outlines(spark, sf_dir):
    return serialize.outline(order_forest(spark, sf_dir))


def _nested(sep: str, line: str, order: str, customer: str) -> str:
    """SQL that writes trees from the inside out; below is the joined text of the children, put between by sep."""
    return f"""WITH {FOREST},
l AS (SELECT root, parent, string_agg({line}, '{sep}' ORDER BY pos) AS below FROM occ WHERE type = 'lineitem' GROUP BY 1, 2),
o AS (SELECT occ.root, string_agg({order}, '{sep}' ORDER BY occ.pos) AS below FROM occ LEFT JOIN l ON l.root = occ.root AND l.parent = occ.pre WHERE type = 'order' GROUP BY 1)
SELECT occ.root, {customer} FROM occ LEFT JOIN o ON o.root = occ.root WHERE type = 'customer'"""


_SEXP = "'(%s \"' || label || '\"' || coalesce(' ' || below, '') || ')'"


@query(_nested(" ", _SEXP.replace("below", "NULL") % "lineitem", _SEXP % "order", _SEXP % "customer" + " AS sexp"))
def tree_sexpressions(spark, sf_dir):
    return serialize.sexpressions(order_forest(spark, sf_dir))


_JSON = "'{\"type\": \"%s\", \"label\": \"' || label || '\"' || coalesce(', \"children\": [' || below || ']', '') || '}'"


@query(_nested(", ", _JSON.replace("below", "NULL") % "lineitem", _JSON % "order", _JSON % "customer" + " AS json"))
def tree_json(spark, sf_dir):
    return serialize.json_trees(order_forest(spark, sf_dir))


@query(f"WITH {FOREST}, k AS (SELECT root, CASE WHEN size > 1 THEN 'both' ELSE 'labeled' END AS kind, pre FROM occ) SELECT root, kind, string_agg(pre::VARCHAR, ',' ORDER BY pre) AS nodes FROM k GROUP BY 1, 2")
def tree_views_by_kind(spark, sf_dir):
    return serialize.view(order_forest(spark, sf_dir)).withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


@query(
    f"WITH {FOREST} SELECT a.root, a.pre, concat_ws('/', CASE WHEN a.depth = 2 THEN c.label END, CASE WHEN a.depth >= 1 THEN b.label END, a.label) AS path FROM occ a "
    "LEFT JOIN occ b ON b.root = a.root AND b.pre = a.parent LEFT JOIN occ c ON c.root = b.root AND c.pre = b.parent WHERE a.depth = 0 OR (a.depth = 1 AND a.label <> 'O') OR (a.depth = 2 AND b.label <> 'O')"
)
def label_paths(spark, sf_dir):
    """Labels handed down, open orders left out with their lines."""
    occ = order_forest(spark, sf_dir)
    kept = F.col("type").isin("customer", "lineitem") | (F.col("label") != "O")
    return metrics.top_down(occ, F.col("label"), lambda above: F.concat(above, F.lit("/"), F.col("label")), "path", kept)


@query(f"WITH {FOREST}, m AS (SELECT o.root, o.pre AS at, l.pre AS l, row_number() OVER (PARTITION BY o.root ORDER BY o.pre, l.pre) AS r FROM occ o JOIN occ l ON l.root = o.root AND l.parent = o.pre WHERE o.type = 'order') SELECT m.root, m.at, m.l FROM m WHERE r <= 12")
def pattern_limited(spark, sf_dir):
    """The limit is the feature: the first 12 matches in each tree."""
    found = patterns.limited(patterns.matches(order_forest(spark, sf_dir), "(order (lineitem) @l)"), 12)
    return found.select("root", "at", F.col("captures")[0]["pre"].alias("l"))


#: Contents of orders and customers, and pairs of customers with consecutive keys.
CONTENTS = f"""{FOREST},
lc AS MATERIALIZED (SELECT root, parent, string_agg(label, ',' ORDER BY pos) AS c FROM occ WHERE type = 'lineitem' GROUP BY 1, 2),
oc AS MATERIALIZED (SELECT occ.root, occ.pre, occ.pos, occ.size, occ.label || '(' || coalesce(c, '') || ')' AS c FROM occ LEFT JOIN lc ON lc.root = occ.root AND lc.parent = occ.pre WHERE type = 'order'),
cc AS MATERIALIZED (SELECT occ.root, occ.size, occ.height, occ.label || '[' || (SELECT string_agg(oc.c, ';' ORDER BY oc.pos) FROM oc WHERE oc.root = occ.root) || ']' AS c FROM occ WHERE type = 'customer'),
pairs AS (SELECT c_custkey AS pair, c_custkey AS src_root, c_custkey + 1 AS dst_root FROM customer)"""


def _pairs(spark, sf_dir):
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(key.alias("pair"), key.alias("src_root"), (key + 1).alias("dst_root"))


def _contents(spark, sf_dir):
    occ = cut(order_forest(spark, sf_dir))
    return cut(occ.join(metrics.merkle(occ, levels=2), ["root", "pre"]))


_EQUAL = """same AS (SELECT pair FROM pairs JOIN cc a ON a.root = src_root JOIN cc b ON b.root = dst_root AND b.c = a.c WHERE a.height > 0),
found AS (SELECT pair, 0::BIGINT AS src, 0::BIGINT AS dst, a.size FROM same JOIN pairs USING (pair) JOIN cc a ON a.root = src_root
  UNION ALL SELECT pair, a.pre, b.pre, a.size FROM pairs JOIN oc a ON a.root = src_root JOIN oc b ON b.root = dst_root AND b.c = a.c
  WHERE a.size > 1 AND NOT (a.pos = b.pos AND pair IN (SELECT pair FROM same)))"""


@query(f"WITH {CONTENTS}, {_EQUAL} SELECT pair, src, dst, size, count(*) OVER (PARTITION BY pair, src) = 1 AND count(*) OVER (PARTITION BY pair, dst) = 1 AS is_unique FROM found")
def equal_subtrees(spark, sf_dir):
    """Maximal equal subtrees of consecutive customers' trees, from orders up; unique ones marked."""
    one, more = diff.unique_matches(diff.equal_subtrees(_pairs(spark, sf_dir), _contents(spark, sf_dir), least_height=1))
    return one.withColumn("is_unique", F.lit(True)).unionByName(more.withColumn("is_unique", F.lit(False)))


@query(
    f"WITH {CONTENTS}, {_EQUAL}, u AS (SELECT *, count(*) OVER (PARTITION BY pair, src) AS s, count(*) OVER (PARTITION BY pair, dst) AS d FROM found), "
    "links AS (SELECT pair, src + i AS src, dst + i AS dst FROM (SELECT *, unnest(range(size)) AS i FROM u WHERE s = 1 AND d = 1)) "
    "SELECT root, pre, root + 1 AS next_root, links.dst AS next_pre, CASE WHEN links.dst IS NULL THEN 'missing' ELSE 'direct' END AS status FROM occ LEFT JOIN links ON links.pair = root AND links.src = pre"
)
def followed_nodes(spark, sf_dir):
    """Every node followed into the next customer's tree by unique equal subtrees."""
    occ, pairs = _contents(spark, sf_dir), _pairs(spark, sf_dir)
    unique, _ = diff.unique_matches(diff.equal_subtrees(pairs, occ, least_height=1))
    return history.follow(occ, pairs, diff.link_below(unique), occ)


@query(
    f"WITH {CONTENTS} SELECT pair, 'deleted' AS side, a.pre FROM pairs JOIN oc a ON a.root = src_root WHERE NOT EXISTS (SELECT 1 FROM oc b WHERE b.root = dst_root AND b.c = a.c) "
    "UNION ALL SELECT pair, 'added', b.pre FROM pairs JOIN oc b ON b.root = dst_root WHERE NOT EXISTS (SELECT 1 FROM oc a WHERE a.root = src_root AND a.c = b.c)"
)
def added_deleted(spark, sf_dir):
    return diff.added_deleted(_pairs(spark, sf_dir), _contents(spark, sf_dir).filter("type = 'order'"))


@query(
    "WITH t AS (SELECT l_returnflag = 'R' AS e, l_linestatus = 'F' AS f FROM lineitem), n AS (SELECT count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM t) "
    'SELECT tp, fp, fn, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall FROM n'
)
def confusion(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("e"), (F.col("l_linestatus") == "F").alias("f"))
    return aggregates.confusion(lines, "e", "f")


@query()
def turn_edit_scripts(spark, sf_dir):
    """Edit scripts between consecutive turns of a conversation, as text."""
    pairs, occ = turn_trees(spark, sf_dir)
    return diff.script_text(diff.actions(pairs, occ, "simple"))


@query("SELECT conv_id || '.' || turn AS pair, a AS algorithm, true AS same FROM conversations CROSS JOIN (VALUES ('simple'), ('xy'), ('subtree')) v(a) WHERE turn > 0")
def turn_scripts_apply(spark, sf_dir):
    """Whether a turn after its edit script is the next turn: always, whichever algorithm links the trees."""
    pairs, occ = turn_trees(spark, sf_dir)
    occ, out = cut(occ), None
    for name in ("simple", "xy", "subtree"):
        rows = diff.verified(pairs, occ, name).withColumn("algorithm", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def turn_trees(spark, sf_dir):
    """Pairs of consecutive turns and their trees of lines and words."""
    from sylvan.sources.trees import parse

    c = load(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(".", "conv_id", "turn"))
    pairs = c.filter("turn > 0").select(F.col("key").alias("pair"), F.concat_ws(".", F.col("conv_id"), F.col("turn") - 1).alias("src_root"), F.col("key").alias("dst_root"))
    return pairs, navigation.without_spaces(parse(c, "key", "text", "text"))
