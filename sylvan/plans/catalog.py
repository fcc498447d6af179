"""Registered queries of the engine's own operators, and their SQL.

The driver's tables stand for code histories: customers are trees of orders and lines, a
customer's orders (or a conversation's turns) are a history, parts are declarations and
lines their uses, pages and event properties are texts to parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions.scalars import identifier_format, qgram_similarity, summarize_border, summarize_center, text_similarity, without_comments
from sylvan.operators import aggregates, diff, graph, history, metrics, mining, navigation, patterns, references, serialize
from sylvan.operators.lineage import cut
from sylvan.sources.parsers import json_tree
from sylvan.sources.trees import distinct_contents, encode, order_forest, parse, reprinted
from sylvan.streaming import feed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The forest in SQL.
FOREST = """
li AS MATERIALIZED (
  SELECT o_custkey AS root, l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), n_li AS MATERIALIZED (SELECT l_orderkey, count(*) AS n FROM li GROUP BY 1
), od AS MATERIALIZED (
  SELECT o_custkey AS root, o_orderkey, o_orderstatus, o_orderdate, coalesce(n, 0) + 1 AS size, row_number() OVER w - 1 AS pos,
         1 + coalesce(sum(coalesce(n, 0) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM orders LEFT JOIN n_li ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), cu AS MATERIALIZED (SELECT c_custkey AS root, c_mktsegment, 1 + coalesce(sum(size), 0) AS size, coalesce(max(CASE WHEN size > 1 THEN 2 ELSE 1 END), 0) AS height FROM customer LEFT JOIN od ON root = c_custkey GROUP BY 1, 2
), occ AS MATERIALIZED (
  SELECT root, 0::BIGINT AS pre, NULL::BIGINT AS parent, 0::BIGINT AS pos, 0 AS depth, size::BIGINT AS size, height::INT AS height, 'customer' AS type, c_mktsegment AS label FROM cu
  UNION ALL SELECT root, pre::BIGINT, 0, pos, 1, size::BIGINT, CASE WHEN size > 1 THEN 1 ELSE 0 END, 'order', o_orderstatus FROM od
  UNION ALL SELECT li.root, (od.pre + 1 + li.pos)::BIGINT, od.pre::BIGINT, li.pos, 2, 1, 0, 'lineitem', l_returnflag FROM li JOIN od ON l_orderkey = o_orderkey
)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Trees and navigation


@query(f"WITH {FOREST} SELECT root, pre, parent, pos, depth, size, height, type, label FROM occ")
def tree_occurrences(spark, sf_dir):
    return order_forest(spark, sf_dir).select("root", "pre", "parent", "pos", "depth", "size", "height", "type", "label")


@query(f"WITH {FOREST} SELECT root, pos AS version, size, size - lag(size) OVER (PARTITION BY root ORDER BY pos) AS growth, (sum(size) OVER (PARTITION BY root ORDER BY pos))::BIGINT AS total FROM occ WHERE type = 'order'")
def tree_metrics_by_version(spark, sf_dir):
    orders = order_forest(spark, sf_dir).filter("type = 'order'")
    w = Window.partitionBy("root").orderBy("pos")
    return orders.select("root", F.col("pos").alias("version"), "size", (F.col("size") - F.lag("size").over(w)).alias("growth"), F.sum("size").over(w).alias("total"))


@query(f"WITH {FOREST} SELECT d.root, d.pre, a.pre AS ancestor, a.type AS ancestor_type, d.depth - a.depth AS up FROM occ d JOIN occ a ON a.root = d.root AND d.pre > a.pre AND d.pre < a.pre + a.size WHERE d.type = 'lineitem'")
def ancestors_of_lines(spark, sf_dir):
    occ = order_forest(spark, sf_dir)
    return navigation.ancestors(occ, occ.filter("type = 'lineitem'"))


@query(f"WITH {FOREST} SELECT a.root, a.pre, count(*) AS descendants FROM occ a JOIN occ d ON a.root = d.root AND d.pre > a.pre AND d.pre < a.pre + a.size GROUP BY 1, 2")
def descendants_by_interval(spark, sf_dir):
    occ = order_forest(spark, sf_dir)
    return navigation.descendants(occ, occ.filter("size > 1")).groupBy("root", "pre").agg(F.count("*").alias("descendants"))


@query(f"WITH {FOREST} SELECT root, pre, pre + size - 1 - depth AS post, pre + size - 1 - depth - size + 1 AS lld FROM occ")
def postorder_and_leftmost_leaf(spark, sf_dir):
    return navigation.leftmost_leaf(order_forest(spark, sf_dir)).select("root", "pre", "post", "lld")


@query(f"WITH {FOREST} SELECT root, pre - depth AS lld, max(pre + size - 1 - depth) AS post FROM occ GROUP BY 1, 2")
def key_roots(spark, sf_dir):
    return navigation.key_roots(order_forest(spark, sf_dir))


@query(f"WITH {FOREST} SELECT root, pre, row_number() OVER (PARTITION BY root ORDER BY depth, pre) - 1 AS bfs FROM occ")
def breadth_first_order(spark, sf_dir):
    return navigation.breadth_first(order_forest(spark, sf_dir)).select("root", "pre", "bfs")


@query(f"WITH {FOREST} SELECT root, parent AS pre, max_by(pre, pos) AS child, max(pos) AS pos FROM occ WHERE parent IS NOT NULL GROUP BY 1, 2")
def last_children(spark, sf_dir):
    return navigation.child_at(order_forest(spark, sf_dir), -1).select("root", "pre", "child", "pos")


@query(f"WITH {FOREST} SELECT o.root, o.pre, CASE o.depth WHEN 0 THEN '' WHEN 1 THEN o.pos::VARCHAR ELSE p.pos || '/' || o.pos END AS path FROM occ o LEFT JOIN occ p ON p.root = o.root AND p.pre = o.parent")
def node_paths(spark, sf_dir):
    return navigation.paths(order_forest(spark, sf_dir)).select("root", "pre", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


# Metrics and aggregates


@query(f"WITH {FOREST} SELECT a.root, a.pre, count(*) FILTER (d.label = 'R') + 1 AS mcc FROM occ a JOIN occ d ON a.root = d.root AND d.pre >= a.pre AND d.pre < a.pre + a.size GROUP BY 1, 2")
def complexity(spark, sf_dir):
    """Forks are returned lines: the type column carries the label, as forks are types."""
    occ = cut(order_forest(spark, sf_dir).withColumn("type", F.coalesce("label", "type")))
    return metrics.mcc(occ, ["R"]).select("root", "pre", "mcc")


@query(f"WITH {FOREST} SELECT a.root, a.pre, (bit_or(CASE d.label WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'O' THEN 4 ELSE 0 END))::INT AS bits FROM occ a JOIN occ d ON a.root = d.root AND d.pre >= a.pre AND d.pre < a.pre + a.size GROUP BY 1, 2")
def precomputed_bits(spark, sf_dir):
    label = F.col("label")
    return metrics.precomputed_bits(cut(order_forest(spark, sf_dir)), [label == "R", label == "A", label == "O"]).select("root", "pre", "bits")


@query(
    f"""WITH {FOREST}, h0 AS (SELECT root, pre, parent, pos, sha256('lineitem' || chr(31) || label) AS h FROM occ WHERE type = 'lineitem'),
h1 AS (SELECT o.root, o.pre, o.pos, sha256('order' || chr(31) || o.label || CASE WHEN count(h) = 0 THEN '' ELSE chr(29) || string_agg(h, chr(30) ORDER BY h0.pos) END) AS h FROM occ o LEFT JOIN h0 ON h0.root = o.root AND h0.parent = o.pre WHERE o.type = 'order' GROUP BY o.root, o.pre, o.pos, o.label),
h2 AS (SELECT c.root, sha256('customer' || chr(31) || c.label || CASE WHEN count(h) = 0 THEN '' ELSE chr(29) || string_agg(h, chr(30) ORDER BY h1.pos) END) AS h FROM occ c LEFT JOIN h1 ON h1.root = c.root WHERE c.type = 'customer' GROUP BY c.root, c.label),
every AS (SELECT 'lineitem' AS type, h FROM h0 UNION ALL SELECT 'order', h FROM h1 UNION ALL SELECT 'customer', h FROM h2)
SELECT type, count(*) AS nodes, count(DISTINCT h) AS distinct_nodes FROM every GROUP BY 1"""
)
def deduplication(spark, sf_dir):
    occ = cut(order_forest(spark, sf_dir))
    return occ.join(metrics.merkle(occ, levels=2), ["root", "pre"]).groupBy("type").agg(F.count("*").alias("nodes"), F.countDistinct("content").alias("distinct_nodes"))


@query(
    """WITH c AS (SELECT l_returnflag AS flag, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY flag ORDER BY v) AS seen, sum(n) OVER (PARTITION BY flag) AS t FROM c)
SELECT flag, sum(n)::BIGINT AS count, round(sum(v * n) / sum(n), 6) AS mean, min(v) AS min, min(v) FILTER (seen >= floor(0.25 * t)) AS q1, min(v) FILTER (seen >= floor(0.5 * t)) AS median, min(v) FILTER (seen >= floor(0.75 * t)) AS q3, max(v) AS max FROM r GROUP BY 1"""
)
def metric_statistics(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("v"))
    return aggregates.statistics(rows, ["flag"], "v").withColumn("mean", F.round("mean", 6))


@query("WITH c AS (SELECT l_shipdate AS day, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY day ORDER BY v) AS seen, sum(n) OVER (PARTITION BY day) AS t FROM c) SELECT day, min(v) AS q FROM r WHERE seen >= floor(0.9 * t) GROUP BY 1")
def metric_quantile(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("day"), F.col("l_quantity").alias("v"))
    return aggregates.quantile(rows, ["day"], "v", 0.9, "q")


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def path_totals(spark, sf_dir):
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return metrics.path_totals(c, ["r_name", "n_name", "c_mktsegment"], "c_acctbal").select("r_name", "n_name", "c_mktsegment", "n", F.round("total", 2).alias("total"))


@query("SELECT o_custkey AS root, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT o_custkey, o_orderstatus || ':' || count(*) AS k FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY 1")
def named_containers(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderstatus").alias("name"), F.lit(1).alias("v"))
    entries = F.transform(F.map_entries("values"), lambda e: F.concat_ws(":", e.key, e.value.cast("string")))
    return aggregates.named(rows, ["root"], "name", "v").select("root", F.array_join(F.array_sort(entries), ",").alias("names"))


# Patterns


def _per_nation(spark, sf_dir, found):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"), "c_nationkey")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return found.join(c, "root").join(n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("matches"))


@query(f"WITH {FOREST} SELECT n_name, count(*) AS matches FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN occ a ON a.root = c_custkey AND a.type = 'lineitem' AND a.label = 'R' JOIN occ b ON b.root = a.root AND b.parent = a.parent AND b.pos = a.pos + 1 GROUP BY 1")
def pattern_adjacent(spark, sf_dir):
    return _per_nation(spark, sf_dir, patterns.matches(order_forest(spark, sf_dir), '(customer (order (lineitem) @a . (lineitem) @b (#eq? @a "R")))'))


@query(f"WITH {FOREST} SELECT a.root, a.parent AS at, a.pre AS a, b.pre AS b FROM occ a JOIN occ b ON b.root = a.root AND b.parent = a.parent AND b.pos > a.pos JOIN occ o ON o.root = a.root AND o.pre = a.parent WHERE o.type = 'order' AND a.label = b.label AND a.type = 'lineitem'")
def pattern_equal_captures(spark, sf_dir):
    found = patterns.matches(order_forest(spark, sf_dir), "(order (lineitem) @a (lineitem) @b (#eq? @a @b))")
    return found.select("root", "at", graph.captured(found, "a").alias("a"), graph.captured(found, "b").alias("b"))


@query(f"WITH {FOREST} SELECT root, parent AS at, pre AS x FROM occ WHERE (type = 'lineitem' AND label IN ('R', 'A')) OR (type = 'order' AND label ~ '^[FP]')")
def pattern_alternation(spark, sf_dir):
    found = patterns.matches(order_forest(spark, sf_dir), '(_ [(order (#MATCH? "^[FP]")) (lineitem (#ANY "R" "A"))] @x)')
    return found.select("root", "at", graph.captured(found, "x").alias("x"))


@query(f"WITH {FOREST}, k AS (SELECT root, parent, min(pos) AS lo, max(pos) AS hi FROM occ WHERE type = 'lineitem' GROUP BY 1, 2) SELECT a.root, a.parent AS at, a.pre AS first, b.pre AS last FROM k JOIN occ a ON a.root = k.root AND a.parent = k.parent AND a.pos = lo JOIN occ b ON b.root = k.root AND b.parent = k.parent AND b.pos = hi WHERE hi > lo")
def pattern_first_and_last(spark, sf_dir):
    found = patterns.matches(order_forest(spark, sf_dir), "(order . (lineitem) @first (lineitem) @last .)")
    return found.select("root", "at", graph.captured(found, "first").alias("first"), graph.captured(found, "last").alias("last"))


@query(f"WITH {FOREST} SELECT o.root, o.pre AS at, l.pre AS l FROM occ o LEFT JOIN occ l ON l.root = o.root AND l.parent = o.pre AND l.label = 'R' WHERE o.type = 'order'")
def pattern_optional(spark, sf_dir):
    found = patterns.matches(order_forest(spark, sf_dir), '(order (lineitem (#EQ? "R"))? @l)')
    return found.select("root", "at", graph.captured(found, "l").alias("l"))


@query(f"WITH {FOREST}, p AS (SELECT root, 0 AS pattern, count(*) AS n FROM occ WHERE type = 'order' AND size = 1 GROUP BY 1 UNION ALL SELECT root, 1, count(*) FROM occ WHERE type = 'lineitem' GROUP BY 1) SELECT c.root, i.pattern, coalesce(n, 0) AS matches FROM cu c CROSS JOIN (VALUES (0), (1)) i(pattern) LEFT JOIN p ON p.root = c.root AND p.pattern = i.pattern")
def pattern_counts(spark, sf_dir):
    occ = order_forest(spark, sf_dir)
    role = occ.withColumn("role", F.when(F.col("type") == "lineitem", "line"))
    return patterns.counts(role, "(order !line) (lineitem)")


@query(f"WITH {FOREST}, m AS (SELECT root, count(*) AS n FROM occ WHERE type = 'lineitem' AND label = 'R' GROUP BY 1) SELECT root, n AS matches FROM m")
def pattern_with_precomputed_skip(spark, sf_dir):
    occ = metrics.precomputed_bits(cut(order_forest(spark, sf_dir)), [F.col("label") == "R"])
    return patterns.matches(patterns.skip_by_bits(occ, "bits", 1), '(lineitem) @a (#eq? @a "R")').groupBy("root").agg(F.count("*").alias("matches"))


@query(f"WITH {FOREST} SELECT o.root, o.pre || '.def' AS src, l.pre || '.use' AS dst FROM occ o JOIN occ l ON l.root = o.root AND l.parent = o.pre WHERE l.label = 'R'")
def graph_from_matches(spark, sf_dir):
    stanza = graph.Stanza('(order (lineitem (#EQ? "R")) @l) @o', {"o": ["def"], "l": ["use"]}, [(("o", "def"), ("l", "use"))])
    return graph.build(order_forest(spark, sf_dir), [stanza])[1]


# History


def _line_versions(spark, sf_dir):
    """(chain, rank, place, content): lines of a customer's successive orders."""
    orders = history.ranked(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), "o_orderkey", "o_orderdate"), "chain", ["o_orderdate", "o_orderkey"])
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("place"), F.col("l_returnflag").alias("content")).distinct()
    return orders.join(lines, "o_orderkey").select("chain", "rank", "place", "content")


VERSIONS = """od AS (SELECT o_custkey AS chain, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders),
v AS (SELECT DISTINCT chain, rank, l_linenumber::BIGINT AS place, l_returnflag AS content FROM od JOIN lineitem ON l_orderkey = o_orderkey)"""


@query(f"WITH {VERSIONS} SELECT a.chain, a.rank AS a, b.rank AS b FROM od a JOIN od b ON a.chain = b.chain AND b.rank > a.rank AND b.rank < a.rank + 3")
def version_windows(spark, sf_dir):
    orders = history.ranked(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), "o_orderkey", "o_orderdate"), "chain", ["o_orderdate", "o_orderkey"])
    return history.windowed_pairs(orders, "chain", 3)


@query(
    f"""WITH {VERSIONS}, e AS (SELECT chain, max(rank) AS hi FROM v GROUP BY 1)
SELECT v.chain, v.rank, v.place, v.content, CASE WHEN v.rank = hi THEN 'last'
  WHEN EXISTS (SELECT 1 FROM v w WHERE w.chain = v.chain AND w.rank = v.rank + 1 AND w.content = v.content AND w.place = v.place) THEN 'direct'
  WHEN EXISTS (SELECT 1 FROM v w WHERE w.chain = v.chain AND w.rank = v.rank + 1 AND w.content = v.content) THEN 'moved'
  WHEN EXISTS (SELECT 1 FROM v w WHERE w.chain = v.chain AND w.rank = v.rank + 1 AND w.place = v.place) THEN 'changed' ELSE 'missing' END AS status
FROM v JOIN e USING (chain)"""
)
def track_elements(spark, sf_dir):
    return history.track(_line_versions(spark, sf_dir), "chain", "content", "place").select("chain", "rank", "place", "content", "status")


@query(f"WITH {VERSIONS}, d AS (SELECT DISTINCT chain, rank, content FROM v), r AS (SELECT *, rank - row_number() OVER (PARTITION BY chain, content ORDER BY rank) AS g FROM d), s AS (SELECT chain, rank, content, min(rank) OVER (PARTITION BY chain, content, g) AS since FROM r) SELECT v.chain, v.rank, v.place, v.content, since FROM v JOIN s USING (chain, rank, content)")
def blame_elements(spark, sf_dir):
    return history.blame(_line_versions(spark, sf_dir), "chain", "content").select("chain", "rank", "place", "content", "since")


@query(f"WITH {VERSIONS} SELECT chain, content, min(rank) AS first, max(rank) AS last, count(DISTINCT rank) AS times FROM v GROUP BY 1, 2")
def element_presence(spark, sf_dir):
    return history.presence(_line_versions(spark, sf_dir), "chain", "content")


@query("SELECT a.doc_id FROM documents a WHERE a.source = 'src0' AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.source = 'src1' AND md5(b.text) = md5(a.text))")
def differential_matches(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("content", F.md5("text"))
    return history.differential(d.filter("source = 'src0'"), d.filter("source = 'src1'")).select("doc_id")


@query("SELECT e.event_id, (SELECT max_by(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts) AS o_orderkey FROM events e")
def as_of_join(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return history.as_of(events, orders, "user_id", "ts", "o_orderdate", "o_orderkey").select("event_id", "o_orderkey")


# References


@query("SELECT p_partkey AS pre, p_name AS name, count(l_partkey) AS \"references\" FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2")
def reference_counts(spark, sf_dir):
    decls = load(spark, sf_dir, "part").select(F.lit(0).alias("root"), F.col("p_partkey").alias("pre"), F.col("p_name").alias("name"))
    used = load(spark, sf_dir, "lineitem").select(F.lit(0).alias("root"), F.col("l_partkey").alias("declared"))
    return references.reference_counts(decls, used).select("pre", "name", "references")


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE 'exact' END AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') l FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') r ON l.k = r.k) GROUP BY 1")
def relation_comparison(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey"))
    return aggregates.compare_relations(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), ["k"])


# Contents, scalars, windows in time


@query("SELECT count(*) AS contents, sum(n)::BIGINT AS rows FROM (SELECT sha256(text), count(*) AS n FROM documents GROUP BY 1)")
def content_store(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return distinct_contents(d, "text").agg(F.count("*").alias("contents")).withColumn("rows", F.lit(d.count()))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[a-z][a-z0-9]*$') THEN 'flat' WHEN regexp_matches(p_name, '^[A-Z][A-Z0-9]*$') THEN 'upper_flat' WHEN regexp_matches(p_name, '^[a-z][a-zA-Z0-9]*$') THEN 'camel' WHEN regexp_matches(p_name, '^[A-Z][a-zA-Z0-9]*$') THEN 'pascal' WHEN regexp_matches(p_name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(p_name, '^[A-Z0-9]+(_[A-Z0-9]+)+$') THEN 'screaming_snake' WHEN regexp_matches(p_name, '^[A-Z][a-z0-9]*(_[A-Z][a-z0-9]*)+$') THEN 'pascal_snake' WHEN regexp_matches(p_name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab' ELSE 'other' END AS format, CASE WHEN length(p_type) <= 9 THEN p_type ELSE left(p_type, 4) || '…' || right(p_type, 4) END AS short FROM part")
def scalar_functions(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", identifier_format(F.col("p_name")).alias("format"), summarize_center(F.col("p_type"), 9).alias("short"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_feed(spark, sf_dir):
    return feed.windowed_counts(load(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "1 hour")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, k")
def feed_sessions(spark, sf_dir):
    return feed.sessions(load(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")


# Parsed trees


@query("SELECT doc_id FROM documents")
def text_round_trip(spark, sf_dir):
    """Documents whose parsed leaves reprint their text: all of them. Each is compared where it is parsed."""
    return reprinted(load(spark, sf_dir, "documents"), "doc_id", "text", "text").filter("same").select(F.col("root").alias("doc_id"))


@query()
def html_metrics(spark, sf_dir):
    occ = parse(load(spark, sf_dir, "pages"), "page_id", "html", "html")
    loc = metrics.loc(occ).filter("pre = 0").select("root", "loc")
    return occ.filter("pre = 0").select("root", "size", "height").join(loc, "root")


@query(
    r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM pages),
u AS (SELECT page_id, unnest(h) AS h, unnest(t) AS t FROM l), w AS (SELECT page_id, h, unnest(string_split_regex(t, '&[a-z]+;')) AS t FROM u)
SELECT page_id AS root, 'href=' || replace(h, '&amp;', '&') AS href, t AS text FROM w WHERE trim(t) <> ''"""
)
def html_links(spark, sf_dir):
    """Links in lists, by a pattern with a role, as address and text."""
    occ = cut(parse(load(spark, sf_dir, "pages"), "page_id", "html", "html"))
    found = patterns.matches(occ, "(li (a href: (attribute) @href (text) @text))")
    label = lambda name: occ.select("root", F.col("pre").alias(name + "_pre"), F.col("label").alias(name))
    at = found.select("root", *(graph.captured(found, n).alias(n + "_pre") for n in ("href", "text")))
    return at.join(label("href"), ["root", "href_pre"]).join(label("text"), ["root", "text_pre"]).select("root", "href", "text")


@query(
    r"""WITH c AS (SELECT page_id, regexp_replace(html, '(<(script|style)>).*?(</)', '\1\3', 'g') AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS type FROM c UNION ALL SELECT page_id, unnest(list_transform(regexp_extract_all(h, ' [a-z]+="'), lambda x: 'attribute')) FROM c
UNION ALL SELECT page_id, unnest(list_transform(regexp_extract_all(regexp_replace(h, '<[^>]*>', '', 'g'), '&[a-z]+;'), lambda x: 'entity')) FROM c UNION ALL SELECT page_id, unnest(list_transform(regexp_extract_all(h, '<!--'), lambda x: 'comment')) FROM c)
SELECT page_id AS root, type, count(*) AS n FROM t GROUP BY 1, 2"""
)
def html_node_counts(spark, sf_dir):
    """How many nodes of each type parsed pages have: elements, attributes, entities, comments."""
    occ = parse(load(spark, sf_dir, "pages"), "page_id", "html", "html")
    return occ.filter(~F.col("type").isin("document", "text", "spaces", "doctype")).groupBy("root", "type").agg(F.count("*").alias("n"))


@query("SELECT sha256(props) AS root, '(object (pair ' || '\"' || regexp_extract(props, '\"([^\"]*)\"', 1) || '\" (number \"' || regexp_extract(props, ':\\s*([0-9]+)', 1) || '\")))' AS sexp FROM (SELECT DISTINCT props FROM events)")
def event_property_trees(spark, sf_dir):
    contents = distinct_contents(load(spark, sf_dir, "events"), "props")
    return serialize.sexpressions(parse(contents, "content", "props", "json"))


@query()
def turn_differences(spark, sf_dir):
    """Edit summaries of consecutive turns, as trees of lines and words."""
    c = load(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(".", "conv_id", "turn"))
    occ = navigation.without_spaces(parse(c, "key", "text", "text"))
    pairs = c.filter("turn > 0").select(F.col("key").alias("pair"), F.concat_ws(".", F.col("conv_id"), F.col("turn") - 1).alias("src_root"), F.col("key").alias("dst_root"))
    return diff.diff_pairs(pairs, occ, "simple")


@query("SELECT q AS query, level, n AS examples FROM (SELECT count(DISTINCT props) AS n FROM events) CROSS JOIN (VALUES ('(object (pair (number)))', 0), ('(object (pair))', 1), ('(object)', 2)) v(q, level)")
def mined_queries(spark, sf_dir):
    """Generalised queries over the shapes of event properties, with the examples they cover."""
    props = load(spark, sf_dir, "events").select("props").distinct()
    shaped = props.mapInPandas(_shapes, "example string, query string")
    nodes, edges = mining.lattice(shaped)
    return mining.support(shaped, nodes, edges)


def _shapes(frames):
    import pandas as pd

    for pdf in frames:
        out = []
        for text in pdf.props:
            rows = encode(json_tree(text or ""))
            tree = diff.Tree([r[7] for r in rows], [r[8] for r in rows], [r[1] for r in rows])
            out.append((text, mining.to_query(tree, labels=False)))
        yield pd.DataFrame(out, columns=["example", "query"])


_GRAMS = "list_transform(range(1, len({0}) - 1), lambda i: {0}[i:i + 2])"


@query(
    f"""WITH p AS (SELECT DISTINCT p_type, 'ECONOMY' AS e FROM part), g AS (SELECT p_type, list_distinct({_GRAMS.format('p_type')}) AS x, list_distinct({_GRAMS.format('e')}) AS y,
{_GRAMS.format("('##' || p_type || '##')")} AS a, {_GRAMS.format("('##' || e || '##')")} AS b FROM p)
SELECT p_type, CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) END AS dice,
CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE round(1 - list_sum(list_transform(list_distinct(a || b), lambda k: abs(len(list_filter(a, lambda q: q = k)) - len(list_filter(b, lambda q: q = k))))) / (len(a) + len(b)), 9) END AS qgram FROM g"""
)
def label_similarity(spark, sf_dir):
    """How alike labels are by common q-grams, as sets and as multisets with padded ends."""
    types = load(spark, sf_dir, "part").select("p_type").distinct()
    to = F.lit("ECONOMY")
    return types.select("p_type", F.round(qgram_similarity(F.col("p_type"), to), 9).alias("dice"), F.round(text_similarity(F.col("p_type"), to), 9).alias("qgram"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN p_name ELSE '…' || substr(p_name, (floor((length(p_name) - 7) / 2) + 1)::INT, 7) || '…' END AS middle, left(regexp_replace('(a) ; ' || p_name || chr(10) || '(b)', ';[^' || chr(10) || ']*', ''), 20) AS bare FROM part")
def shortened_names(spark, sf_dir):
    """Texts cut at both ends, query texts without comments."""
    p = load(spark, sf_dir, "part")
    bare = without_comments(F.concat(F.lit("(a) ; "), F.col("p_name"), F.lit("\n(b)")))
    return p.select("p_partkey", summarize_border(F.col("p_name"), 9).alias("middle"), F.left(bare, F.lit(20)).alias("bare"))


def queries() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same rows."""
    return dict(ORACLES)


from sylvan.plans import histories, java_views, pattern_views, service_views, tree_views  # noqa: E402,F401  they register their queries here
