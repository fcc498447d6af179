"""Registered queries over histories: walks, lookups, services per commit, tracking.

A customer's orders are a chain of commits; every third one is a merge of the two before it.
Customers of a nation are a chain of whole trees.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sylvan.engine import Config, Engine
from sylvan.functions.scalars import code_url, commit_time, diff_url
from sylvan.operators import history, mining, tracking
from sylvan.operators.lineage import cut
from sylvan.operators.metrics import MetricSpec
from sylvan.plans.catalog import FOREST, load, query
from sylvan.plans.tree_views import CONTENTS, _contents
from sylvan.sources.trees import order_forest

RANKED = """cm AS MATERIALIZED (SELECT o_custkey AS chain, o_orderkey::VARCHAR AS c, row_number() OVER w - 1 AS r, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2,
  lead(o_orderkey) OVER w AS nx, o_orderkey, o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edge AS MATERIALIZED (SELECT c, p1::VARCHAR AS p FROM cm WHERE p1 IS NOT NULL UNION ALL SELECT c, p2::VARCHAR FROM cm WHERE p2 IS NOT NULL AND r % 3 = 2)"""


def commits(spark, sf_dir):
    """commits(commit, parents, time, chain, rank) of the orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, sf_dir, "orders").withColumns({"rank": F.row_number().over(w) - 1, "p1": F.lag("o_orderkey").over(w), "p2": F.lag("o_orderkey", 2).over(w)})
    parents = F.filter(F.array(F.col("p1").cast("string"), F.when(F.col("rank") % 3 == 2, F.col("p2").cast("string"))), lambda x: x.isNotNull())
    return cut(o.select(F.col("o_orderkey").cast("string").alias("commit"), parents.alias("parents"), F.col("o_orderdate").alias("time"), F.col("o_custkey").alias("chain"), "rank"))


@query(f"WITH RECURSIVE {RANKED}, w(c, far) AS (SELECT c, 0 FROM cm WHERE nx IS NULL UNION SELECT p, far + 1 FROM w JOIN edge USING (c)) SELECT c AS \"commit\", min(far)::INT AS far FROM w GROUP BY 1")
def walk_from_all_tips(spark, sf_dir):
    return history.Walk(commits(spark, sf_dir)).commits().select("commit", "far")


@query(f"WITH {RANKED} SELECT c AS \"commit\", (max(r) OVER (PARTITION BY chain) - r)::INT AS far FROM cm")
def walk_first_parents(spark, sf_dir):
    return history.Walk(commits(spark, sf_dir)).first_parents().commits().select("commit", "far")


@query(
    f"""WITH RECURSIVE {RANKED}, mine AS (SELECT cm.* FROM cm JOIN customer ON c_custkey = chain WHERE c_nationkey = 0),
w(c, far) AS (SELECT c, 0 FROM mine WHERE nx IS NULL UNION SELECT p, far + 1 FROM w JOIN edge USING (c)),
h(c) AS (SELECT p FROM edge JOIN mine USING (c) WHERE r = 2 UNION SELECT p FROM h JOIN edge USING (c))
SELECT c AS "commit", min(far)::INT AS far FROM w WHERE c NOT IN (SELECT c FROM h) GROUP BY 1"""
)
def walk_ranges(spark, sf_dir):
    """A walk with many heads (the last orders of one nation's customers) and stops (their third orders), which stay themselves."""
    c = commits(spark, sf_dir)
    nation = load(spark, sf_dir, "customer").filter("c_nationkey = 0").select(F.col("c_custkey").alias("chain"))
    mine = c.join(nation, "chain").groupBy("chain").agg(F.max_by("commit", "rank").alias("head"), F.max(F.when(F.col("rank") == 2, F.col("commit"))).alias("stop")).collect()
    walk = history.Walk(c).after(*(r.head for r in mine)).before(*(r.stop for r in mine if r.stop is not None))
    return walk.commits().select("commit", "far")


@query(
    f"""WITH {RANKED}, t AS (SELECT CASE WHEN chain % 2 = 0 THEN (SELECT min(x.c) FROM cm x WHERE x.chain = cm.chain AND x.r = 0) ELSE 'v' || chain END AS tag, c FROM cm WHERE nx IS NULL),
n AS (SELECT c AS name FROM cm UNION SELECT tag FROM t UNION SELECT 'none')
SELECT name, coalesce(t.c, cm.c) AS "commit" FROM n LEFT JOIN t ON t.tag = name LEFT JOIN cm ON cm.c = name"""
)
def commit_lookup(spark, sf_dir):
    """Names of tags and commits; a tag may be named like a commit and goes first."""
    c = commits(spark, sf_dir)
    ends = c.groupBy("chain").agg(F.max_by("commit", "rank").alias("commit"), F.min_by("commit", "rank").alias("first"))
    tags = ends.select(F.when(F.col("chain") % 2 == 0, F.col("first")).otherwise(F.concat(F.lit("v"), F.col("chain").cast("string"))).alias("tag"), "commit")
    wanted = c.select(F.col("commit").alias("name")).union(tags.select("tag")).union(spark.range(1).select(F.lit("none"))).distinct()
    return history.find_commit(c, tags, wanted)


@query(
    "SELECT o_orderkey, strftime(o_orderdate + to_minutes(o_custkey % 60 - 30), '%Y-%m-%d %H:%M') AS local, 'https://forge/u/r/blob/' || o_orderkey || '/a.java#L1-L' || o_custkey AS url, "
    "'https://forge/u/r/compare/' || o_orderkey || '..' || o_custkey || '#diff-' || sha256('a.java') || 'R7' AS change FROM orders"
)
def commit_labels(spark, sf_dir):
    """Local times and addresses of commits."""
    o = load(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    local = commit_time(F.unix_timestamp("o_orderdate"), (F.col("o_custkey") % 60 - 30).cast("int"))
    url = code_url("https://forge", F.lit("u"), F.lit("r"), text("o_orderkey"), F.lit("a.java"), F.lit(1), F.col("o_custkey"))
    change = diff_url("https://forge", F.lit("u"), F.lit("r"), text("o_orderkey"), text("o_custkey"), F.lit("a.java"), F.lit(7))
    return o.select("o_orderkey", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local"), url.alias("url"), change.alias("change"))


NATION = """nat AS MATERIALIZED (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS far FROM customer),
walk AS MATERIALIZED (SELECT c_custkey, far FROM nat WHERE c_nationkey = 0),
per AS MATERIALIZED (SELECT root, count(*) FILTER (type = 'lineitem' AND label = 'R') AS returned, count(*) FILTER (type = 'order') AS orders FROM occ GROUP BY 1)"""


def engine(spark, sf_dir, config: Config | None = None) -> tuple[Engine, str]:
    """Customers of a nation as successive commits, and the head of the first nation's."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = load(spark, sf_dir, "customer").withColumn("before", F.lag("c_custkey").over(w))
    parents = F.filter(F.array(F.col("before").cast("string")), lambda x: x.isNotNull())
    history_ = cut(c.select(F.col("c_custkey").cast("string").alias("commit"), parents.alias("parents"), "c_nationkey"))
    head = c.filter("c_nationkey = 0").agg(F.max("c_custkey")).first()[0]
    root_of = c.select(F.col("c_custkey").cast("string").alias("commit"), F.col("c_custkey").alias("root"))
    made = Engine(history_, root_of, order_forest(spark, sf_dir), of=lambda roots: order_forest(spark, sf_dir, roots))
    return (made.register(config) if config else made), str(head)


QUERY = '(lineitem (#EQ? "R")) @l (order)'


@query(f"WITH {FOREST}, {NATION} SELECT c_custkey::VARCHAR AS \"commit\", i.pattern, CASE i.pattern WHEN 0 THEN returned ELSE orders END AS matches FROM walk JOIN per ON root = c_custkey CROSS JOIN (VALUES (0), (1)) i(pattern)")
def counts_by_commit(spark, sf_dir):
    """Matches of each pattern in every commit of a walk."""
    e, head = engine(spark, sf_dir)
    return e.query(QUERY, head).select("commit", F.posexplode("counts").alias("pattern", "matches"))


@query(f"WITH {FOREST}, {NATION} SELECT c_custkey::VARCHAR AS \"commit\", far, returned, orders FROM walk JOIN per ON root = c_custkey WHERE far < 40")
def streamed_counts(spark, sf_dir):
    """The first 40 commits (the limit is the feature) in the order of the walk, as they come."""
    e, head = engine(spark, sf_dir)
    rows = [(commit, i, *counts) for i, (commit, counts) in enumerate(e.query_stream(QUERY, head, limit=40, chunk=16))]
    return spark.createDataFrame(rows, "commit string, far long, returned long, orders long")


@query(f"WITH {FOREST}, {NATION} SELECT c_custkey::VARCHAR AS \"commit\", least(returned, 20) AS returned, least(orders, 20) AS orders, (CASE WHEN returned > 20 THEN 1 ELSE 0 END + CASE WHEN orders > 20 THEN 1 ELSE 0 END)::INT AS errors FROM walk JOIN per ON root = c_custkey")
def limited_counts(spark, sf_dir):
    """Counts up to a limit for each commit and pattern, with the number of patterns that had more."""
    e, head = engine(spark, sf_dir)
    found = e.compute(QUERY, head, max_matches=20)
    return found.select("commit", F.get("counts", F.lit(0)).alias("returned"), F.get("counts", F.lit(1)).alias("orders"), F.size("errors").alias("errors"))


@query(f"WITH {FOREST}, {NATION} SELECT c_custkey::VARCHAR AS \"commit\", returned::BIGINT AS value FROM walk JOIN per ON root = c_custkey")
def script_by_commit(spark, sf_dir):
    """A metric given as text, of every commit of a walk."""
    e, head = engine(spark, sf_dir)
    spec = MetricSpec.of("CASE WHEN type = 'lineitem' AND label = 'R' THEN 1 ELSE 0 END", "sum(value)", "own + coalesce(acc, 0)")
    return e.script(spec, "value", head)


@query(f"WITH {FOREST}, {NATION} SELECT root, bool_or(type = 'lineitem' AND label = 'R')::INT + 2 * bool_or(type = 'order' AND size = 1)::INT AS bits, sum(CASE WHEN type = 'order' THEN 1 ELSE 0 END)::BIGINT AS metric, (SELECT count(*) FROM walk) AS commits FROM occ GROUP BY 1")
def registered_config(spark, sf_dir):
    """What a configuration adds to roots at ingest: bits of precomputed patterns and a metric; and its number of commits."""
    spec = MetricSpec.of("CASE WHEN type = 'order' THEN 1 ELSE 0 END", "sum(value)", "own + coalesce(acc, 0)")
    line = F.when(F.col("type") == "lineitem", "line")
    e, head = engine(spark, sf_dir)
    e = Engine(e.commits, e.root_of, cut(e.occ.withColumn("role", line).drop("key", "up", "post"))).register(Config('(lineitem (#EQ? "R")) (order !line)', spec))
    return e.occ.filter("pre = 0").select("root", "bits", "metric").withColumn("commits", F.lit(e.commit_count(head)).cast("long"))


@query(f"WITH {FOREST} SELECT root, pre, type, label FROM occ WHERE (root, pre) IN (SELECT root, parent FROM occ WHERE label = 'R' AND type = 'lineitem')")
def fetched_nodes(spark, sf_dir):
    """Nodes by their ids: here the orders that hold a returned line."""
    e, _ = engine(spark, sf_dir)
    wanted = e.occ.filter("type = 'lineitem' AND label = 'R'").select("root", F.col("parent").alias("pre"))
    return e.fetch(wanted).select("root", "pre", "type", "label")


@query(f"WITH {FOREST} SELECT DISTINCT label FROM occ WHERE type <> 'customer' AND label IS NOT NULL")
def fetched_labels(spark, sf_dir):
    e, _ = engine(spark, sf_dir)
    return e.labels(e.occ.filter("type <> 'customer'"))


@query(f"WITH {RANKED}, later AS (SELECT chain, r, c, lead(c) OVER (PARTITION BY chain ORDER BY r) AS nx1 FROM cm) SELECT c AS \"commit\", nx1 AS next, ntile(4) OVER (PARTITION BY chain ORDER BY r)::INT AS quarter, dense_rank() OVER (PARTITION BY chain ORDER BY r)::INT AS place FROM later")
def ranked_commits(spark, sf_dir):
    """Places of commits in their chain: row numbers, dense ranks, quarters, the next one."""
    c = commits(spark, sf_dir)
    w = Window.partitionBy("chain").orderBy("rank")
    return c.select("commit", F.lead("commit").over(w).alias("next"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(w).alias("place"))


@query("SELECT o_custkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey)::BIGINT AS component, o_orderkey AS member FROM orders")
def chain_components(spark, sf_dir):
    """Connected components of commits by their parents: each chain is one."""
    c = commits(spark, sf_dir)
    edges = c.select(F.col("commit").cast("long").alias("src"), F.explode(F.col("parents").cast("array<long>")).alias("dst"))
    alone = c.select(F.col("commit").cast("long").alias("member"), F.col("chain").alias("node"))
    found = mining.groups(edges)
    return alone.join(found.withColumnRenamed("node", "member"), "member", "left").select("node", F.coalesce("component", "member").alias("component"), "member")


STEPS = 4
TRACKED = f"""{CONTENTS},
ver AS MATERIALIZED (SELECT c_nationkey AS chain, c_custkey AS root, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rank FROM customer),
top AS MATERIALIZED (SELECT root, label, size FROM occ WHERE pre = 0)"""


def _versions(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chain"), F.col("c_custkey").alias("root"), (F.row_number().over(w) - 1).alias("rank"))


@query(
    f"""WITH {TRACKED}, s AS (SELECT a.root, a.chain, a.rank, d.i, b.root AS at, t.label AS mine, u.label AS theirs, (SELECT max(x.rank) FROM ver x WHERE x.chain = a.chain) AS hi
  FROM ver a CROSS JOIN (VALUES (0), (1), (2), (3), (4)) d(i) JOIN ver b ON b.chain = a.chain AND b.rank = a.rank + d.i JOIN top t ON t.root = a.root JOIN top u ON u.root = b.root),
e AS (SELECT root, hi - min(rank) AS left_, min(i) FILTER (theirs <> mine) AS turn FROM s GROUP BY root, hi)
SELECT e.root AS element, ver2.root AS last_root, n.steps::INT AS steps, n.status FROM e JOIN ver v ON v.root = e.root,
LATERAL (SELECT CASE WHEN turn IS NOT NULL THEN turn WHEN left_ < {STEPS} THEN left_ ELSE {STEPS} END AS steps, CASE WHEN turn IS NOT NULL THEN 'changed' WHEN left_ < {STEPS} THEN 'last' ELSE 'stopped' END AS status) n
JOIN ver ver2 ON ver2.chain = v.chain AND ver2.rank = v.rank + n.steps"""
)
def tracked_roots(spark, sf_dir):
    """Every customer's root followed through at most four later customers of its nation, until its label changes."""
    occ = _contents(spark, sf_dir)
    occ = occ.withColumn("shape", F.col("content"))
    versions = _versions(spark, sf_dir)
    pairs = tracking.successive(versions)
    links = pairs.select("pair", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    wanted = versions.select(F.col("root").alias("element"), "root", F.lit(0).alias("pre"))
    found = tracking.track(wanted, versions, links, occ, watch=["upd"], max_steps=STEPS)
    return found.select("element", "last_root", "steps", "status")


@query(
    f"""WITH {TRACKED}, pr AS (SELECT a.root AS src_root, b.root AS dst_root FROM ver a JOIN ver b ON a.chain = b.chain AND b.rank = a.rank + 1)
SELECT o.root, o.pre, p.dst_root AS next_root, CASE WHEN p.dst_root IS NULL THEN NULL WHEN o.pos < n.orders THEN (SELECT x.pre FROM occ x WHERE x.root = p.dst_root AND x.depth = 1 AND x.pos = o.pos) ELSE 0 END AS next_pre,
  CASE WHEN p.dst_root IS NULL THEN 'last' WHEN o.pos < n.orders THEN 'direct' ELSE 'missing' END AS status
FROM occ o LEFT JOIN pr p ON p.src_root = o.root LEFT JOIN (SELECT root, count(*) FILTER (depth = 1) AS orders FROM occ GROUP BY 1) n ON n.root = p.dst_root WHERE o.depth = 1"""
)
def followed_with_fallback(spark, sf_dir):
    """Orders followed by place into the next customer of the nation; those beyond its last fall back to the root."""
    occ = cut(order_forest(spark, sf_dir))
    pairs = cut(tracking.successive(_versions(spark, sf_dir)))
    spot = occ.filter("depth < 2").select("root", "depth", "pos", "pre")
    a = pairs.join(spot.withColumnsRenamed({"root": "src_root", "pre": "src"}), "src_root")
    links = a.join(spot.withColumnsRenamed({"root": "dst_root", "pre": "dst"}), ["dst_root", "depth", "pos"]).select("pair", "src", "dst")
    return history.follow(occ.filter("depth = 1"), pairs, links, occ)
