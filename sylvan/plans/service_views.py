"""Registered queries of streams, budgets, estimates, removed smells and places to track."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sylvan.functions.scalars import pearson, pearson_table
from sylvan.operators import aggregates, diff, history, metrics, mining, serialize, smells, tracking
from sylvan.operators.lineage import cut
from sylvan.plans.catalog import FOREST, _shapes, load, query
from sylvan.plans.java_views import VERSIONS, examples, expected
from sylvan.sources.trees import order_forest, parse
from sylvan.streaming import feed


@query("SELECT sha256(text) AS content, min(length(text))::BIGINT AS n FROM documents GROUP BY 1")
def streamed_ingest(spark, sf_dir):
    """Documents read as a stream into a store keyed by content; a second run over the same files adds nothing."""
    cut(spark.range(1))  # sets the shared folder where none is
    base = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    for run in ("a", "b"):
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a glob, as a stream's source is a folder
        keyed = stream.select(F.sha2("text", 256).alias("content"), "text")
        feed.start_ingest(keyed, "content", f"{base}/store", f"{base}/{run}", lambda df: df.select("content", F.length("text").cast("long").alias("n"))).awaitTermination()
    return spark.read.parquet(f"{base}/store")


@query(expected("place, version, outcome", [(0, "v0", "ok"), (1, "v1", "bad"), (2, "v2", "ok"), (3, "v3", "bad"), (4, "v4", "ok")]))
def budgeted_versions(spark, sf_dir):
    """Versions one at a time; each error halves what is left of a budget of fifteen."""

    def run(_, v):
        if v in ("v1", "v3"):
            raise ValueError(v)
        return "ok"

    done = list(feed.per_version(spark, [f"v{i}" for i in range(20)], run, 15))[:5]
    return spark.createDataFrame([(i, v, "bad" if isinstance(x, ValueError) else x) for i, (v, x) in enumerate(done)], "place int, version string, outcome string")


@query(
    "WITH t AS (SELECT l_linestatus AS k, l_returnflag = 'R' AS e, l_quantity > 25 AS f FROM lineitem), n AS (SELECT k, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM t GROUP BY 1) "
    'SELECT round(avg(tp / nullif(tp + fp, 0)), 9) AS "precision", round(avg(tp / nullif(tp + fn, 0)), 9) AS recall FROM n'
)
def mean_precision_and_recall(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k"), (F.col("l_returnflag") == "R").alias("e"), (F.col("l_quantity") > 25).alias("f"))
    return aggregates.mean_scores(lines, ["k"], "e", "f").select(*(F.round(c, 9).alias(c) for c in ("precision", "recall")))


@query(
    "SELECT r_name, concat_ws('/', n_name, c_mktsegment) AS name, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment))"
)
def nested_estimates(spark, sf_dir):
    """Containers of containers as one map for each first level, with estimates."""
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = aggregates.finalised(c, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")
    return found.select("r_name", F.explode("estimates").alias("name", "e")).select("r_name", "name", F.col("e.count").alias("n"), F.round("e.mean", 6).alias("mean"))


@query(f"SELECT p_partkey, list_reduce(list_prepend(0, list_transform(string_split(p_name, ''), lambda c: unicode(c) & 255)), lambda h, c: ({pearson_table(5)})[xor(h, c) + 1])::INT AS hash FROM part")
def pearson_hashes(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", pearson(F.col("p_name"), 5).alias("hash"))


@query(
    f"WITH {FOREST}, l AS (SELECT root, parent, string_agg('(lineitem#' || pre || ')', ' ' ORDER BY pos) AS below FROM occ WHERE type = 'lineitem' GROUP BY 1, 2), o AS (SELECT occ.root, string_agg('(order#' || pre || coalesce(' ' || below, '') || ')', ' ' ORDER BY pos) AS below "
    "FROM occ LEFT JOIN l ON l.root = occ.root AND l.parent = occ.pre WHERE type = 'order' GROUP BY 1) SELECT occ.root, '(customer#0' || coalesce(' ' || below, '') || ')' AS sexp FROM occ LEFT JOIN o ON o.root = occ.root WHERE type = 'customer'"
)
def tree_structures(spark, sf_dir):
    """Structure with ids, without labels."""
    return serialize.sexpressions(order_forest(spark, sf_dir), labels=False, ids=True)


@query(expected("queries, edges, tops, bottoms, widest", [(3, 2, 1, 1, 1)]))
def lattice_shape(spark, sf_dir):
    """The lattice over event properties: a chain of three queries."""
    shaped = load(spark, sf_dir, "events").select("props").distinct().mapInPandas(_shapes, "example string, query string")
    nodes, edges = mining.lattice(shaped)
    return mining.lattice_statistics(nodes, edges)


@query("SELECT '(object (pair (number)))' AS query, count(DISTINCT props) AS examples FROM events")
def covering_queries(spark, sf_dir):
    """Of queries that cover the same examples the most special one."""
    shaped = cut(load(spark, sf_dir, "events").select("props").distinct().mapInPandas(_shapes, "example string, query string"))
    nodes, edges = mining.lattice(shaped)
    return mining.covering_tops(mining.support(shaped, nodes, edges), edges)


SMELLY = [
    ("t0", "class T { @Test void a() { Thread.sleep(1); } @Test void b() {} @Test void c() {} }"),
    ("t1", "class T { @Test void a() { go(); } @Test void b() {} @Test void c() {} }"),
    ("t2", "class T { @Test void a() { go(); } @Test void c() {} }"),
]


@query(expected("rank, smell, fate, n", [(0, "sleepy_test", "gone", 1), (1, "empty_test", "gone", 1)]))
def removed_smells(spark, sf_dir):
    """Smells that go from one version to the next: the sleep, then the empty test b."""
    occ = cut(parse(spark.createDataFrame(SMELLY, "k string, text string"), "k", "text", "java"))
    occ = cut(occ.join(metrics.merkle(occ), ["root", "pre"]))
    versions = spark.createDataFrame([("c", i, v) for i, (v, _) in enumerate(SMELLY)], "chain string, rank int, root string")
    gone = smells.removed(smells.find(occ, ["sleepy_test", "empty_test", "redundant_print"]), versions, occ)
    return gone.groupBy("rank", "smell", "fate").agg(F.count("*").alias("n"))


@query(expected("element, type, last_root, status, added, deleted", [("path", "method_declaration", "v2", "last", 14, 11), ("range", "method_invocation", "v2", "last", 14, 11)]))
def tracked_places(spark, sf_dir):
    """A node by its path and one by a range of text, followed to the last version, with what came and went on the way."""
    occ = tracking.hashed(parse(spark.createDataFrame(VERSIONS, "k string, text string"), "k", "text", "java"))
    versions = spark.createDataFrame([("c", i, v) for i, (v, _) in enumerate(VERSIONS)], "chain string, rank int, root string")
    text = VERSIONS[0][1]
    at = text.index("f(1)")
    paths = spark.createDataFrame([("path", "v0", [0, 4, 2])], "element string, root string, path array<int>")
    ranges = spark.createDataFrame([("range", "v0", at, at + 4)], "element string, root string, range_start int, range_end int")
    wanted = cut(tracking.at_path(occ, paths).unionByName(tracking.at_range(occ, ranges)))
    links = tracking.link_trees(tracking.successive(versions), occ, "greedy")
    found = tracking.with_changes(tracking.track(wanted, versions, links, occ), occ)
    kinds = occ.select("root", "pre", "type")
    return found.join(kinds, ["root", "pre"]).select("element", "type", "last_root", "status", F.size("added").cast("long").alias("added"), F.size("deleted").cast("long").alias("deleted"))


@query(expected("pair, kind, node, label, file", [("rename", "update", 2, "g", 0), ("delete", "delete", 2, None, 0), ("subdelete", "delete", 3, None, 0), ("subdelete", "delete", 2, None, 0)]))
def example_focuses(spark, sf_dir):
    """Where actions on source nodes act, with the root as the file around them."""
    pairs, occ = examples(spark)
    pairs = pairs.filter("pair IN ('rename', 'delete', 'subdelete')")
    occ = occ.withColumn("type", F.when(F.col("pre") == 0, "program").otherwise(F.col("type")))
    acts = diff.actions(pairs, occ, "simple")
    return diff.focus(acts, occ, pairs, ["update", "delete"], ["program"])


@query(expected("pair, kind, nodes", [("rename", "update", "2"), ("delete", "delete", "2"), ("subdelete", "delete", "2,3")]))
def example_sets(spark, sf_dir):
    """What pairs update and delete, as example sets for mining."""
    pairs, occ = examples(spark)
    found = diff.examples(diff.actions(pairs.filter("pair IN ('rename', 'delete', 'subdelete')"), occ, "simple"))
    return found.select("pair", "kind", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(expected("pair, script", [("rename", "update 2 g"), ("delete", "delete 2"), ("subdelete", "delete 3\ndelete 2")]))
def example_script_texts(spark, sf_dir):
    pairs, occ = examples(spark)
    return diff.script_text(diff.actions(pairs.filter("pair IN ('rename', 'delete', 'subdelete')"), occ, "simple"))


@query(f"WITH {FOREST} SELECT c.root, count(l.pre) AS lines, count(l.pre) FILTER (l.label = 'R') AS returned FROM occ c LEFT JOIN occ l ON l.root = c.root AND l.type = 'lineitem' WHERE c.pre = 0 GROUP BY 1")
def metric_scripts(spark, sf_dir):
    """Metrics given as SQL texts, two of them chained in one struct."""
    from sylvan.operators.metrics import MetricSpec

    spec = MetricSpec.of("struct(int(type = 'lineitem') AS n, int(type = 'lineitem' AND label = 'R') AS r)", "struct(sum(value.n) AS n, sum(value.r) AS r)", "struct(bigint(own.n + coalesce(acc, struct(0L AS n, 0L AS r)).n) AS n, bigint(own.r + coalesce(acc, struct(0L AS n, 0L AS r)).r) AS r)")
    found = metrics.bottom_up(order_forest(spark, sf_dir), spec, "m", levels=2).filter("pre = 0")
    return found.select("root", F.col("m.n").alias("lines"), F.col("m.r").alias("returned"))


@query("SELECT o_custkey AS chain, o_orderkey, row_number() OVER w AS place, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS best FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3")
def best_candidates(spark, sf_dir):
    """The three best of each chain (the limit is the feature), with the best of the next three versions."""
    from pyspark.sql import Window

    o = load(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(0, 2)
    ahead = o.withColumn("best", F.max("o_totalprice").over(w))
    ranked = history.ranked(ahead, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"]).filter("rank < 3")
    return ranked.select(F.col("o_custkey").alias("chain"), "o_orderkey", (F.col("rank") + 1).alias("place"), "best")

