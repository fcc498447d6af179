"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a fixed shuffled order. A document's virtual finish
time is the source's cumulative words divided by the source's weight; the mix is all
documents in the order of these times until the budget of words is spent. A source that
runs dry starts again, at most `epochs` times in all, so what it can't fill goes to the
others by weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.llm.common import cut, key_bin, table, text_key, word_count

#: Rows that one window task sorts, about, and ranges of virtual time summed together.
ROWS_PER_BIN, RANGES = 10_000, 4096


@dataclass(frozen=True)
class Mix:
    """weights are dealt to the sources in code-point order, null last, again and again."""

    weights: tuple[int, ...] = (5, 2, 1)
    epochs: int = 3
    budget_share: float = 1.0


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Weight, size and target of each source of sizes(source, size, times): times rows of size in all.

    Targets share the budget by weight; none exceeds `epochs` times its source's size, and
    the excess is shared again by weight. With sources in the order of the virtual time at
    which they run dry, the level at which this ends is the largest of the levels of the
    prefixes, as the filled amount is a concave function of the level. The windows without
    a key run over one row for each source, after aggregation.
    """
    per = sizes.groupBy(F.col("source").isNull().alias("unknown"), "source").agg(F.sum("size").alias("source_size"), F.sum("times").alias("source_docs"))
    weights = F.array(*map(F.lit, mix.weights))
    ranked = per.withColumn("weight", F.element_at(weights, (F.row_number().over(Window.orderBy("unknown", "source")) - 1) % len(mix.weights) + 1))
    ranked = ranked.withColumn("full", F.col("source_size") * mix.epochs)
    dry = Window.orderBy(F.col("full") / F.col("weight"), "unknown", "source")
    before, every = dry.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(every) * F.lit(mix.budget_share)
    level = (budget - F.coalesce(F.sum("full").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        ranked.withColumns({"level": level, "budget": budget.cast("double")})
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("full").cast("double"), F.col("level") * F.col("weight")))
        .drop("full")
    )


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of docs(doc_id, source, text): doc_id, source, size, source_size, target, copies, taken, key.

    copies: how often the mix takes the document (0 to epochs); taken: copies * size. Whole
    documents are taken, so a source comes within its longest documents of its target. Rows
    without a word (null or empty text) are returned with 0 copies. A null source is a source
    of its own, last in order; a null doc_id is shuffled like any other, by its text. Rows
    equal in source, doc_id and text stand side by side in the order: they are counted before
    anything is sorted, so no id, however common, fills a window. Other columns are ignored.
    An empty table gives no rows.
    """
    every = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = cut(every.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("times")))
    targets = source_targets(rows.select("source", (F.col("size") * F.col("times")).alias("size"), "times"), mix)
    # At most one row for each source; its size decides how Spark joins it.
    rows = rows.withColumn("unknown", F.col("source").isNull())
    largest = targets.agg(F.max("source_docs"), F.max("level"), F.max("budget")).first()
    if largest[0] is None:
        return rows.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"), "key")
    bins = max(1, -(-largest[0] // ROWS_PER_BIN))
    rows = rows.withColumn("bin", key_bin(F.col("key"), bins))

    # Cumulative size in each source: sums of whole bins, then rows within a bin.
    by_bin = rows.groupBy("unknown", "source", "bin").agg(F.sum(F.col("size") * F.col("times")).alias("bin_size"))
    earlier = Window.partitionBy("unknown", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bin.withColumn("offset", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
    same = [F.col("r.unknown") == F.col("o.unknown"), F.col("r.source").eqNullSafe(F.col("o.source")), F.col("r.bin") == F.col("o.bin")]
    within = Window.partitionBy("unknown", "source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.alias("r").join(offsets.alias("o"), same).select("r.*", "o.offset").withColumn("before", F.col("offset") + F.sum(F.col("size") * F.col("times")).over(within) - F.col("size") * F.col("times"))
    owned = [F.col("q.unknown") == F.col("t.unknown"), F.col("q.source").eqNullSafe(F.col("t.source"))]
    queued = queued.alias("q").join(targets.alias("t"), owned).select("q.doc_id", "q.source", "q.unknown", "q.key", "q.size", "q.times", "q.before", "t.source_size", "t.weight", "t.target")
    queued = queued.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("served", F.col("before") + F.col("nth") * F.col("size"))
    finish = F.transform(F.sequence(F.lit(0), F.lit(mix.epochs - 1)), lambda e: (e * F.col("source_size") + F.col("served")) / F.col("weight"))
    queued = cut(queued.withColumn("finish", F.when(F.col("size") > 0, finish).otherwise(F.array().cast("array<double>"))))

    # The range of virtual time in which the budget ends: all before it is taken, all after is not.
    level, budget, n = largest[1], largest[2], queued.count()
    ranges = max(1, -(-n // ROWS_PER_BIN))
    where = lambda v: F.floor(F.least(v / F.lit(level), F.lit(4.0)) * ranges).cast("int")
    entries = queued.select("*", F.posexplode("finish").alias("epoch", "at")).withColumn("range", where(F.col("at")))
    # Sums of RANGES ranges each, then of the ranges in the one of these where the budget ends.
    sums = cut(entries.groupBy("range").agg(F.sum("size").alias("words")))
    wide = sums.groupBy(F.floor(F.col("range") / RANGES).alias("part")).agg(F.sum("words").alias("words"))
    passed = lambda order, start: F.sum("words").over(Window.orderBy(order)) + F.lit(start)
    crossing = lambda df, order, start: df.withColumn("through", passed(order, start)).filter(F.col("through") > F.lit(budget)).agg(F.min_by(F.struct(order, (F.col("through") - F.col("words")).alias("before")), order)).first()[0]
    part = crossing(wide, "part", 0)
    end = None if part is None else crossing(sums.filter(F.floor(F.col("range") / RANGES) == part["part"]), "range", part["before"])
    place = ["at", "unknown", "source", "key", "doc_id", "epoch"]
    if end is None:
        taken_at = F.lit(True)
        last = None
    else:
        running = F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
        last = entries.filter(F.col("range") == end["range"]).withColumn("total", running + F.lit(end["before"])).filter(F.col("total") <= F.lit(budget)).agg(F.max(F.struct(*place, "range"))).first()[0]
        taken_at = None

    def is_taken(v, epoch):
        if taken_at is not None:
            return taken_at
        earlier_range = where(v) < F.lit(end["range"])
        if last is None:
            return earlier_range
        mine = F.struct(v.alias("at"), F.col("unknown"), F.coalesce("source", F.lit("")).alias("source"), F.col("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), epoch.cast("int").alias("epoch"))
        cutoff = F.struct(F.lit(last["at"]).alias("at"), F.lit(last["unknown"]).alias("unknown"), F.lit(last["source"] or "").alias("source"), F.lit(last["key"]).alias("key"), F.lit(last["doc_id"] or 0).cast("long").alias("doc_id"), F.lit(last["epoch"]).cast("int").alias("epoch"))
        return earlier_range | ((where(v) == F.lit(end["range"])) & (mine <= cutoff))

    copies = F.size(F.filter("finish", is_taken))
    return queued.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with the columns of docs.

    Documents without a word go: the mix takes words. Rows equal in id, source and text are
    taken as often as the most taken of them; rows that share an id but differ in text, or
    have none, are documents of their own. An empty table gives no rows.
    """
    taken = mix_sources(docs, mix).filter("copies > 0").groupBy(F.col("key").alias("__key"), F.col("source").alias("__source")).agg(F.max("copies").alias("__copies"))
    mine = (text_key(F.col("doc_id"), F.col("text")) == F.col("__key")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = docs.join(taken, mine)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: how much of every document the mix takes."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, source, source IS NULL AS unknown, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT unknown, source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY unknown, source) - 1) % 3 + 1] AS weight FROM d GROUP BY 1, 2
), lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER dry, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER dry, 0)) AS lv FROM per
  WINDOW dry AS (ORDER BY (3 * source_size)::DOUBLE / weight, unknown, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least((3 * source_size)::DOUBLE, max(lv) OVER () * weight) AS target, sum(source_size) OVER () AS budget FROM lev
), q AS MATERIALIZED (
  SELECT d.*, t.source_size, t.weight, t.target, t.budget, sum(size) OVER (PARTITION BY d.unknown, d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM d JOIN t ON d.unknown = t.unknown AND d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT row, size, budget, sum(size) OVER (ORDER BY (epoch * source_size + served)::DOUBLE / weight, unknown, source, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS total
  FROM q CROSS JOIN (VALUES (0), (1), (2)) AS ep(epoch) WHERE size > 0
), k AS (SELECT row, count(*) AS copies FROM e WHERE total <= budget GROUP BY 1)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(copies, 0) * q.size)::BIGINT AS taken FROM q LEFT JOIN k USING (row)
"""
