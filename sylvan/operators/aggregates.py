"""Mergeable aggregates over metric values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """The least value whose cumulative count reaches floor(q * n), by key.

    Counts by value are aggregated first, so the window runs over distinct values.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    every, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(value)
    seen = counts.withColumn("__seen", F.sum("__n").over(run)).withColumn("__all", F.sum("__n").over(every))
    return seen.filter(F.col("__seen") >= F.floor(F.lit(q) * F.col("__all"))).groupBy(*keys).agg(F.min(value).alias(name))


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, min, q1, median, q3, max by key; min is the true minimum."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    every, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(value)
    seen = counts.withColumn("__seen", F.sum("__n").over(run)).withColumn("__all", F.sum("__n").over(every))
    at = lambda q: F.min(F.when(F.col("__seen") >= F.floor(F.lit(q) * F.col("__all")), F.col(value)))
    return seen.groupBy(*keys).agg(
        F.sum("__n").alias("count"),
        (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"),
        F.min(value).alias("min"),
        at(0.25).alias("q1"),
        at(0.5).alias("median"),
        at(0.75).alias("q3"),
        F.max(value).alias("max"),
    )


def named(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """A map of name -> sum of value, by key."""
    sums = df.groupBy(*keys, name).agg(F.sum(value).alias("__s"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "__s")))).alias("values"))


def confusion(pairs: DataFrame, expected: str, found: str) -> DataFrame:
    """tp, fp, fn, precision and recall of two boolean columns."""
    e, f = F.coalesce(F.col(expected), F.lit(False)), F.coalesce(F.col(found), F.lit(False))
    n = pairs.agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))
    return n.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def compare_relations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(side, n): how many keys are exact, left only, right only."""
    both = left.select(*keys).distinct().withColumn("__l", F.lit(1)).join(right.select(*keys).distinct().withColumn("__r", F.lit(1)), keys, "full_outer")
    side = F.when(F.col("__r").isNull(), "left").when(F.col("__l").isNull(), "right").otherwise("exact")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def mean_scores(pairs: DataFrame, keys: list[str], expected: str, found: str) -> DataFrame:
    """Precision and recall as means over groups (macro): groups without a finding or expectation don't count."""
    e, f = F.coalesce(F.col(expected), F.lit(False)), F.coalesce(F.col(found), F.lit(False))
    n = pairs.groupBy(*keys).agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))
    share = lambda other: F.avg(F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0)))
    return n.agg(share("fp").alias("precision"), share("fn").alias("recall"))


def finalised(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """(first of path, estimates): nested containers of a path as one map from its names to count and mean.

    What scripts gather in containers of containers is a group by the whole path here; the
    map has a key for each path below the first level, joined by slashes, "" for all.
    """
    top, rest = path[0], path[1:]
    rows = df.rollup(*path).agg(F.count(value).alias("count"), F.avg(value).alias("mean")).filter(F.col(top).isNotNull())
    name = F.concat_ws("/", *rest) if rest else F.lit("")
    return rows.groupBy(top).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("name"), F.struct("count", "mean").alias("estimate"))))).alias("estimates"))
