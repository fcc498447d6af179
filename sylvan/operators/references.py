"""Uses and declarations: who refers to what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def declarations(occ: DataFrame, types: list[str]) -> DataFrame:
    """(root, pre, size, name, name_pre): nodes of the types with the text of their child named `name`."""
    named = occ.filter(F.col("role") == "name").select("root", F.col("parent").alias("pre"), F.col("label").alias("name"), F.col("pre").alias("name_pre"))
    return occ.filter(F.col("type").isin(types)).select("root", "pre", "size", "parent").join(named, ["root", "pre"])


def uses(occ: DataFrame, decls: DataFrame) -> DataFrame:
    """(root, pre, name): identifiers that aren't the name of a declaration."""
    names = decls.select("root", F.col("name_pre").alias("pre"))
    return occ.filter(F.col("type") == "identifier").select("root", "pre", F.col("label").alias("name")).join(names, ["root", "pre"], "left_anti")


def resolve(occ: DataFrame, decls: DataFrame, used: DataFrame) -> DataFrame:
    """(root, pre, name, declared): each use with the innermost declaration that it can see.

    A declaration is seen from everywhere below its parent. An equi-join on tree and name
    with the scope's interval as residual condition.
    """
    scope = occ.select("root", F.col("pre").alias("parent"), F.col("size").alias("scope_size"))
    seen = decls.join(scope, ["root", "parent"]).select("root", "name", F.col("pre").alias("declared"), F.col("parent").alias("scope"), "scope_size")
    hit = used.join(seen, ["root", "name"]).filter((F.col("pre") > F.col("scope")) & (F.col("pre") < F.col("scope") + F.col("scope_size")))
    inner = Window.partitionBy("root", "pre").orderBy(F.desc("scope"), F.desc("declared"))
    return hit.withColumn("__r", F.row_number().over(inner)).filter("__r = 1").select("root", "pre", "name", "declared")


def across(decls: DataFrame, used: DataFrame, resolved: DataFrame) -> DataFrame:
    """(root, pre, name, other_root, declared): uses unresolved in their own tree, by name in others.

    Only names declared somewhere take part: the semi join stands for a bloom filter.
    """
    left = used.join(resolved.select("root", "pre"), ["root", "pre"], "left_anti").join(decls.select("name").distinct(), "name", "left_semi")
    other = decls.select("name", F.col("root").alias("other_root"), F.col("pre").alias("declared"))
    return left.join(other, "name").filter("root <> other_root").select("root", "pre", "name", "other_root", "declared")


def reference_counts(decls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(root, pre, name, references), zero for what nothing refers to."""
    n = resolved.groupBy("root", F.col("declared").alias("pre")).agg(F.count("*").alias("n"))
    return decls.join(n, ["root", "pre"], "left").select("root", "pre", "name", F.coalesce("n", F.lit(0)).alias("references"))


def may_contain(files: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of files(root, terms) that hold some wanted term(term): a left semi join."""
    return files.withColumn("term", F.explode("terms")).join(terms, "term", "left_semi").select("root").distinct()


def relations(decls: DataFrame, resolved: DataFrame, occ: DataFrame) -> DataFrame:
    """(module, content): per tree, declarations with their references as nested offsets, for JSON."""
    at = lambda p: occ.select("root", F.col("pre").alias(p), F.struct(F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("len")).alias(p + "_at"))
    refs = resolved.join(at("pre"), ["root", "pre"]).groupBy("root", "declared").agg(F.array_sort(F.collect_list("pre_at")).alias("refs"))
    per = decls.select("root", F.col("pre").alias("declared")).join(at("declared"), ["root", "declared"]).join(refs, ["root", "declared"], "left")
    return per.groupBy(F.col("root").alias("module")).agg(F.array_sort(F.collect_list(F.struct(F.col("declared_at").alias("decl"), F.coalesce("refs", F.array().cast("array<struct<offset:int,len:int>>")).alias("refs")))).alias("content"))
