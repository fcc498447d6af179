"""Trees back to text: source, S-expression, JSON, outline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source(occ: DataFrame) -> DataFrame:
    """(root, text): the leaves' texts in order."""
    leaves = occ.filter(F.col("size") == 1).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pre", F.coalesce("label", F.lit("")).alias("t")))).alias("x"))
    return leaves.select("root", F.array_join("x.t", "").alias("text"))


def sexpressions(occ: DataFrame, labels: bool = True, roles: bool = False, ids: bool = False) -> DataFrame:
    """(root, sexp): opening and closing tokens of all nodes, in order.

    labels, roles and ids choose what each node shows. A node closes after its last
    descendant; of nodes that close together the deepest is first.
    """
    head = F.concat(F.when(F.col("role").isNotNull() & F.lit(roles), F.concat("role", F.lit(": "))).otherwise(""), F.lit("("), F.col("type"), F.when(F.lit(ids), F.concat(F.lit("#"), F.col("pre").cast("string"))).otherwise(""), F.when(F.col("label").isNotNull() & F.lit(labels), F.concat(F.lit(" "), F.to_json(F.struct(F.col("label").alias("l"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("label").alias("l")))) - 6))).otherwise(""))
    opened = F.struct(F.col("pre").cast("long").alias("at"), F.lit(0).alias("close"), F.lit(0).alias("deep"), F.concat(F.when(F.col("pre") > 0, " ").otherwise(""), head).alias("t"))
    closed = F.struct((F.col("pre") + F.col("size") - 1).cast("long").alias("at"), F.lit(1).alias("close"), (-F.col("depth")).cast("int").alias("deep"), F.lit(")").alias("t"))
    tokens = occ.select("root", F.explode(F.array(opened, closed)).alias("x"))
    return tokens.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.t), "").alias("sexp"))


def outline(occ: DataFrame) -> DataFrame:
    """(root, outline): a line for each node, indented by depth."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("type"), F.when(F.col("label").isNotNull(), F.concat(F.lit(" "), F.col("label"))).otherwise(""))
    rows = occ.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pre", line.alias("t")))).alias("x"))
    return rows.select("root", F.array_join("x.t", "\n").alias("outline"))


def json_trees(occ: DataFrame) -> DataFrame:
    """(root, json): nested {"type", "label", "children"}; a tree at a time in Python."""
    import json

    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("pre")
        made, tops = {}, []
        for pre, parent, kind, label in zip(pdf.pre, pdf.parent, pdf.type, pdf.label):
            node = {"type": kind}
            if label is not None and not pd.isna(label):
                node["label"] = label
            made[pre] = node
            if parent is None or pd.isna(parent):
                tops.append(node)
            else:
                made[int(parent)].setdefault("children", []).append(node)
        return pd.DataFrame({"root": [pdf.root.iloc[0]], "json": [json.dumps(tops[0], ensure_ascii=False)]})

    kind = occ.schema["root"].dataType.simpleString()
    return occ.select("root", "pre", "parent", "type", "label").groupBy("root").applyInPandas(run, f"root {kind}, json string")


def view(occ: DataFrame) -> DataFrame:
    """(root, kind, nodes): node numbers by what they carry: label, children, both or neither."""
    has, inner = F.col("label").isNotNull(), F.col("size") > 1
    kind = F.when(has & inner, "both").when(has, "labeled").when(inner, "children").otherwise("typed")
    return occ.groupBy("root", kind.alias("kind")).agg(F.array_sort(F.collect_list("pre")).alias("nodes"))


def reindented(text, old: str, new: str):
    """A Column of text with `old` at the start of each line replaced by `new`."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.startswith(old), F.concat(F.lit(new), F.substr(x, F.lit(len(old) + 1)))).otherwise(x)), "\n")


def indentation(text):
    """A Column: blanks and tabs at the start of the last line of white space."""
    return F.regexp_extract(text, r"(?:^|\n)([ \t]*)[^\n]*$", 1)


def write_csv(df: DataFrame, path: str) -> None:
    """Writes rows as CSV with a header, in the shared storage of path."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Writes rows as JSON lines, nested columns nested."""
    df.write.mode("overwrite").json(path)


RELATIONS = "module string, content array<struct<decl:struct<file:string,offset:bigint,len:bigint>,refs:array<struct<file:string,offset:bigint,len:bigint>>>>"


def read_relations(spark, path: str) -> DataFrame:
    """(module, file, offset, len, ref_file, ref_offset, ref_len): reference relations from JSON, a row each.

    A declaration without references has null ref columns.
    """
    rows = spark.read.schema(RELATIONS).option("multiLine", True).json(path)
    each = rows.select("module", F.explode("content").alias("c")).select("module", "c.decl", F.explode_outer("c.refs").alias("r"))
    return each.select("module", "decl.file", "decl.offset", "decl.len", F.col("r.file").alias("ref_file"), F.col("r.offset").alias("ref_offset"), F.col("r.len").alias("ref_len"))
