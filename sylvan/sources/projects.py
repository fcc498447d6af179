"""Repositories as tables: files, versions, build modules, and ingest of unseen contents.

files: (path, text). entries: (version, path, blob). blobs: (blob, text).
"""

from __future__ import annotations

import subprocess
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.sources.parsers import SUFFIXES
from sylvan.sources.trees import parse


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, text) of all files below a folder whose names fit the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def language(path: Column) -> Column:
    """The front-end for a path by its suffix; null if there is none."""
    return reduce(lambda out, s: F.when(path.endswith(s[0]), s[1]).otherwise(out), sorted(SUFFIXES.items(), key=lambda s: len(s[0])), F.lit(None).cast("string"))


def folder_of(path: Column) -> Column:
    """The part before the last slash; empty at the top."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def parse_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Occurrences of all files that have a front-end, keyed by path."""
    known = files.withColumn("__lang", language(F.col(path)))
    parts = [parse(known.filter(F.col("__lang") == lang), path, text, lang) for lang in sorted(set(SUFFIXES.values()))]
    return reduce(DataFrame.unionByName, parts)


def contents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries without version, blobs): each distinct text once, by its SHA-256."""
    keyed = files.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.drop("text"), keyed.select("blob", "text").dropDuplicates(["blob"])


def unseen(blobs: DataFrame, store: DataFrame | None) -> DataFrame:
    """Blobs that the store lacks: only these need parsing."""
    return blobs if store is None else blobs.join(store.select("blob").distinct(), "blob", "left_anti")


def version_trees(entries: DataFrame, occ: DataFrame) -> DataFrame:
    """Occurrences of every version: blobs' trees (root = blob) joined to the paths that hold them."""
    return entries.join(occ.withColumnRenamed("root", "blob"), "blob").withColumn("root", F.concat_ws(":", "version", "path"))


def child_by_name(entries: DataFrame, folder: str, name: str) -> DataFrame:
    """The entry of a name in a folder, and its place among the folder's entries."""
    from pyspark.sql import Window

    here = entries.filter(folder_of(F.col("path")) == folder)
    placed = here.withColumn("place", F.row_number().over(Window.partitionBy("version").orderBy("path")) - 1)
    return placed.filter(F.element_at(F.split("path", "/"), -1) == name)


#: Where Maven looks for sources unless a project says otherwise: fixed values.
MAIN, TEST = "src/main/java", "src/test/java"


def maven_modules(files: DataFrame) -> DataFrame:
    """(folder, main, test, modules, is_module, holds_main, holds_test, holds_modules).

    One row for each pom.xml; main and test are its source folders, by its own settings or
    Maven's defaults; the holds flags say whether files lie there.
    """
    poms = files.filter(F.element_at(F.split("path", "/"), -1) == "pom.xml").withColumn("folder", folder_of(F.col("path")))
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    setting = lambda tag, default: F.coalesce(F.nullif(F.trim(F.regexp_extract(bare, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit("")), F.lit(default))
    under = lambda tail: F.when(F.col("folder") == "", tail).otherwise(F.concat_ws("/", "folder", tail))
    modules = F.transform(F.regexp_extract_all(bare, F.lit(r"<module>\s*([^<]*?)\s*</module>"), F.lit(1)), lambda m: F.when(F.col("folder") == "", m).otherwise(F.concat_ws("/", F.col("folder"), m)))
    pom = poms.select("folder", under(setting("sourceDirectory", MAIN)).alias("main"), under(setting("testSourceDirectory", TEST)).alias("test"), modules.alias("modules"))
    # Folders above each file, so that "lies below" is an equi-join.
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("path", "/")) - 1)), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("f")).distinct()
    has = lambda name: above.select(F.col("f").alias(name), F.lit(True).alias("holds_" + name))
    out = pom.join(has("main"), "main", "left").join(has("test"), "test", "left")
    return out.select("folder", "main", "test", "modules", F.lit(True).alias("is_module"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("holds_main", "holds_test")), (F.size("modules") > 0).alias("holds_modules"))


def module_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files with module (the nearest folder with a pom, null if none) and scope: main, test or other."""
    parts = F.split("path", "/")
    ups = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"))))
    near = files.select("path", ups.alias("u")).select("path", "u.n", "u.folder").join(modules.select("folder", "main", "test"), "folder").groupBy("path").agg(F.max_by(F.struct("folder", "main", "test"), "n").alias("m"))
    scope = F.when(F.startswith("path", F.concat("m.test", F.lit("/"))), "test").when(F.startswith("path", F.concat("m.main", F.lit("/"))), "main").otherwise("other")
    return files.join(near, "path", "left").withColumn("module", F.col("m.folder")).withColumn("scope", F.when(F.col("m").isNotNull(), scope)).drop("m")


def make_targets(files: DataFrame) -> DataFrame:
    """(folder, target, prerequisite): rules of all makefiles; null prerequisite where there is none."""
    makes = files.filter(F.element_at(F.split("path", "/"), -1).isin("Makefile", "makefile", "GNUmakefile") | F.endswith("path", F.lit(".mk")))
    occ = parse(makes, "path", "text", "make")
    target = occ.filter("type = 'target'").select("root", "parent", F.col("label").alias("target"))
    need = occ.filter("type = 'prerequisite'").select("root", "parent", F.col("label").alias("prerequisite"))
    return target.join(need, ["root", "parent"], "left").select(folder_of(F.col("root")).alias("folder"), "target", "prerequisite")


def _git(path: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", path, *args], input=given, capture_output=True, check=True).stdout


def read_repository(spark: SparkSession, path: str, head: str = "HEAD", limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, entries, blobs) of a git repository in storage that all executors reach.

    commits(commit, parents, time, tz_minutes, tree, message); entries(version, path, blob);
    blobs(blob, text). The driver lists commit ids; trees and contents are read in parallel,
    each content once however many commits hold it. Nothing is fetched from elsewhere.
    """
    ids = _git(path, "rev-list", *(["-n", str(limit)] if limit is not None else []), head).decode().split()
    named = spark.createDataFrame([(i,) for i in ids], "commit string").repartition(max(1, min(len(ids), 256)))

    def commits(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for c in pdf["commit"]:
                parents, when, tz, tree, message = _git(path, "show", "-s", "--format=%P%x00%ct%x00%ci%x00%T%x00%B", c).decode("utf-8", "replace").split("\0", 4)
                sign = tz.rsplit(" ", 1)[1]
                rows.append((c, parents.split(), int(when), (-1 if sign[0] == "-" else 1) * (int(sign[1:3]) * 60 + int(sign[3:5])), tree, message.strip()))
            yield pd.DataFrame(rows, columns=["commit", "parents", "time", "tz_minutes", "tree", "message"])

    def listed(frames):
        import pandas as pd

        for pdf in frames:
            for c in pdf["commit"]:
                rows = [line.split("\t", 1) for line in _git(path, "ls-tree", "-r", "-z", c).decode("utf-8", "replace").split("\0") if line]
                yield pd.DataFrame([(c, name, meta.split()[2]) for meta, name in rows if meta.split()[1] == "blob"], columns=["version", "path", "blob"])

    def contents_of(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([(b, _git(path, "cat-file", "blob", b).decode("utf-8", "replace")) for b in pdf["blob"]], columns=["blob", "text"])

    entries = named.mapInPandas(listed, "version string, path string, blob string")
    blobs = entries.select("blob").distinct().mapInPandas(contents_of, "blob string, text string")
    return named.mapInPandas(commits, "commit string, parents array<string>, time long, tz_minutes int, tree string, message string"), entries, blobs


def with_fork(commits: DataFrame, fork: DataFrame) -> DataFrame:
    """The commits of a repository and of a fork of it, each once."""
    return commits.unionByName(fork.join(commits.select("commit"), "commit", "left_anti"))


def pull_requests(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """(number, merge, head): merged requests(number, merge, head, merged) whose merge commit is known."""
    return requests.filter("merged").join(commits.select(F.col("commit").alias("merge")), "merge", "left_semi").select("number", "merge", "head")


def folder_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair, src_root, dst_root): files(path, text) of two folders by path, as roots "before:path" and "after:path"."""
    both = before.select("path").join(after.select("path"), "path")
    return both.select(F.col("path").alias("pair"), F.concat(F.lit("before:"), "path").alias("src_root"), F.concat(F.lit("after:"), "path").alias("dst_root"))


def parse_sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """Occurrences of both folders' files under the roots of folder_pairs()."""
    side = lambda df, name: df.select(F.concat(F.lit(name + ":"), "path").alias("path"), "text")
    return parse_files(side(before, "before").unionByName(side(after, "after")))
