"""One object for the questions a service would answer about a code history."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators import diff, graph, graph_rules, history, metrics, navigation, patterns, serialize
from sylvan.operators.lineage import cut
from sylvan.operators.metrics import MetricSpec


@dataclass(frozen=True)
class Config:
    """What a repository is ingested with: precomputed patterns, a metric, graph rules; commits at most."""

    precomputed: str | None = None
    metric: MetricSpec | None = None
    rules: str | None = None
    limit: int | None = None


class Engine:
    """commits(commit, parents, time, ...) and occ: occurrences whose root names a commit's tree.

    root_of maps commits to roots: (commit, root). of(roots) gives the occurrences of some
    roots(root) only, where a source can make fewer trees than all; else they are picked from occ.
    """

    def __init__(self, commits: DataFrame, root_of: DataFrame, occ: DataFrame, of: Callable[[DataFrame], DataFrame] | None = None):
        self.commits, self.root_of, self.occ = commits, root_of, occ
        self.of = of or (lambda roots: self.occ.join(roots, "root", "left_semi"))
        self.config, self.timings = Config(), {}

    def register(self, config: Config) -> Engine:
        """An engine with what a configuration asks for computed beside its trees."""
        occ = patterns.match_bits(self.occ, config.precomputed) if config.precomputed else self.occ
        if config.metric:
            occ = occ.join(metrics.bottom_up(self.occ, config.metric, "metric"), ["root", "pre"])
        out = Engine(self.commits, self.root_of, occ)
        out.config = config
        return out

    def timed(self, phase: str, df: DataFrame) -> DataFrame:
        """df, computed and kept in the checkpoint folder, with the seconds it took under `timings`."""
        began = time.time()
        out = df.checkpoint(eager=True)
        self.timings[phase] = time.time() - began
        return out

    def commit_count(self, after: str) -> int:
        """How many commits a query from a head takes in under the configuration."""
        n = self.members(after).count()
        return n if self.config.limit is None else min(n, self.config.limit)

    def walk(self, after: str, before: str | None = None, limit: int | None = None) -> DataFrame:
        """Commits of a range, nearest to its head first."""
        return self.members(after, before, limit).orderBy("far", "commit")

    def members(self, after: str, before: str | None = None, limit: int | None = None) -> DataFrame:
        """Commits of a range in no order, with a limit the nearest so many."""
        walk = history.Walk(self.commits).after(after)
        found = (walk.before(before) if before else walk).commits(limit)
        return found if limit is None else found.orderBy("far", "commit").limit(limit)

    def trees(self, commits: DataFrame) -> DataFrame:
        """Occurrences of the trees of some commits; equal roots are taken once."""
        roots = self.root_of.join(commits.select("commit"), "commit", "left_semi").select("root").distinct()
        return self.of(roots)

    def query(self, source: str, after: str, before: str | None = None, limit: int | None = None) -> DataFrame:
        """(commit, counts): matches of each pattern, in the order of the query text."""
        commits = cut(self.members(after, before, limit).select("commit"))
        counted = patterns.counts(cut(self.trees(commits)), source)
        per = counted.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pattern", "matches"))), lambda x: x.matches).alias("counts"))
        return self.root_of.join(commits.select("commit"), "commit").join(per, "root").select("commit", "counts")

    def compute(self, source: str, after: str, max_matches: int = 500, limit: int | None = None) -> DataFrame:
        """(commit, counts, errors): counts up to max_matches; errors lists the patterns that had more."""
        per = self.query(source, after, limit=limit)
        many = F.filter(F.transform("counts", lambda n, i: F.when(n > max_matches, i)), lambda i: i.isNotNull())
        return per.select("commit", F.transform("counts", lambda n: F.least(n, F.lit(max_matches))).alias("counts"), many.alias("errors"))

    def query_stream(self, source: str, after: str, limit: int | None = None, chunk: int = 100) -> Iterator:
        """(commit, counts) in the order of the walk; the trees are gathered once, then counted `chunk` commits at a time, one job for each chunk."""
        walk = cut(self.members(after, limit=limit).select("commit", "far"))
        total = walk.count()
        trees = cut(self.trees(walk))
        ranked = walk.select("commit", (F.row_number().over(history.Window.orderBy("far", "commit")) - 1).alias("rank"))  # one row a commit
        for start in range(0, total, chunk):
            part = ranked.filter(F.col("rank").between(start, start + chunk - 1))
            roots = self.root_of.join(part.select("commit"), "commit", "left_semi").select("root")
            counted = patterns.counts(trees.join(roots, "root", "left_semi"), source).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pattern", "matches"))), lambda x: x.matches).alias("counts"))
            for r in self.root_of.join(part, "commit").join(counted, "root").orderBy("rank").toLocalIterator():
                yield r.commit, list(r.counts)

    def query_differential(self, source: str, base: str, other: str) -> DataFrame:
        """Matches in base whose subtree other lacks."""
        side = lambda c: self.trees(self.commits.filter(F.col("commit") == c))
        a, b = side(base), side(other)
        found = patterns.matches(a, source).withColumnRenamed("at", "pre").join(metrics.merkle(a), ["root", "pre"])
        return history.differential(found, metrics.merkle(b))

    def script(self, spec: MetricSpec, name: str, after: str, limit: int | None = None) -> DataFrame:
        """(commit, name): a bottom-up metric at the root of each commit's tree."""
        commits = cut(self.members(after, limit=limit).select("commit"))
        values = metrics.bottom_up(cut(self.trees(commits)), spec, name).filter("pre = 0")
        return self.root_of.join(commits.select("commit"), "commit").join(values, "root").select("commit", name)

    def diff(self, src: str, dst: str, algorithm: str = "greedy_100") -> DataFrame:
        """Counts of links and edits between two commits' trees."""
        pick = lambda c, n: self.root_of.filter(F.col("commit") == c).select(F.lit(1).alias("pair"), F.col("root").alias(n))
        return diff.diff_pairs(pick(src, "src_root").join(pick(dst, "dst_root"), "pair"), self.occ, algorithm)

    def track(self, commit: str, path: list[int], after: str) -> DataFrame:
        """Where the subtree at a path of one commit lies in the others of a walk: (commit, pre, same_place)."""
        mine = self.trees(self.commits.filter(F.col("commit") == commit))
        at = navigation.paths(mine).filter(F.col("path") == F.array(*map(F.lit, path)).cast("array<int>") if path else F.size("path") == 0)
        wanted = at.join(metrics.merkle(mine), ["root", "pre"]).select("content", F.col("pre").alias("here"))
        trees = self.trees(self.walk(after))
        found = trees.join(metrics.merkle(trees), ["root", "pre"]).join(wanted, "content")
        return self.root_of.join(found, "root").select("commit", "pre", (F.col("pre") == F.col("here")).alias("same_place"))

    def graph(self, stanzas: list[graph.Stanza], commit: str) -> tuple[DataFrame, DataFrame]:
        return graph.build(self.trees(self.commits.filter(F.col("commit") == commit)), stanzas)

    def rules(self, commit: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The graph that rules as text build from a commit's tree; those of the configuration by default."""
        return graph_rules.build(self.trees(self.commits.filter(F.col("commit") == commit)), source or self.config.rules)

    def file(self, commit: str) -> DataFrame:
        """The commit's text."""
        return serialize.source(self.trees(self.commits.filter(F.col("commit") == commit)))

    def view(self, commit: str) -> DataFrame:
        return serialize.view(self.trees(self.commits.filter(F.col("commit") == commit)))

    def fetch(self, nodes: DataFrame) -> DataFrame:
        """Rows of occurrences for nodes(root, pre): a semi join."""
        return self.occ.join(nodes.select("root", "pre"), ["root", "pre"], "left_semi")

    def labels(self, nodes: DataFrame) -> DataFrame:
        return self.fetch(nodes).select("label").filter("label IS NOT NULL").distinct()

    def commit(self, name: str, ancestors: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
        """The commit's row with ancestors: first-parent ancestors so many steps away."""
        line = history.Walk(self.commits).after(name).first_parents().commits().filter(F.col("far").isin(list(ancestors)))
        far = line.agg(F.transform(F.array_sort(F.collect_list(F.struct("far", "commit"))), lambda x: x.commit).alias("ancestors")).first()[0]
        return self.commits.filter(F.col("commit") == name).withColumn("ancestors", F.array(*map(F.lit, far)).cast("array<string>"))
