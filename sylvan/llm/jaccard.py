"""Exact Jaccard join on word shingles by a token-group matrix.

1. Documents with equal shingle sets are one class; one document stands for it.
2. Of each class only the shingles a link must share are looked at (a prefix in a fixed
   order, rare shingles first), and of these only those that another class has too.
3. Similar classes form groups: those of about one size that meet through shared prefix
   tokens, in blocks of bounded size. The token-group matrix holds, for each token, the
   blocks whose token union contains it and their range of set sizes.
4. The matrix bounds how many tokens any two rows of a pair of blocks can share: those in
   both unions whose sets are of sizes that can meet. A pair is opened only if the bound
   reaches what a link needs. Inside, rows whose overlap with the other block's token union
   is below what a link needs are skipped; the rest are compared exactly, by products of 0/1
   matrices.

Every pair of classes that may link lies in exactly one opened pair of blocks, so no link is
lost and none is counted twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import cut, slices, table
from sylvan.llm.components import components

#: Classes in a block, and tokens of their sets, about; columns multiplied at a time, and words
#: whose hashes a worker remembers.
BLOCK, TOKENS, COLUMNS, CACHE = 128, 1_000_000, 4096, 200_000
#: Rounds in which labels spread through shared tokens when groups form.
ROUNDS = 2
#: Prefix tokens that two sets that link must share, where their sizes allow it.
LEAD = 3


@dataclass(frozen=True)
class Join:
    """Two sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def overlap(self, n):
        """The least intersection of a set of n with any set it links with; n a number or a column."""
        return F.ceil(F.lit(self.percent) * n / 100) if isinstance(n, Column) else -(-self.percent * n // 100)

    def prefix(self, n):
        """How many first tokens of a set of n hold LEAD (or its overlap) of those it shares with a set it links with."""
        if isinstance(n, Column):
            return n - self.overlap(n) + F.least(F.lit(LEAD), self.overlap(n))
        return n - self.overlap(n) + min(LEAD, self.overlap(n))

    def need(self, n: Column) -> Column:
        """How many prefix tokens a set of n shares at least with a set it links with, the smallest one included."""
        return F.least(F.lit(LEAD), self.overlap(self.overlap(n)))

    @property
    def zone(self) -> int:
        """Tokens below this bound come first in the order, by frequency; the rest by value."""
        return int(min(0.32, 2 * (1 - self.percent / 100)) * 2**63)

    @property
    def least(self) -> int:
        """Smaller sets link with equal ones only."""
        return 100 // (100 - self.percent) - 1 if self.percent < 100 else 2**31


class Shingles:
    """Shingle sets of texts as sorted arrays of 63-bit hashes."""

    def __init__(self, words: int):
        from xxhash import xxh3_64_intdigest

        class Known(dict):
            def __missing__(self, word):
                h = self[word] = xxh3_64_intdigest(word)
                return h

        self.words, self.known = words, Known()

    def of(self, text: str | None) -> np.ndarray:
        """The set of one text; empty without words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > CACHE:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        with np.errstate(over="ignore"):
            x = np.full(len(words) - k + 1, k, np.uint64)
            for i in range(k):
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - k + 1 + i]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(31))) >> np.uint64(1)
        return np.unique(x.astype(np.int64))


def signature(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def row_key() -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def token_sets(docs: DataFrame, join: Join) -> DataFrame:
    """key, doc_id, n (set size), sig (null for an empty set), zoned, tokens of every row.

    key: a hash of id and text, the same for repeated rows only. tokens: those below the
    zone's bound, `zoned` of them, and at least a prefix, by value; none of a set so small
    that it links with equal ones only.
    """
    import pyarrow as pa

    kinds = {"n": pa.int64(), "sig": pa.binary(), "zoned": pa.int64(), "tokens": pa.list_(pa.int64())}

    def run(batches):
        shingles = Shingles(join.words)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                own = shingles.of(text)
                zoned = int(np.searchsorted(own, join.zone))
                shown = own[: max(join.prefix(len(own)), zoned)] if len(own) >= join.least else own[:0]
                out.append((len(own), signature(own) if len(own) else None, zoned, shown))
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *columns], ["key", "doc_id", *kinds])

    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key long, doc_id long, n long, sig binary, zoned long, tokens array<long>")


def shared_prefixes(tokens: DataFrame, join: Join) -> DataFrame:
    """(token, df, rep, n): each class's prefix tokens that other classes have too.

    The order is the same for all: zone tokens by frequency and value, then others by value.
    Tokens of one class only come first, so a class with enough of them drops out here, as
    does one with fewer left than any link needs.
    """
    rows = tokens.select(F.col("key").alias("rep"), "n", "zoned", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    late = (F.col("token") >= join.zone).cast("int")
    place = F.struct(late.alias("late"), F.when(late == 0, F.col("df")).otherwise(0).alias("rank"), "token", "df")
    per = rows.join(counts, "token").groupBy("rep", "n", "zoned").agg(F.array_sort(F.collect_list(place)).alias("shared"))
    early = F.filter("shared", lambda t: t.late == 0)
    take = F.greatest(F.lit(0), join.prefix(F.col("n")) - (F.col("zoned") - F.size(early))).cast("int")
    kept = F.concat(F.slice(early, F.lit(1), take), F.filter("shared", lambda t: t.late == 1))
    able = per.select("rep", "n", kept.alias("kept")).filter(F.size("kept") >= join.need(F.col("n")))
    return able.select("rep", "n", F.explode("kept").alias("t")).select("t.token", "t.df", "rep", "n")


def blocks(prefixes: DataFrame, join: Join) -> DataFrame:
    """(rep, block): classes that share prefix tokens, directly or by few others, in blocks of bounded size.

    Each round hands the least label among a token's classes to all of them. A group that is
    still in parts after the rounds only opens more pairs of blocks.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / join.percent)))
    labels = prefixes.select("rep").distinct().withColumn("label", F.col("rep"))
    for _ in range(ROUNDS):
        rows = prefixes.select("token", "rep").join(labels, "rep")
        least = rows.groupBy("token").agg(F.min("label").alias("least"))
        labels = cut(prefixes.select("token", "rep").join(least, "token").groupBy("rep").agg(F.min("least").alias("label")))
    labels = labels.join(prefixes.select("rep", "n", band.alias("band")).distinct(), "rep")
    parts = labels.groupBy("label", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    return labels.join(parts, ["label", "band"]).select("rep", F.xxhash64("label", "band", part).alias("block"))


def opened(prefixes: DataFrame, members: DataFrame, join: Join) -> DataFrame:
    """(a, b), a <= b: pairs of blocks that the token-group matrix can't rule out."""
    matrix = prefixes.join(members, "rep").groupBy("token", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"), F.min(join.need(F.col("n"))).alias("need"))
    x, y = matrix.alias("x"), matrix.alias("y")
    inside = F.col("x.block") == F.col("y.block")
    meets = (F.col("x.block") <= F.col("y.block")) & (100 * F.col("x.hi") >= join.percent * F.col("y.lo")) & (100 * F.col("y.hi") >= join.percent * F.col("x.lo")) & (~inside | (F.col("x.m") > 1))
    shared = x.join(y, (F.col("x.token") == F.col("y.token")) & meets).groupBy(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    return shared.agg(F.count("*").alias("shared"), F.min(F.least("x.need", "y.need")).alias("need")).filter(F.col("shared") >= F.col("need")).select("a", "b")


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of sets, i among left and j among right; i < j where both are the same.

    left and right are index arrays, equal or disjoint.
    """
    same = left is right or (len(left) == len(right) and bool((left == right).all()))
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    del order
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    at = np.cumsum(first, dtype=np.int32) - 1  # entries are sorted by token from here on
    del tokens, first
    is_left = np.isin(np.arange(len(sets)), left)
    counts = np.bincount(at)
    if same:
        meets = counts > 1
    else:
        of_left = np.bincount(at[is_left[owner]], minlength=len(counts))
        meets = (of_left > 0) & (of_left < counts)
    # A link needs percent of a set's own tokens in the other side's union.
    able = 100 * np.bincount(owner[meets[at]], minlength=len(sets)) >= percent * sizes
    column = np.cumsum(meets, dtype=np.int32) - 1
    kept = meets[at] & able[owner]
    owner, at = owner[kept], column[at[kept]]
    rows, cols = left[able[left]], right[able[right]]
    row_of, col_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[rows], col_of[cols] = np.arange(len(rows)), np.arange(len(cols))
    inter = np.zeros((len(rows), len(cols)), np.int64)
    for start in range(0, int(meets.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [start, start + COLUMNS])
        o, c = owner[lo:hi], at[lo:hi] - start
        a, b = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(cols), COLUMNS), np.float32)
        m = row_of[o] >= 0
        a[row_of[o[m]], c[m]] = 1
        m = col_of[o] >= 0
        b[col_of[o[m]], c[m]] = 1
        inter += np.rint(a @ b.T).astype(np.int64)
    union = sizes[rows][:, None] + sizes[cols][None, :] - inter
    i, j = np.nonzero((inter > 0) & (100 * inter >= percent * union))
    i, j = rows[i], cols[j]
    return (i[i < j], j[i < j]) if same else (i, j)


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """(rep, root, links): per opened pair of blocks, the classes linked in it.

    root is the least class that rep is connected with inside the pair, links the number of
    documents (copies counted) that rep's links there lead to.
    """
    import pandas as pd
    import pyarrow as pa

    def sets_of(batches):
        shingles = Shingles(join.words)
        for batch in slices(batches):
            own = [shingles.of(t) for t in batch.column("text").to_pylist()]
            right = pa.array([signature(s) == sig for s, sig in zip(own, batch.column("sig").to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("block"), pa.array([s.tobytes() for s in own], pa.binary())], ["rep", "copies", "block", "tokens"])
            yield out.filter(right)

    def verify(pdf):
        pdf = pdf.drop_duplicates(["rep"]).sort_values("rep", ignore_index=True)
        sets = [np.frombuffer(t, np.int64) for t in pdf.tokens]
        every = np.arange(len(sets))
        inside = bool(pdf.self.iloc[0])
        left = every if inside else every[(pdf.side == 0).to_numpy()]
        right = left if inside else every[(pdf.side == 1).to_numpy()]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "root": [], "links": []})
        i, j = compare(sets, left, right, join.percent)
        root = every.copy()
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        copies = pdf.copies.to_numpy()
        met = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
        hit = np.flatnonzero(met)
        reps = pdf.rep.to_numpy()
        return pd.DataFrame({"rep": reps[hit], "root": reps[root[hit]], "links": met[hit].astype(np.int64)})

    wanted = members.join(classes.select("rep", "sig", "copies"), "rep")
    texts = docs.select(row_key().alias("rep"), "text").join(wanted, "rep").select("rep", "copies", "block", "sig", "text")
    sets = texts.mapInArrow(sets_of, "rep long, copies long, block long, tokens binary")
    inside = F.col("a") == F.col("b")
    sides = pairs.select("a", "b", inside.alias("self"), F.explode(F.when(inside, F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))).alias("s"))
    rows = sets.join(sides.select("a", "b", "self", "s.block", "s.side"), "block").select("a", "b", "self", "side", "rep", "copies", "tokens")
    return rows.groupBy("a", "b").applyInPandas(verify, "rep long, root long, links long")


def placed_rows(docs: DataFrame, join: Join) -> DataFrame:
    """key, doc_id, n, family, component_id, links of every row; rows of a component share a family."""
    sets = cut(token_sets(docs, join))
    sizes = sets.select("key", "doc_id", "n", "sig")
    classes = cut(sizes.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count("*").alias("copies")))
    large = classes.filter(F.col("n") >= join.least)
    tokens = sets.filter(F.col("n") >= join.least).join(large.select("sig", F.col("rep").alias("key")), ["key", "sig"], "left_semi").dropDuplicates(["key", "sig"])
    prefixes = cut(shared_prefixes(cut(tokens), join))
    members = cut(blocks(prefixes, join))
    pairs = opened(prefixes, members, join)
    found = cut(links(docs, large, members, pairs, join))
    roots = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    # Of classes that link, the least id of each component; others have that of their own rows.
    linked = classes.join(roots, F.col("rep") == F.col("node"))
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    far = roots.join(ids, "component").join(degrees, F.col("node") == F.col("rep"), "left").select("node", "component", "component_id", "links")
    every = classes.join(far, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("family"), F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return sizes.join(every, "sig", "left").select("key", "doc_id", "n", "family", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))


def jaccard_components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, n_links.

    component_id is the least doc_id reachable by links, n_links the number of other rows
    linked directly. Words are runs of characters other than ASCII white space, A-Z
    lower-cased; a text of fewer words than a shingle has its whole sequence as the one
    shingle. Null and empty texts have an empty set, no links, and their own doc_id as
    component. Equal sets link. Rows are nodes by id and text, so that rows that share an id
    or have none keep their own links; the component of a row without an id is the least id
    among its links, null if there is none. Sets are compared by 64-bit hashes of their
    shingles, whole texts however long; other columns are ignored. An empty table gives no rows.
    """
    return placed_rows(docs, join).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("links").alias("n_links"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs, all columns, with one row of each component: that with the least doc_id, nulls last.

    Of rows equal in id and text any one stays. Rows with an empty set all stay.
    """
    rows = placed_rows(docs, join)
    each = rows.filter("n > 0").groupBy("family", "doc_id", "key").agg(F.count("*").alias("times"))
    kept = each.groupBy("family").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "times")).alias("k")).select("k.key", "k.times")
    kept = cut(kept.union(rows.filter("n = 0").select("key", F.lit(1).cast("long").alias("times")).distinct()))
    keyed = docs.withColumn("__row_key", row_key())
    of = lambda some: keyed.join(some.select(F.col("key").alias("__row_key")), "__row_key", "left_semi")
    many, out = kept.filter("times > 1"), of(kept.filter("times = 1"))
    if not many.isEmpty():
        out = out.unionByName(of(many).dropDuplicates(["__row_key"]))
    return out.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: component of every document by 3-word shingles at 90 percent."""
    return jaccard_components(table(spark, sf_dir, "documents"), Join(words=3, percent=90)).select("doc_id", "n_shingles", "component_id", "n_links")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), j AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, j.y FROM r JOIN j ON r.node = j.x
), c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY 1
), d AS (SELECT x, count(*) AS n_links FROM j GROUP BY 1)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM s JOIN c USING (doc_id) LEFT JOIN d ON d.x = s.doc_id
"""
