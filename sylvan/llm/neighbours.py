"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are rotated, and each curve takes some of the rotated dimensions, shifts its grid
and orders all vectors by their place on a Hilbert curve. Each ordering is cut into ranges of
equal size; a query looks into the ranges around its own on every curve, and into all that hold
its own cell of the grid, and what it finds is merged and ranked by the distance of the original
vectors. The window is a share of the table that shrinks as the table grows, so a query's work
grows more slowly than the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.llm.common import cut, table

#: Vectors in a range at most, about; ranges a curve at most, so that all bounds are a few MB
#: (beyond RANGE * MAX_RANGES vectors ranges grow); queries compared with a range at a time.
RANGE, MAX_RANGES, QUERIES = 10_000, 65_536, 256


@dataclass(frozen=True)
class Curves:
    """A query looks at scale / n ** power of n vectors on each curve, but at 4 (k + 1) at least.

    Fewer than k + 1 vectors couldn't hold k neighbours. Vectors in the query's own cell are
    all looked at, though they be more than that.
    """

    k: int = 10
    curves: int = 14
    dims: int = 8
    bits: int = 6
    scale: float = 0.52
    power: float = 0.2
    seed: int = 7

    def window(self, n: int) -> float:
        """The share of n vectors in a query's window on one curve."""
        return min(1.0, max(self.scale / max(n, 1) ** self.power, 4 * (self.k + 1) / max(n, 1)))

    def ranges(self, n: int) -> tuple[int, int]:
        """(ranges of each curve, how many on either side of its own a query looks into)."""
        share = self.window(n)
        if share == 1:
            return 1, 0
        count = min(max(int(np.ceil(5 / share)), -(-n // RANGE)), max(MAX_RANGES, int(np.ceil(5 / share))))
        return count, max(2, round((share * count - 1) / 2))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n x dims integers of `bits` bits)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            has = (x[i] & q) > 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Layout:
    """The curves' projections, fixed by the seed and the vectors' mean and spread."""

    def __init__(self, c: Curves, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(c.seed)
        size, self.c, self.mean, self.spread = len(mean), c, mean, np.maximum(spread, 1e-12)
        rotations = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-c.curves * c.dims // size))]
        every = np.concatenate(rotations, axis=1)
        self.axes = [every[:, i * c.dims : (i + 1) * c.dims] for i in range(c.curves)]
        self.axes = [a if a.shape[1] else every for a in self.axes]
        self.shifts = rng.random((c.curves, c.dims))

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        z = ((vectors - self.mean) / self.spread.mean()) @ self.axes[curve]
        cells = 1 << self.c.bits
        grid = np.floor((z / 6 + 0.5) * (cells - 1) + self.shifts[curve][: z.shape[1]])
        return hilbert_keys(np.clip(grid, 0, cells - 1), self.c.bits)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of vectors that take part.

    Null ids and vectors that are null, zero or hold null or non-finite components take no
    part, nor do vectors of another length than the most common one (the longer of equals).
    """
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    length = v.groupBy(F.size("embedding").alias("length")).count().agg(F.max(F.struct("count", "length"))).first()[0]
    return v.filter(F.size("embedding") == (length["length"] if length else 0))


def _moments(frames):
    import pandas as pd

    for pdf in frames:
        if len(pdf):
            x = np.stack(pdf.embedding.to_numpy())
            yield pd.DataFrame({"dim": np.arange(x.shape[1]), "n": len(x), "sum": x.sum(0), "squares": (x**2).sum(0)})


def closest(asking: np.ndarray, there: np.ndarray, centre: np.ndarray, take: int):
    """For each row of asking, (rows of there, distances): its `take` nearest and all as near as the last.

    A matrix product on centred vectors sorts out the far ones; whatever its rounding error
    could have kept from the first `take` stays, and distances are those of the vectors given.
    """
    x, largest = there - centre, max(np.abs(there).max(), np.abs(asking).max(), 1e-300)
    squares, dims = (x**2).sum(1), x.shape[1]
    take = min(take, len(x))
    for s in range(0, len(asking), QUERIES):
        q = asking[s : s + QUERIES] - centre
        own = (q**2).sum(1)
        rough = squares - 2 * q @ x.T + own[:, None]
        last = np.partition(rough, take - 1, axis=1)[:, take - 1]
        reach = np.sqrt(own) + np.sqrt(squares.max())
        slack = 16 * (dims + 8) * np.finfo(float).eps * reach * (reach + np.sqrt(dims) * largest)
        for i in range(len(q)):
            near = np.flatnonzero(rough[i] <= last[i] + slack[i])
            yield near, np.sqrt(((asking[s + i] - there[near]) ** 2).sum(1))


def nearest(rows: DataFrame, is_query, c: Curves = Curves()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows found, its own row left out.

    rows(vec_id, embedding); is_query tells the queries. Equal vectors are indexed once, with
    as many of their smallest ids as a list can hold, so a vector however common fills no
    range; a repeated vec_id with equal vectors counts once. Ties go to the smaller vec_id,
    also among more vectors at one distance than k. With fewer than k other vectors all are
    returned; an empty table gives no rows. Columns other than the two are ignored.
    """
    import pandas as pd

    single = "float" in rows.schema["embedding"].dataType.simpleString()
    kind = "array<float>" if single else "array<double>"  # what travels; distances are doubles
    vectors = usable(rows).withColumn("embedding", F.col("embedding").cast(kind))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.dropDuplicates(["vec_id", "embedding"]).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= c.k + 1)
    index = cut(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    moments = index.select("embedding").mapInPandas(_moments, "dim int, n long, sum double, squares double").groupBy("dim").agg(F.sum("n"), F.sum("sum"), F.sum("squares")).orderBy("dim").collect()
    if not moments:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = moments[0][1]
    mean = np.array([m[2] / n for m in moments])
    layout = Layout(c, mean, np.sqrt(np.maximum(np.array([m[3] / n for m in moments]) - mean**2, 0)))
    matrix = lambda series: np.stack(series.to_numpy()).astype(float)
    ranges, reach = c.ranges(n)

    def on_curves(frames):
        for pdf in frames:
            if len(pdf):
                x = matrix(pdf.embedding)
                for curve in range(c.curves):
                    yield pd.DataFrame({"curve": curve, "key": layout.keys(x, curve)})

    cuts = [i / ranges for i in range(1, ranges)]
    bounds = {}
    if cuts:
        keys = index.select("embedding").mapInPandas(on_curves, "curve int, key long")
        found = keys.groupBy("curve").agg(F.percentile_approx("key", cuts, max(10_000, 20 * ranges))).collect()
        bounds = {r[0]: np.array(r[1], dtype=np.int64) for r in found}

    # Keys equal to bounds are spread over the ranges these part, `low` to `high`, by a hash of
    # vector and curve; a query looks into all of them, as the hash says nothing of distance.
    def place(frames):
        for pdf in frames:
            if len(pdf):
                x, salt = matrix(pdf.embedding), pdf.salt.to_numpy().astype(np.uint64)
                for curve in range(c.curves):
                    at = bounds.get(curve, np.zeros(0, np.int64))
                    key = layout.keys(x, curve)
                    low, high = np.searchsorted(at, key, "left"), np.searchsorted(at, key, "right")
                    mixed = (salt + np.uint64(curve)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    here = low + (mixed % (high - low + 1).astype(np.uint64)).astype(np.int64)
                    start = np.clip(here - reach, 0, max(0, ranges - 1 - 2 * reach))
                    end = np.minimum(start + 2 * reach, ranges - 1)
                    yield pdf.drop(columns="salt").assign(curve=curve, at=here, start=np.minimum(start, low), end=np.maximum(end, high))

    salted = lambda df: df.withColumn("salt", F.xxhash64("embedding"))
    fields = f"embedding {kind}, curve int, at long, start long, end long"
    placed = salted(index).select("embedding", "salt", "ids").mapInPandas(place, "ids array<long>, " + fields).select("curve", "at", "embedding", "ids")
    asked = vectors.filter(is_query).dropDuplicates(["vec_id", "embedding"]).withColumnRenamed("vec_id", "query_id")
    looked = salted(asked).mapInPandas(place, "query_id long, " + fields).select("curve", F.explode(F.sequence("start", "end")).alias("at"), "embedding", "query_id")
    columns = ["query_id", "vec_id", "score"]

    def search(asking, there):
        out = []
        if len(asking) and len(there):
            ids = there.ids.to_list()
            for me, (near, distances) in zip(asking.query_id.to_list(), closest(matrix(asking.embedding), matrix(there.embedding), mean, c.k + 1)):
                found = sorted((d, i) for d, col in zip(distances.tolist(), near.tolist()) for i in ids[col] if i != me)
                out += [(me, i, d) for d, i in found[: c.k]]
        return pd.DataFrame(out, columns=columns)

    found = looked.groupBy("curve", "at").cogroup(placed.groupBy("curve", "at")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= c.k).select(F.col("query_id"), "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the ten nearest of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
