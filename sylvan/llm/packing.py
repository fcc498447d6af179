"""Packing into length buckets chosen by dynamic programming.

The histogram of all lengths comes to the driver: at most one row for each length up to the
budget. Dynamic programming picks the bucket bounds that minimise padding over all documents;
batches of a fixed token budget then form inside each bucket.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.llm.common import cut, key_bin, table, text_key, word_count

#: Documents that one window task numbers, about.
ROWS_PER_BIN = 5_000


@dataclass(frozen=True)
class Packing:
    """At most `buckets` bounds; a batch holds as many documents as padded fit the budget."""

    buckets: int = 16
    budget: int = 65_536


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Bounds, each one of lengths and the last the largest, that minimise total padding.

    A document is padded to the least bound not below its length. lengths are distinct,
    ascending and positive. Of equal solutions the one with fewer buckets, then lower bounds
    wins. The best split points grow with the end, so each layer is solved by halving:
    n log n steps a layer.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.array(lengths, dtype=np.int64)
    number = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    words = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) * size)])

    def padding(start, end):
        """Of documents start..end-1 (by place in lengths) padded to lengths[end - 1]."""
        return size[end - 1] * (number[end] - number[start]) - (words[end] - words[start])

    cost = np.concatenate([[0], padding(0, np.arange(1, n + 1))])
    layers = [np.zeros(n + 1, dtype=np.int64)]
    total = [int(cost[n])]
    for _ in range(1, min(buckets, n)):
        new, split = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0
        work = [(1, n, 0, n - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            end = (lo + hi) // 2
            starts = np.arange(first, min(last, end - 1) + 1)
            tried = cost[starts] + padding(starts, end)
            at = int(np.argmin(tried))
            new[end], split[end] = tried[at], starts[at]
            work += [(lo, end - 1, first, int(starts[at])), (end + 1, hi, int(starts[at]), last)]
        cost = new
        layers.append(split)
        total.append(int(cost[n]))
    end, bounds = n, []
    for split in reversed(layers[: total.index(min(total)) + 1]):
        if end == 0:
            break
        bounds.append(int(size[end - 1]))
        end = int(split[end])
    return sorted(set(bounds))


def pack(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, bucket, pad_to, batch, slot.

    Tokens are words. bucket counts from 1 by length; pad_to is its bound; batch numbers the
    batches of a bucket and slot the places in one, from 0, in a fixed shuffled order. Longer
    documents than the budget share one last bucket, each a batch of its own, unpadded. Null
    and empty texts have nothing to pack: bucket 0, no batch. Repeated rows are packed as
    often as they occur, side by side: they are counted before anything is sorted, so no id
    (or lack of one), however common, fills a window. Other columns are ignored. An empty
    table gives no rows.
    """
    every = docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), text_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = cut(every.groupBy("doc_id", "n_tokens", "key").agg(F.count("*").alias("times")))
    histogram = rows.filter(F.col("n_tokens").between(1, p.budget)).groupBy("n_tokens").agg(F.sum("times")).orderBy("n_tokens").collect()
    bounds = best_bounds([r[0] for r in histogram], [r[1] for r in histogram], p.buckets)
    limits = F.array(*map(F.lit, bounds)).cast("array<long>")
    place = F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))) + 1
    bucket = F.when(F.col("n_tokens") == 0, 0).otherwise(place)
    pad_to = F.when(F.col("n_tokens") == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.get(limits, F.col("bucket") - 1), F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket).withColumn("pad_to", pad_to)

    # Numbers within a bucket: whole bins are counted, rows are numbered within a bin.
    sizes = [0] * (len(bounds) + 2)
    for r in histogram:
        sizes[bisect_left(bounds, r[0]) + 1] += r[1]
    largest = max([*sizes, rows.filter(F.col("n_tokens") > p.budget).count(), 1])
    rows = rows.withColumn("bin", F.when(F.col("bucket") > 0, key_bin(F.col("key"), -(-largest // ROWS_PER_BIN))))
    full = rows.filter("bucket > 0")
    counts = full.groupBy("bucket", "bin").agg(F.sum("times").alias("in_bin"))
    earlier = Window.partitionBy("bucket").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "bin", F.coalesce(F.sum("in_bin").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "bin").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("offset") + F.sum("times").over(within)
    capacity = F.greatest(F.lit(1), F.floor(F.lit(p.budget) / F.col("pad_to")))
    packed = full.join(offsets, ["bucket", "bin"]).withColumn("last", last)
    packed = packed.withColumn("number", F.explode(F.sequence(F.col("last") - F.col("times"), F.col("last") - 1)))
    packed = packed.select("doc_id", "n_tokens", "bucket", "pad_to", F.floor(F.col("number") / capacity).alias("batch"), (F.col("number") % capacity).alias("slot"))
    nothing = F.lit(None).cast("long")
    empty = rows.filter("bucket = 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return packed.union(empty.select("doc_id", "n_tokens", "bucket", "pad_to", nothing.alias("batch"), nothing.alias("slot")))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: bucket, batch and slot of every document."""
    return pack(table(spark, sf_dir, "documents"))
