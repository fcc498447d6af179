"""Connected components by alternating large-star and small-star steps.

Both steps are a grouped minimum and a join; edges are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(src, dst): component is the least node reachable.

    Null ends, loops and repeated edges are ignored. Steps alternate until the edges no
    longer change, when every node hangs on its component's least node.
    """
    now = cut(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    seen = None
    while True:
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("least"))
        least = least.select("src", F.least("src", "least").alias("least"))
        large = both.filter(F.col("dst") > F.col("src")).join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        down = large.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        root = down.groupBy("src").agg(F.min("dst").alias("least"))
        small = down.join(root, "src").filter(F.col("dst") != F.col("least")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        now = cut(small.union(root.select("src", F.col("least").alias("dst"))).distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if state == seen:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())
        seen = state
