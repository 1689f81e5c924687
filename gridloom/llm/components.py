"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges stay distributed; each step is a shuffle and ends in a written table, so lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges run from a larger node ``a`` to a smaller node ``b``, and so do those returned."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a")  # v: neighbours larger than a
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a, b): root is the smallest node reachable."""
    now = common.shared_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    sign = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or tuple(seen) == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        sign = tuple(seen)
        after = common.shared_table(_star(_star(now, True), False), "edges")
        common.drop_table(now)
        now = after
    raise RuntimeError("components did not settle")
