"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets its own, a cluster must name it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. Spark takes a table's size from its file and leaves out what rows were unfolded to, and a
    checkpoint keeps that estimate: tables made of a small file would be collected by the driver and broadcast, however large."""
    return df.hint("merge")


def connected_components(nodes: DataFrame, edges: DataFrame, key: str, rounds: int = 100) -> DataFrame:
    """(key, component): the smallest key reachable over undirected ``edges`` (a, b). Large-star and small-star steps, each
    ended by a reliable checkpoint; nothing is collected but a count and a checksum."""
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    for _ in range(rounds):
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen[0] == 0 or seen == sign:
            roots = now.select(F.col("a").alias(key), F.col("b").alias("__root"))
            return nodes.select(key).join(by_shuffle(roots), key, "left").select(key, F.coalesce("__root", key).alias("component"))
        sign = seen
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(by_shuffle(least), "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(by_shuffle(small), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(moved.union(small.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError("components did not settle")
