"""Shards by jump consistent hashing (Lamping and Veach, 2014): no ring table, and one more shard takes rows only
into itself, about 1/(n+1) of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 40


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. All keys step together; a key leaves once its next jump passes the end."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            to = np.floor((shard[live] + 1) * (2147483648.0 / draw))
            inside = to < shards
            live = live[inside]
            shard[live] = to[inside].astype(np.int64)
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Shard column of a 64-bit integer key; null keys count as 0. ``shards`` must be positive."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy("int64").view(np.uint64), shards).astype("int32"))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Only ``key`` and ``text`` are read, so further columns of any name do no harm. Null text has size 16 and the
    checksum of nothing. Null keys go where key 0 goes. Repeated rows each get a slot; ties in the key are ordered by
    checksum. An empty table gives no rows. The text itself is never shuffled.
    """
    wide = df.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(common.text_or_empty(text).cast("binary")).alias("text_crc32"),
    )
    rows = common.shared_table(wide, "shards")
    placed = rows.select("*", F.lit("key").alias("law"), jump_shard(F.col("doc_id"), shards).alias("shard"), jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
    out = common.ranked(placed, "shard", [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "slot", rows.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.documents(spark, sf_dir))
