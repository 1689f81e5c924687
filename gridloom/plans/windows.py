"""Timelines, queues and ordered choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as O
from ..sources import layers as L


def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.gap_profile(L.table(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), "event_id")


FRAME_GAPS = """WITH s AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
    SELECT user_id, count(*) AS n, max(t-b) AS largest_gap, arg_max(b, (t-b, -b)) FILTER (b IS NOT NULL) AS gap_starts, coalesce(bool_and(t-b>0), true) AS strictly_rising FROM s GROUP BY user_id"""


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.contiguous(L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


LINE_NUMBERS = """SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, max(l_linenumber)-min(l_linenumber)+1=count(DISTINCT l_linenumber) AND count(DISTINCT l_linenumber)=count(*) AS contiguous FROM lineitem GROUP BY l_orderkey"""


def clear_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey").withColumn("distance", F.col("l_partkey") % 40 * 0.25)
    return O.clear_winner(rows, ["l_orderkey"], "l_suppkey", "distance", 2.0)


CLEAR_WINNER = """WITH b AS (SELECT l_orderkey, l_suppkey, min(l_partkey%40*0.25)::DOUBLE AS distance FROM lineitem GROUP BY ALL),
    n AS (SELECT *, row_number() OVER w AS n, lead(distance) OVER w AS nx FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY distance, l_suppkey))
    SELECT l_orderkey, CASE WHEN coalesce(nx-distance>=2, true) THEN l_suppkey END AS l_suppkey, distance, CASE WHEN coalesce(nx-distance>=2, true) THEN 'accepted' ELSE 'ambiguous' END AS status FROM n WHERE n=1"""


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("bytes", F.col("o_orderkey") % 100 + 1)
    return O.evict(rows, "o_custkey", "bytes", ["o_orderdate", "o_orderkey"], 300).select("o_custkey", "o_orderkey", "bytes")


EVICTION = """SELECT o_custkey, o_orderkey, o_orderkey%100+1 AS bytes FROM orders
    QUALIFY sum(o_orderkey%100+1) OVER (PARTITION BY o_custkey) - coalesce(sum(o_orderkey%100+1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 300"""


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next tiles to work on: smallest first, then by name; those done are out."""
    done = L.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").where("o_orderkey % 7 < 3").select(F.col("o_custkey").alias("c_custkey"))
    rows = L.table(spark, sf_dir, "customer", "c_custkey", "c_name").join(done, "c_custkey", "left_anti").withColumn("bytes", F.col("c_custkey") * 37 % 1009)
    return rows.orderBy("bytes", "c_name").limit(50)


QUEUE = "SELECT c_custkey, c_name, c_custkey*37%1009 AS bytes FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderkey%7<3) ORDER BY bytes, c_name LIMIT 50"


def nearest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred tiles nearest to a centre within a radius."""
    d2 = F.pow(F.col("x") - 100, 2) + F.pow(F.col("y") - 100, 2)
    return L.tiles(spark, sf_dir).withColumn("d2", d2).where("d2 <= 3600").orderBy("d2", "y", "x").limit(100).select("x", "y", "d2")


NEAREST_FIRST = L.ctes("tiles") + " SELECT x, y, pow(x-100,2)+pow(y-100,2) AS d2 FROM tiles WHERE pow(x-100,2)+pow(y-100,2)<=3600 ORDER BY d2, y, x LIMIT 100"


def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's last entry for each key, from an append-only log."""
    log = L.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return log.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("entries"))


LATEST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS entries FROM events GROUP BY user_id"

QUERIES = {
    "frame_gaps": (frame_gaps, FRAME_GAPS),
    "line_numbers": (line_numbers, LINE_NUMBERS),
    "clear_winner": (clear_winner, CLEAR_WINNER),
    "cache_eviction": (cache_eviction, EVICTION),
    "queue_order": (queue_order, QUEUE),
    "nearest_first": (nearest_first, NEAREST_FIRST),
    "latest_progress": (latest_progress, LATEST),
}
