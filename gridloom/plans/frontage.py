"""Addresses matched to street segments by name, house range and parity, and then to one edge or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import windows as O
from ..sources import layers as L

BLOCK = 100
_NAMES = ["n. Broad Street", "MARKET ST.", "South 5th Avenue", "Spruce  Lane", "Unnamed"]
_LABELS = ["N BROAD ST", "MARKET ST", "S 5TH AVE", "SPRUCE LN"]


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    number = 2 + k % 40 * 10 + k % 3
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 5 + 1).cast("int"))
    said = F.concat(number.cast("string"), F.when(k % 4 == 0, F.concat(F.lit("-"), (number + 2 + k % 8 % 3).cast("string"))).otherwise(""), F.lit(" "), name, F.when(k % 6 == 0, " # 2").otherwise(""))
    return L.table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", said.alias("said"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: street, house range, distance of the segment from its houses."""
    k = F.col("s_suppkey")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (k % 4 + 1).cast("int"))
    return L.table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", label.alias("label"), (k % 10 * 40 + k % 2).alias("a"), (k % 10 * 40 + k % 2 + 80).alias("b"), (k % 16 * 0.5).alias("away"))


def frontage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address with its outcome: unparsed, unmatched, ambiguous or accepted with its segment. The join's key is the
    street's label, the parity and a block of ``BLOCK`` numbers: a segment is dealt to its blocks, an address lies in the
    block of its first number, so that a long street is no single key. Addresses are parsed once, before a shuffle. A number is
    matched once however many addresses have it, and of segments with one range only the two nearest can decide."""
    parsed = addresses(spark, sf_dir).withColumn("p", text.address(F.col("said"))).repartition("c_custkey")
    parsed = parsed.select("c_custkey", F.col("p").isNotNull().alias("known"), "p.label", "p.first", "p.last")
    numbers = parsed.where("known").select("label", "first", "last").distinct().withColumns({"block": F.floor(F.col("first") / BLOCK), "odd": F.col("first") % 2})
    nearest = O.nearest_two(streets(spark, sf_dir), ["label", "a", "b"], "s_suppkey", "away")
    dealt = nearest.select("*", (F.col("a") % 2).alias("odd"), F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor(F.col("b") / BLOCK))).alias("block"))
    met = numbers.join(dealt, ["label", "block", "odd"]).where(text.range_fits(F.col("a"), F.col("b"), F.col("first"), F.col("last")))
    won = O.clear_winner(met, ["label", "first", "last"], "s_suppkey", "away", 1.0)
    outcome = F.when(~F.col("known"), "unparsed").when(F.col("status").isNull(), "unmatched").otherwise(F.col("status"))
    return parsed.join(won, ["label", "first", "last"], "left").select("c_custkey", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "label", "s_suppkey", outcome.alias("outcome"))


_SQL = """WITH k AS (SELECT c_custkey, 2+c_custkey%40*10+c_custkey%3 AS f, c_custkey%5 AS s FROM customer),
    r AS (SELECT c_custkey, f, CASE WHEN c_custkey%4=0 THEN f+2+c_custkey%8%3 ELSE f END AS l, ['N BROAD ST','MARKET ST','S 5TH AVE','SPRUCE LN',NULL][s+1] AS label FROM k),
    p AS (SELECT c_custkey, CASE WHEN label IS NOT NULL AND f%2=l%2 THEN f END AS first, CASE WHEN label IS NOT NULL AND f%2=l%2 THEN l END AS last, CASE WHEN f%2=l%2 THEN label END AS label FROM r),
    st AS (SELECT s_suppkey, ['N BROAD ST','MARKET ST','S 5TH AVE','SPRUCE LN'][s_suppkey%4+1] AS label, s_suppkey%10*40+s_suppkey%2 AS a, s_suppkey%10*40+s_suppkey%2+80 AS b, s_suppkey%16*0.5 AS away FROM supplier),
    m AS (SELECT c_custkey, s_suppkey, away, row_number() OVER w AS n, lead(away) OVER w - away AS margin FROM p JOIN st ON p.label=st.label AND a<=first AND last<=b AND a%2=first%2 WINDOW w AS (PARTITION BY c_custkey ORDER BY away, s_suppkey)),
    won AS (SELECT c_custkey, CASE WHEN coalesce(margin,9)>=1 THEN s_suppkey END AS s_suppkey, CASE WHEN coalesce(margin,9)>=1 THEN 'accepted' ELSE 'ambiguous' END AS status FROM m WHERE n=1),
    o AS (SELECT p.*, s_suppkey, CASE WHEN first IS NULL THEN 'unparsed' ELSE coalesce(status, 'unmatched') END AS outcome FROM p LEFT JOIN won USING (c_custkey))"""


def frontage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontage(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("streets"))


QUERIES = {
    "frontage_match": (frontage, _SQL + " SELECT c_custkey, first, last, label, s_suppkey, outcome FROM o"),
    "frontage_funnel": (frontage_funnel, _SQL + " SELECT outcome, count(*) AS n, count(DISTINCT label) AS streets FROM o GROUP BY outcome"),
}
