"""Tile pyramids, whole and incremental."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import pyramid as P
from ..operators.graph import checkpoint
from ..sources import layers as L

LEVELS = 4


def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pyramid(L.tiles(spark, sf_dir), 8 - LEVELS)


def _pyramid_sql(base: str) -> str:
    up = "".join(f", l{k} AS (SELECT {8 - k} AS z, x//2 AS x, y//2 AS y, floor(sum(value)/4)::BIGINT AS value FROM l{k - 1} GROUP BY ALL)" for k in range(1, LEVELS + 1))
    return f", l0 AS (SELECT 8 AS z, x, y, value FROM {base})" + up + " " + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(LEVELS + 1))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some leaves get another value, some go."""
    k = F.col("x") * 256 + F.col("y")
    return L.tiles(spark, sf_dir).where(k % 13 == 0).withColumn("value", F.when(k % 2 == 0, F.col("value") + 400))


def incremental_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a pyramid built anew over the changed leaves."""
    return P.roll_up_dirty(checkpoint(tile_pyramid(spark, sf_dir)), changed(spark, sf_dir), 8, 8 - LEVELS)


INCREMENTAL = L.ctes("tiles") + """, now AS (SELECT x, y, CASE WHEN (x*256+y)%13=0 THEN value+400 ELSE value END AS value FROM tiles WHERE NOT ((x*256+y)%13=0 AND (x*256+y)%2=1))""" + _pyramid_sql("now")


def ancestor_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(4096).select(F.lit(8).alias("z"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    have = tile_pyramid(spark, sf_dir).where("z in (5, 8)")
    return P.nearest_ancestor(wanted, have, LEVELS)


ANCESTOR = L.ctes("tiles") + """, w AS (SELECT i%64 AS x, i//64 AS y FROM range(4096) t(i)), h AS (SELECT 8 AS z, x, y FROM tiles UNION SELECT 5, x//8, y//8 FROM tiles)
    SELECT 8 AS z, w.x, w.y, max(h.z) AS from_z FROM w LEFT JOIN h ON h.x=w.x>>(8-h.z) AND h.y=w.y>>(8-h.z) GROUP BY w.x, w.y"""


def tile_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.blocks(L.tiles(spark, sf_dir))
    return b.select("bx", "by", F.size("tiles").alias("n"), F.sha2(F.array_join(F.transform("tiles", lambda t: F.concat_ws("/", t["x"], t["y"])), " "), 256).alias("digest"))


TILE_BLOCKS = L.ctes("tiles") + """ SELECT x//4 AS bx, y//4 AS by, count(*)::INT AS n, sha256(string_agg(x||'/'||y, ' ' ORDER BY x, y)) AS digest FROM tiles GROUP BY 1, 2"""


def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with their Z-order codes, range-partitioned along the curve."""
    return L.tiles(spark, sf_dir).select("x", "y", geo.morton(F.col("x"), F.col("y"), 8).alias("code")).repartitionByRange("code").sortWithinPartitions("code")


MORTON = L.ctes("tiles") + " SELECT x, y, (" + " + ".join(f"((x>>{k})&1)*{4**k} + ((y>>{k})&1)*{2 * 4**k}" for k in range(8)) + ") AS code FROM tiles"


def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' extents cut into regular cells, the last ones clipped."""
    w, h = F.col("s_suppkey") % 9 * 10 + 5.0, F.col("s_suppkey") % 4 * 8 + 3.0
    rows = L.table(spark, sf_dir, "supplier", "s_suppkey").withColumn("cx", F.explode(P.span_grid(F.lit(0.0), w, 16.0))).withColumn("cy", F.explode(P.span_grid(F.lit(0.0), h, 16.0)))
    return rows.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("cx.end") - F.col("cx.start")) * (F.col("cy.end") - F.col("cy.start"))).alias("area"))


COVERAGE_GRID = """SELECT s_suppkey, (ceil((s_suppkey%9*10+5)/16.0)*ceil((s_suppkey%4*8+3)/16.0))::BIGINT AS cells, ((s_suppkey%9*10+5)*(s_suppkey%4*8+3))::DOUBLE AS area FROM supplier"""

QUERIES = {
    "tile_pyramid": (tile_pyramid, L.ctes("tiles") + _pyramid_sql("tiles")),
    "incremental_pyramid": (incremental_pyramid, INCREMENTAL),
    "ancestor_fallback": (ancestor_fallback, ANCESTOR),
    "tile_blocks": (tile_blocks, TILE_BLOCKS),
    "morton_order": (morton_order, MORTON),
    "coverage_grid": (coverage_grid, COVERAGE_GRID),
}
