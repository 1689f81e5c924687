"""Artifacts that are written and read again: the packed world, rasters, pairs, GeoParquet; and the conic zone's inverse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.graph import shared_folder
from ..sources import geo, pair, rasters, world
from ..sources import layers as L
from .evidence import BOX


def _new(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def packed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings, trees and lines packed into a world and read again: records, points and sums of each layer."""
    ring = g.box_ring(*[F.col(c) for c in BOX])
    k = F.col("building_id")
    buildings = L.buildings(spark, sf_dir).select(k.alias("ord"), "height", ring.alias("ring"), F.when(k % 3 != 0, k % 4).cast("int").alias("frontage"))
    c = F.col("c_custkey")
    trees = L.table(spark, sf_dir, "customer", "c_custkey").select(c.alias("ord"), (c * 7 % 4096).cast("double").alias("x"), (c * 11 % 4096 * 0.5).alias("y"), (c % 60 * 0.03125 + 0.03125).alias("diameter"), (c % 6).cast("int").alias("form"))
    o = F.col("s_suppkey")
    line = F.array(g.point(o * 3, o * 5), g.point(o * 3 + 7, o * 5 + 2), g.point(o * 3 + 9, o * 5))
    lines = L.table(spark, sf_dir, "supplier", "s_suppkey").select(o.alias("ord"), (o % 3).cast("int").alias("kind"), line.alias("ring"))
    path = _new(spark, "world")
    world.write_world({"buildings": buildings, "trees": trees, "transport": lines}, path, (0.0, 0.0, 16_000.0, 16_000.0))
    read = lambda layer: spark.read.format("packed_world").option("layer", layer).load(path)
    place = F.col("ord").cast("double")
    b = read("buildings").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ring")).alias("points"), F.round(F.sum(g.ring_area(F.col("ring")) + F.col("height") + F.coalesce("frontage", F.lit(9))), 4).alias("total"), F.max(place).alias("last"))
    t = read("trees").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("points"), F.round(F.sum(F.col("x") + F.col("y") + F.col("diameter") + F.col("form")), 4).alias("total"), F.max(place).alias("last"))
    r = read("transport").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ring")).alias("points"), F.round(F.sum(F.col("ring")[1]["x"] + F.col("ring")[2]["y"] + F.col("kind")), 4).alias("total"), F.max(place).alias("last"))
    named = [df.select(F.lit(layer).alias("layer"), "n", "points", "total", "last") for layer, df in (("buildings", b), ("trees", t), ("transport", r))]
    return named[0].unionByName(named[1]).unionByName(named[2])


PACKED_WORLD = L.ctes("buildings") + """ SELECT 'buildings' AS layer, count(*) AS n, count(*)*4 AS points, round(sum((max_x-min_x)*(max_y-min_y)+height+CASE WHEN building_id%3<>0 THEN building_id%4 ELSE 9 END), 4) AS total, (count(*)-1)::DOUBLE AS last FROM buildings
    UNION ALL SELECT 'trees', count(*), count(*), round(sum((c_custkey*7%4096) + (c_custkey*11%4096)*0.5::DOUBLE + c_custkey%60*0.03125::DOUBLE+0.03125::DOUBLE + c_custkey%6), 4), (count(*)-1)::DOUBLE FROM customer
    UNION ALL SELECT 'transport', count(*), count(*)*3, round(sum(s_suppkey*3+7+s_suppkey*5+s_suppkey%3)::DOUBLE, 4), (count(*)-1)::DOUBLE FROM supplier"""

MASK = rasters.Grid(width=600, height=4096)
HEIGHTS = rasters.Grid(width=64, height=16_384, digits=4, lowest=-32_768, empty=-32_768)


def mask_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a land-cover mask by class and stretch of rows, once it was packed, audited and opened again."""
    k = F.col("l_orderkey")
    cells = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select((k % 4096).alias("row"), (k * 7 % 600).alias("col"), ((k + F.col("l_linenumber")) % 9).alias("value"))
    path = _new(spark, "mask")
    rasters.write(cells.groupBy("row", "col").agg(F.max("value").alias("value")), MASK, path)
    got, _ = rasters.open_raster(spark, path, MASK)
    return got.groupBy(F.col("value").alias("cls"), F.floor(F.col("row") / 512).alias("stretch")).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("row") * 600 + F.col("col")).alias("places"))


MASK_ARTIFACT = """WITH c AS (SELECT l_orderkey%4096 AS r, l_orderkey*7%600 AS q, max((l_orderkey+l_linenumber)%9) AS v FROM lineitem GROUP BY ALL)
    SELECT v AS cls, r//512 AS stretch, count(*) AS cells, sum(r*600+q)::BIGINT AS places FROM c WHERE v<>0 GROUP BY ALL"""


def terrain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of places from a terrain artifact, null where it has none."""
    sampled = L.cells(spark, sf_dir).groupBy("row", "col").agg(F.max(F.floor(F.col("value") * 100) - 4000).alias("value"))
    path = _new(spark, "terrain")
    rasters.write(sampled.where(F.col("row") < HEIGHTS.height), HEIGHTS, path)
    got, _ = rasters.open_raster(spark, path, HEIGHTS)
    k = F.col("c_custkey")
    places = L.table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", (k * 37 % 640 * 0.1 + 0.05).alias("x"), (k * 7 % 600 * 0.1 + 0.05).alias("y"))
    return rasters.at_cells(places, got, F.col("x"), F.col("y"), 1.0).select("c_custkey", F.col("value").alias("height"))


TERRAIN_LOOKUP = L.ctes("cells") + """, s AS (SELECT "row", col, max(floor(value*100)-4000)::BIGINT AS h FROM cells WHERE "row" < 16384 GROUP BY ALL)
    SELECT c_custkey, h AS height FROM customer LEFT JOIN s ON col = (c_custkey*37%640)//10 AND "row" = (c_custkey*7%600)//10"""


def exchanged_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and its description, exchanged twice: the second ones are read."""
    path = _new(spark, "pair")
    parts = L.table(spark, sf_dir, "part", "p_partkey", "p_size")
    pair.exchange(parts.where("p_partkey % 2 = 0"), path, {"version": 1}, ["p_partkey"])
    pair.exchange(parts.where("p_partkey % 3 = 0"), path, {"version": 2}, ["p_partkey"])
    rows, about = pair.read(spark, path)
    return rows.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("last")).withColumn("version", F.lit(about["version"]))


EXCHANGED_PAIR = "SELECT p_size, count(*) AS n, max(p_partkey) AS last, 2 AS version FROM part WHERE p_partkey%3=0 GROUP BY p_size"


def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures in degrees, projected, written as GeoParquet with their system, read, and brought back to degrees."""
    k = F.col("s_suppkey")
    lon, lat = k % 60 * 0.01 - 75.4, k % 37 * 0.01 + 39.8
    ring = F.array(g.point(lon, lat), g.point(lon, lat + 0.01), g.point(lon + 0.01, lat))
    figures = geo.with_crs(L.table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", F.array(ring).alias("rings")), geo.DEGREES)
    path = _new(spark, "geoparquet")
    geo.write_geoparquet(geo.projected(figures), path, cell=1_000.0)
    back = geo.unprojected(geo.read_geoparquet(spark, path))
    p = F.explode(F.col("rings")[0]).alias("p")
    return back.select("s_suppkey", p).select("s_suppkey", F.round("p.x", 8).alias("lon"), F.round("p.y", 8).alias("lat"))


REPROJECTION = """WITH p AS (SELECT s_suppkey, s_suppkey%60*0.01-75.4 AS lon, s_suppkey%37*0.01+39.8 AS lat FROM supplier)
    SELECT s_suppkey, round((lon + a)::DOUBLE, 8) AS lon, round((lat + b)::DOUBLE, 8) AS lat FROM p, (VALUES (0, 0), (0, 0.01), (0.01, 0)) t(a, b)"""

QUERIES = {
    "packed_world": (packed_world, PACKED_WORLD),
    "mask_artifact": (mask_artifact, MASK_ARTIFACT),
    "terrain_lookup": (terrain_lookup, TERRAIN_LOOKUP),
    "exchanged_pair": (exchanged_pair, EXCHANGED_PAIR),
    "reprojection": (reprojection, REPROJECTION),
}
