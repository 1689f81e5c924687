"""Geometry layers derived from the star-schema tables by whole-number formulas, so that any engine gives the same.

The plane grows with the tables: 1,000 plots to a row, as many rows as there are parts. Density, and so the number of
matches per row, stays as it is at every scale. ``SQL`` holds the same layers as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by its key, for work that takes long per row: tables of a few columns are small files, and a small file
    is one task."""
    return df.repartition(key)


def div(a: Column, n: int) -> Column:
    return F.floor(a / n)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building_id, min_x, min_y, max_x, max_y, height."""
    k = F.col("p_partkey")
    x, y = (k % 1000) * 16, div(k, 1000) * 32
    return table(spark, sf_dir, "part", "p_partkey").select(
        k.alias("building_id"), x.cast("double").alias("min_x"), y.cast("double").alias("min_y"),
        (x + 8 + k % 5).cast("double").alias("max_x"), (y + 8 + k % 9).cast("double").alias("max_y"), (5 + (k % 40) * 0.25).alias("height"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, cls (2 ground, 6 roof), x, y, z in whole hundredths."""
    ok, ln, pk, sk = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    ground = ln % 3 == 0
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(
        (sk % 2).alias("tile"), F.when(ground, 2).otherwise(6).alias("cls"),
        ((pk % 1000) * 16 + (ok * 13 + ln * 7) % 14 - 0.5).cast("double").alias("x"), (div(pk, 1000) * 32 + (ok * 29 + sk) % 18 - 1.5).cast("double").alias("y"),
        F.when(ground, 100 + ok % 50).otherwise(1000 + (ok % 5) * 220).alias("z"),
    )


def meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mesh_id, priority (0 first), box and mesh_height."""
    k = F.col("c_custkey")
    x, y = (k * 3 % 1000) * 16 + k % 4 * 3, div(k * 3, 1000) * 32 + k % 5
    return table(spark, sf_dir, "customer", "c_custkey").select(
        k.alias("mesh_id"), (k % 3).alias("priority"), x.cast("double").alias("mx0"), y.cast("double").alias("my0"),
        (x + 4 + k % 7).cast("double").alias("mx1"), (y + 4 + k % 8).cast("double").alias("my1"), (4 + (k % 50) * 0.25).alias("mesh_height"),
    )


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to five narrow houses side by side; every seventh keeps a gap on its left."""
    k = F.col("p_partkey")
    x, y = (k % 5) * 5 + div(k, 5) % 200 * 40, div(k, 1000) * 40
    gap = F.when(k % 7 == 0, 2).otherwise(0)
    return table(spark, sf_dir, "part", "p_partkey").select(
        k.alias("building_id"), (x + gap).cast("double").alias("min_x"), y.cast("double").alias("min_y"), (x + 5).cast("double").alias("max_x"), (y + 16).cast("double").alias("max_y"), (6 + k % 3).cast("double").alias("height"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lot_id, ring and height: groups of five lots of six sorts, so that every kind of building context occurs. Sorts: row,
    pair, single narrow house, hall, single wide house, tower. In every other row one house is much taller."""
    k = F.col("p_partkey")
    group, i = div(k, 5), k % 5
    sort = group % 6
    x = (group % 40) * 200 + F.when(sort == 0, i * 5).when((sort == 1) & (i < 2), i * 5).otherwise(i * 40)
    y = div(group, 40) * 60
    wide = F.when(sort <= 2, 5).when(sort == 3, 30).otherwise(12)
    deep = F.when(sort <= 2, 16).when(sort == 3, 20).otherwise(15)
    height = F.when((sort == 0) & (i == 4) & (div(group, 6) % 2 == 1), 15).when(sort == 5, 25).otherwise(9)
    return table(spark, sf_dir, "part", "p_partkey").select(
        k.alias("lot_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + wide).cast("double").alias("x1"), (y + deep).cast("double").alias("y1"), height.cast("double").alias("height")
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, cx, cy, rx, ry: diamonds (a ring of four corners) over the buildings; they overlap each other."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier", "s_suppkey").select(
        k.alias("zone_id"), (k * 37 % 1000 * 16 + 0.3).cast("double").alias("cx"), (div(k * 7, 50) % 4 * 32 + 9.7).cast("double").alias("cy"), (k % 5 * 20 + 30.1).cast("double").alias("rx"), (k % 3 * 10 + 20.9).cast("double").alias("ry")
    )


def cells(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """row, col, value: samples on a grid that grows in rows."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        div(k, 4 * width).cast("long").alias("row"), (c * 7 % width).cast("long").alias("col"), ((k * 31 + c) % 400 * 0.25).cast("double").alias("value")
    )


def tiles(spark: SparkSession, sf_dir: str, level: int = 8) -> DataFrame:
    """z, x, y, part: leaves of a pyramid with a whole number each."""
    k = F.col("p_partkey")
    side = 1 << level
    return table(spark, sf_dir, "part", "p_partkey").where(k % 3 != 0).select(
        F.lit(level).alias("z"), (k * 5 % side).cast("long").alias("x"), (k * 11 % side).cast("long").alias("y"), (k * 7919 % 65521).cast("long").alias("value")
    ).groupBy("z", "x", "y").agg(F.max("value").alias("value"))


SQL = {
    "buildings": """buildings AS (SELECT p_partkey AS building_id, ((p_partkey%1000)*16)::DOUBLE AS min_x, ((p_partkey//1000)*32)::DOUBLE AS min_y,
        ((p_partkey%1000)*16+8+p_partkey%5)::DOUBLE AS max_x, ((p_partkey//1000)*32+8+p_partkey%9)::DOUBLE AS max_y, (5+(p_partkey%40)*0.25)::DOUBLE AS height FROM part)""",
    "points": """points AS (SELECT l_suppkey%2 AS tile, CASE WHEN l_linenumber%3=0 THEN 2 ELSE 6 END AS cls,
        ((l_partkey%1000)*16+(l_orderkey*13+l_linenumber*7)%14-0.5)::DOUBLE AS x, ((l_partkey//1000)*32+(l_orderkey*29+l_suppkey)%18-1.5)::DOUBLE AS y,
        CASE WHEN l_linenumber%3=0 THEN 100+l_orderkey%50 ELSE 1000+(l_orderkey%5)*220 END AS z FROM lineitem)""",
    "meshes": """meshes AS (SELECT c_custkey AS mesh_id, c_custkey%3 AS priority, ((c_custkey*3%1000)*16+c_custkey%4*3)::DOUBLE AS mx0, ((c_custkey*3//1000)*32+c_custkey%5)::DOUBLE AS my0,
        ((c_custkey*3%1000)*16+c_custkey%4*3+4+c_custkey%7)::DOUBLE AS mx1, ((c_custkey*3//1000)*32+c_custkey%5+4+c_custkey%8)::DOUBLE AS my1, (4+(c_custkey%50)*0.25)::DOUBLE AS mesh_height FROM customer)""",
    "houses": """houses AS (SELECT p_partkey AS building_id, ((p_partkey%5)*5+(p_partkey//5)%200*40+CASE WHEN p_partkey%7=0 THEN 2 ELSE 0 END)::DOUBLE AS min_x, ((p_partkey//1000)*40)::DOUBLE AS min_y,
        ((p_partkey%5)*5+(p_partkey//5)%200*40+5)::DOUBLE AS max_x, ((p_partkey//1000)*40+16)::DOUBLE AS max_y, (6+p_partkey%3)::DOUBLE AS height FROM part)""",
    "lots": """l0 AS (SELECT p_partkey AS lot_id, p_partkey//5 AS g, p_partkey%5 AS i, p_partkey//5%6 AS sort FROM part),
        lots AS (SELECT lot_id, g, i, sort, (g%40*200 + CASE WHEN sort=0 OR (sort=1 AND i<2) THEN i*5 ELSE i*40 END)::DOUBLE AS x0, (g//40*60)::DOUBLE AS y0, CASE WHEN sort<=2 THEN 5 WHEN sort=3 THEN 30 ELSE 12 END AS wide,
        CASE WHEN sort<=2 THEN 16 WHEN sort=3 THEN 20 ELSE 15 END AS deep, (CASE WHEN sort=0 AND i=4 AND g//6%2=1 THEN 15 WHEN sort=5 THEN 25 ELSE 9 END)::DOUBLE AS height FROM l0)""",
    "zones": """zones AS (SELECT s_suppkey AS zone_id, (s_suppkey*37%1000*16+0.3)::DOUBLE AS cx, (s_suppkey*7//50%4*32+9.7)::DOUBLE AS cy, (s_suppkey%5*20+30.1)::DOUBLE AS rx, (s_suppkey%3*10+20.9)::DOUBLE AS ry FROM supplier)""",
    "cells": """cells AS (SELECT o_orderkey//256 AS "row", o_custkey*7%64 AS col, ((o_orderkey*31+o_custkey)%400*0.25)::DOUBLE AS value FROM orders)""",
    "tiles": """tiles AS (SELECT 8 AS z, p_partkey*5%256 AS x, p_partkey*11%256 AS y, max(p_partkey*7919%65521) AS value FROM part WHERE p_partkey%3<>0 GROUP BY ALL)""",
}


def ctes(*names: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(SQL[n] for n in names)
