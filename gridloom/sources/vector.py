"""Vector and listing sources: GeoJSON features, tagged building parts, file listings in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "remark string, elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
FEATURES = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def building_parts(spark: SparkSession, path: str) -> DataFrame:
    """id, tags and ring (lon as x, lat as y) of ways tagged as building parts with four points or more. A server's remark
    means that its answer is cut short: the read fails."""
    whole = spark.read.schema(PARTS).json(path, multiLine=True, mode="FAILFAST")
    fine = F.when(F.col("remark").isNull(), F.col("elements")).otherwise(F.raise_error(F.concat(F.lit("the source reports: "), F.coalesce("remark", F.lit("")))))
    ways = whole.select(F.explode(fine).alias("e")).where((F.col("e.type") == "way") & F.col("e.tags")["building:part"].isNotNull() & (F.col("e.tags")["building:part"] != "no"))
    ring = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return ways.where(F.size("e.geometry") >= 4).select("e.id", "e.tags", ring.alias("ring"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """properties, ring (the outer one, not closed) and holes of GeoJSON polygons, each part of a MultiPolygon a row. A
    collection without features fails."""
    whole = spark.read.schema(FEATURES).json(path, multiLine=True, mode="FAILFAST")
    some = F.when(F.size("features") > 0, F.col("features")).otherwise(F.raise_error(F.lit("the collection has no features")))
    shapes = whole.select(F.explode(some).alias("f")).where("f.geometry.type in ('Polygon', 'MultiPolygon')")
    rings = "array<array<array<double>>>"
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", rings))).otherwise(F.from_json("f.geometry.coordinates", f"array<{rings}>"))
    open_ring = lambda r: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    each = shapes.select(F.col("f.properties").alias("properties"), F.explode(parts).alias("part"))
    return each.select("properties", open_ring(F.col("part")[0]).alias("ring"), F.transform(F.slice("part", F.lit(2), F.size("part")), open_ring).alias("holes"))


def links(pages: DataFrame, html: str = "html") -> Column:
    return F.regexp_extract_all(F.col(html), F.lit(r'href="([^"#?]+)'), F.lit(1))


def listing(pages: DataFrame, keys: list[str], suffix: str, html: str = "html") -> DataFrame:
    """Distinct names with a suffix that a directory page links to, and their place (from 0) in the page's sorted list."""
    names = F.array_sort(F.array_distinct(F.filter(links(pages, html), lambda n: F.lower(n).endswith(suffix))))
    return pages.select(*keys, F.posexplode(names).alias("place", "name"))


def tile_bounds(name: Column, unit: float = 100.0, size: float = 2_640.0) -> Column:
    """Bounds of a tile named by its corner, as in ``26453E230645N.las``; null for other names."""
    pattern = r"(\d{4,6})E(\d{4,6})N"
    x, y = (F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k).cast("double") * unit) for k in (1, 2))
    return F.when(x.isNotNull(), F.struct(x.alias("min_x"), y.alias("min_y"), (x + size).alias("max_x"), (y + size).alias("max_y")))
