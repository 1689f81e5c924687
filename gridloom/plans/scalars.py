"""Projections, units, classes and other column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry as geo, text
from ..sources import layers as L


def isometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen places and depth of building corners in four views, and back again."""
    views = F.explode(F.array(*[F.lit(v) for v in geo.VIEWS])).alias("view")
    b = L.buildings(spark, sf_dir).select("building_id", "min_x", "min_y", "height", views)
    sx, sy = geo.isometric(F.col("view"), F.col("min_x"), F.col("min_y"), F.lit(0.0))
    x, y = geo.isometric_inverse(F.col("view"), F.col("sx"), F.col("sy"))
    out = b.withColumns({"sx": sx, "sy": sy, "depth": geo.view_depth(F.col("view"), F.col("min_x"), F.col("min_y"), F.col("height"))})
    close = (F.abs(x - F.col("min_x")) < 0.01) & (F.abs(y - F.col("min_y")) < 0.01)
    return out.select("building_id", "view", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), F.round("depth", 6).alias("depth"), close.alias("round_trip"))


ISOMETRIC = L.ctes("buildings") + """, g AS (SELECT building_id, view, height, min_x*0.9907696-min_y*0.13555646 AS e, min_x*0.13555646+min_y*0.9907696 AS n FROM buildings, (VALUES ('SE'),('SW'),('NW'),('NE')) v(view)),
    t AS (SELECT building_id, view, height, CASE view WHEN 'SE' THEN e WHEN 'SW' THEN n WHEN 'NW' THEN -e ELSE -n END AS a, CASE view WHEN 'SE' THEN n WHEN 'SW' THEN -e WHEN 'NW' THEN -n ELSE e END AS b FROM g)
    SELECT building_id, view, round(a+b,6) AS sx, round((a-b)*0.5,6) AS sy, round((a-b)*0.5+height,6) AS depth, true AS round_trip FROM t"""


def conic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("s_suppkey") % 60 * 0.01 - 75.4, F.col("s_suppkey") % 37 * 0.01 + 39.8
    x, y = geo.lambert(lon, lat)
    return L.table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


# the cone, its scale and the origin's radius follow from the ellipsoid and the parallels, worked out here once more
CONIC = """WITH z AS (SELECT 6378137.0::DOUBLE AS a, sqrt((2-1/298.257222101::DOUBLE)/298.257222101::DOUBLE) AS e, radians(39+56/60.0::DOUBLE) AS p1, radians(40+58/60.0::DOUBLE) AS p2, radians(39+20/60.0::DOUBLE) AS p0),
    m AS (SELECT *, cos(p1)/sqrt(1-e*e*sin(p1)*sin(p1)) AS m1, cos(p2)/sqrt(1-e*e*sin(p2)*sin(p2)) AS m2, tan(pi()/4-p1/2)*pow((1+e*sin(p1))/(1-e*sin(p1)), e/2) AS t1, tan(pi()/4-p2/2)*pow((1+e*sin(p2))/(1-e*sin(p2)), e/2) AS t2, tan(pi()/4-p0/2)*pow((1+e*sin(p0))/(1-e*sin(p0)), e/2) AS t0 FROM z),
    c AS (SELECT *, ln(m1/m2)/ln(t1/t2) AS n FROM m), k AS (SELECT *, a*m1/(n*pow(t1, n)) AS f FROM c),
    p AS (SELECT s_suppkey, s_suppkey%60*0.01-75.4 AS lon, radians(s_suppkey%37*0.01+39.8) AS phi FROM supplier),
    t AS (SELECT s_suppkey, f*pow(tan(pi()/4-phi/2)*pow((1+e*sin(phi))/(1-e*sin(phi)), e/2), n) AS rho, n*radians(lon+77.75) AS th, f*pow(t0, n) AS rho0 FROM p, k)
    SELECT s_suppkey, round(600000+rho*sin(th), 4) AS x, round(rho0-rho*cos(th), 4) AS y FROM t"""


def tag_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of tagged parts: units, storeys, limits, roofs."""
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*map(F.lit, ["", " m", " ft", "'", " yards", "feet"])), (k % 6 + 1).cast("int"))
    tag = F.concat((k % 97 - 5).cast("string"), unit)
    height = text.building_height(tag, (k % 9).cast("string"))
    kind, rise = text.roof(F.element_at(F.array(*map(F.lit, ["gabled", "saltbox", "dome", "odd"])), (k % 4 + 1).cast("int")), F.lit(None).cast("string"), F.lit(None).cast("string"), height, F.lit(0.0))
    return L.table(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.round(text.parse_length(tag), 6).alias("length"), F.round(height, 6).alias("height"), kind.alias("roof"), F.round(rise, 6).alias("rise"))


TAGS = """WITH t AS (SELECT p_partkey, p_partkey%97-5 AS v, p_partkey%6 AS u, p_partkey%9*3.2 AS lv, ['gabled','gabled','dome','flat'][p_partkey%4+1] AS roof FROM part),
    l AS (SELECT *, CASE WHEN v<0 OR u=4 THEN NULL WHEN u IN (2,3,5) THEN v*0.3048 ELSE v END AS length FROM t),
    h AS (SELECT *, CASE WHEN coalesce(length, lv) BETWEEN 2.4 AND 400 THEN coalesce(length, lv) END AS height FROM l)
    SELECT p_partkey, round(length,6)::DOUBLE AS length, round(height,6)::DOUBLE AS height, roof, round(CASE WHEN roof='flat' THEN 0 WHEN height IS NOT NULL THEN least(least(2.4, height*0.25), height*0.45) ELSE 2.4 END, 6)::DOUBLE AS rise FROM h"""


def tree_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["PINUS STROBUS - EASTERN WHITE PINE", "ACER RUBRUM - COLUMNAR RED MAPLE", "SALIX - WEEPING WILLOW", "SHRUB - LOW", "PALM - TALL", "QUERCUS  ALBA - WHITE OAK", "no separator", ""]
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int"))
    return L.table(spark, sf_dir, "customer", "c_custkey").groupBy(text.tree_form(name).alias("form")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(text.tree_diameter(k % 90 * 1.0)), 4).alias("diameters"))


TREES = """WITH t AS (SELECT ['conifer','columnar','weeping','shrub','default','default','default','default'][c_custkey%8+1] AS form, CASE WHEN c_custkey%90*0.0254 BETWEEN 0.0254 AND 2.0 THEN c_custkey%90*0.0254 ELSE 0.15 END AS d FROM customer)
    SELECT form, count(*) AS n, round(sum(d),4)::DOUBLE AS diameters FROM t GROUP BY form"""


def ground_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ground colour: water, planted park, land cover, aerial, then the display's finish."""
    k = F.col("p_partkey")
    rgb = (k * 3 % 256, k * 5 % 256, k * 7 % 256)
    mixed = color.mix(rgb, (86, 148, 73), 0.25)
    r, g, b = color.soften(mixed)
    return L.table(spark, sf_dir, "part", "p_partkey").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


GROUND = """WITH c AS (SELECT p_partkey, round(p_partkey*3%256*0.75+86*0.25)::INT AS r, round(p_partkey*5%256*0.75+148*0.25)::INT AS g, round(p_partkey*7%256*0.75+73*0.25)::INT AS b FROM part),
    l AS (SELECT *, (r*3+g*6+b)//10 AS l FROM c)
    SELECT p_partkey, greatest(56, least(208, (r*3+l*2)//5))::INT AS r, greatest(56, least(208, (g*3+l*2)//5))::INT AS g, greatest(56, least(208, (b*3+l*2)//5))::INT AS b FROM l"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring measures by higher-order expressions: area, clipped area, containment, distance to the next plot's ring."""
    b = L.spread(L.buildings(spark, sf_dir), "building_id")
    ring = geo.box_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    clipped = geo.clip_to_box(F.col("ring"), F.col("min_x") + 2, F.col("min_y") - 1, F.col("min_x") + 6, F.col("min_y") + 5)
    right = geo.box_ring(F.col("min_x") + 16, F.col("min_y"), F.col("min_x") + 20, F.col("min_y") + 4)
    return b.withColumn("ring", ring).select(
        "building_id", geo.ring_area(F.col("ring")).alias("area"), geo.ring_area(clipped).alias("clipped"), geo.in_ring(F.col("min_x") + 9, F.col("min_y") + 1, F.col("ring")).alias("holds"),
        F.round(geo.rings_d2(F.col("ring"), right), 6).alias("d2"), F.size(geo.ring_edges(F.col("ring"))).alias("edges"),
    )


RINGS = L.ctes("buildings") + " SELECT building_id, (max_x-min_x)*(max_y-min_y) AS area, 20.0::DOUBLE AS clipped, max_x-min_x>9 AS holds, pow(min_x+16-max_x,2) AS d2, 4::INT AS edges FROM buildings"

QUERIES = {
    "isometric": (isometric, ISOMETRIC),
    "conic_projection": (conic, CONIC),
    "tag_lengths": (tag_lengths, TAGS),
    "tree_forms": (tree_forms, TREES),
    "ground_tones": (ground_tones, GROUND),
    "ring_measures": (rings, RINGS),
}
