"""Polygon repair, union, clip and simplification, and joins with figures that have holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import polygons as P
from ..operators import spatial as S
from ..sources import layers as L
from .evidence import MESH


def ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[g.point(x, y) for x, y in corners])


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """figure_id, rings: a bow tie, a frame whose hole is drawn the same way round, two squares that overlap, a box with a
    spike; sorts by turns."""
    k = F.col("p_partkey")
    x, y, w, h = k % 1000 * 40, L.div(k, 1000) * 40, k % 7 * 2 + 6, k % 5 * 2 + 6
    box = g.box_ring(x, y, x + w, y + h)
    tie = ring((x, y), (x + w, y + h), (x + w, y), (x, y + h))
    inner = g.box_ring(x + 2, y + 2, x + w - 2, y + h - 2)
    shifted = g.box_ring(x + w / 2, y + h / 2, x + w * 1.5, y + h * 1.5)
    spike = ring((x, y), (x + w, y), (x + w, y + h), (x + w + 5, y + h), (x + w, y + h), (x, y + h))
    rings = F.when(k % 4 == 0, F.array(tie)).when(k % 4 == 1, F.array(box, inner)).when(k % 4 == 2, F.array(box, shifted)).otherwise(F.array(spike))
    return L.table(spark, sf_dir, "part", "p_partkey").select(k.alias("figure_id"), rings.alias("rings"))


def _measured(found: DataFrame, *keys: str) -> DataFrame:
    """Polygons, holes, corners and area of each key."""
    corners = F.aggregate(F.transform("rings", lambda r: F.size(r)), F.lit(0), lambda s, n: s + n)
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("polygons"), F.sum(F.size("rings") - 1).alias("holes"), F.sum(corners).alias("corners"), F.round(F.sum("area"), 6).alias("area"))


def polygon_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each figure once its edges are noded and covered an odd number of times."""
    return _measured(P.repair(figures(spark, sf_dir), ["figure_id"]), "figure_id")


POLYGON_REPAIR = """WITH f AS (SELECT p_partkey AS figure_id, p_partkey%4 AS sort, (p_partkey%7*2+6)::DOUBLE AS w, (p_partkey%5*2+6)::DOUBLE AS h FROM part)
    SELECT figure_id, CASE WHEN sort IN (0, 2) THEN 2 ELSE 1 END AS polygons, CASE WHEN sort=1 THEN 1 ELSE 0 END AS holes, CASE sort WHEN 0 THEN 6 WHEN 1 THEN 8 WHEN 2 THEN 12 ELSE 4 END AS corners,
        CASE sort WHEN 0 THEN w*h/2 WHEN 1 THEN w*h-(w-4)*(h-4) WHEN 2 THEN w*h*1.5 ELSE w*h END AS area FROM f"""

#: Area, corners, and polygons less holes, of sets of unit cells (key, i, j).
_CELLS = """q AS (SELECT key, i + a AS vx, j + b AS vy, count(*) AS n, sum((1-a) + 2*(1-b)) AS s FROM cells, range(2) x(a), range(2) y(b) GROUP BY ALL),
    v AS (SELECT key, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n=2 AND s=3 THEN 2 ELSE 0 END)::BIGINT AS corners, count(*) FILTER (n=4) AS full FROM q GROUP BY key),
    e AS (SELECT a.key, count(*) AS shared FROM cells a JOIN cells b ON a.key=b.key AND ((b.i=a.i+1 AND b.j=a.j) OR (b.i=a.i AND b.j=a.j+1)) GROUP BY a.key),
    m AS (SELECT key, count(*) AS n FROM cells GROUP BY key),
    found AS (SELECT m.key, m.n::DOUBLE AS area, corners, m.n - coalesce(shared, 0) + v.full AS balance FROM m JOIN v ON m.key=v.key LEFT JOIN e ON e.key=m.key)"""


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """district_id, rings: twenty boxes to a district; they overlap, touch or lie apart."""
    k = F.col("p_partkey")
    d = L.div(k, 20)
    x, y = d % 100 * 50 + k * 37 % 31, L.div(d, 100) * 50 + k * 53 % 29
    return L.table(spark, sf_dir, "part", "p_partkey").select(d.alias("district_id"), F.array(g.box_ring(x, y, x + k % 5 + 3, y + k % 4 + 3)).alias("rings"))


def polygon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, corners, and polygons less holes, of what each district's boxes cover together."""
    found = _measured(P.union(L.spread(districts(spark, sf_dir), "district_id"), ["district_id"]), "district_id")
    return found.select("district_id", "area", "corners", (F.col("polygons") - F.col("holes")).alias("balance"))


POLYGON_UNION = f"""WITH b AS (SELECT p_partkey AS k, p_partkey//20 AS d, (p_partkey//20)%100*50 + p_partkey*37%31 AS x, (p_partkey//20)//100*50 + p_partkey*53%29 AS y FROM part),
    r AS (SELECT d, x, y, unnest(range(x, x + k%5 + 3)) AS i, k FROM b), cells AS (SELECT DISTINCT d AS key, i, unnest(range(y, y + k%4 + 3)) AS j FROM r),
    {_CELLS} SELECT key AS district_id, area, corners, balance FROM found"""


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plot_id, rings: concave plots, an L each."""
    k = F.col("p_partkey")
    x, y, s = k % 1000 * 16, L.div(k, 1000) * 32, k % 3 + 3
    return L.table(spark, sf_dir, "part", "p_partkey").select(k.alias("plot_id"), F.array(ring((x, y), (x + 3 * s, y), (x + 3 * s, y + s), (x + s, y + s), (x + s, y + 3 * s), (x, y + 3 * s))).alias("rings"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, rings: boxes with a hole."""
    k = F.col("s_suppkey")
    x, y, w, h = k * 37 % 1000 * 16, k % 2 * 20, k % 5 * 12 + 20, k % 3 * 9 + 13
    return L.table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("frame_id"), F.array(g.box_ring(x, y, x + w, y + h), g.box_ring(x + 4, y + 3, x + w - 7, y + h - 5)).alias("rings"))


def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each concave plot that lies in a frame and not in its hole."""
    found = _measured(P.clip_pairs(plots(spark, sf_dir), frames(spark, sf_dir), "plot_id", "frame_id", 64.0), "plot_id", "frame_id")
    return found.select("plot_id", "frame_id", "area", "corners", (F.col("polygons") - F.col("holes")).alias("balance"))


POLYGON_CLIP = f"""WITH f AS (SELECT s_suppkey AS frame_id, s_suppkey*37%1000*16 AS fx, s_suppkey%2*20 AS fy, s_suppkey%5*12+20 AS w, s_suppkey%3*9+13 AS h FROM supplier),
    p AS (SELECT p_partkey AS plot_id, p_partkey%1000*16 AS x, p_partkey//1000*32 AS y, p_partkey%3+3 AS s FROM part),
    b AS (SELECT plot_id, frame_id, x, y, s, fx, fy, w, h FROM p JOIN f ON x < fx+w AND fx < x+3*s AND y < fy+h AND fy < y+3*s),
    r AS (SELECT *, unnest(range(x, x+3*s)) AS i FROM b), c AS (SELECT *, unnest(range(y, y+3*s)) AS j FROM r),
    cells AS (SELECT {{'p': plot_id, 'f': frame_id}} AS key, i, j FROM c WHERE (i < x+s OR j < y+s) AND i >= fx AND i < fx+w AND j >= fy AND j < fy+h AND NOT (i >= fx+4 AND i < fx+w-7 AND j >= fy+3 AND j < fy+h-5)),
    {_CELLS} SELECT key.p AS plot_id, key.f AS frame_id, area, corners, balance FROM found"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parcel_id, rings: rows of ten parcels; each border between two bends by up to a unit."""
    k = F.col("p_partkey")
    x, y = k % 10 * 20, L.div(k, 10) * 50
    bend = lambda n: F.when(n % 10 == 0, 0.0).otherwise(n * 7 % 5 * 0.25)
    left, right = bend(k), bend(k + 1)
    return L.table(spark, sf_dir, "part", "p_partkey").select(k.alias("parcel_id"), F.array(ring((x, y), (x + 20, y), (x + 20 + right, y + 20), (x + 20, y + 40), (x, y + 40), (x + left, y + 20))).alias("rings"))


def polygon_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels thinned to within 0.6 units: small bends go, on both sides of a border alike."""
    return _measured(P.simplify(parcels(spark, sf_dir), "parcel_id", 0.6), "parcel_id")


POLYGON_SIMPLIFY = """WITH b AS (SELECT p_partkey AS k, CASE WHEN p_partkey%10=0 THEN 0 ELSE p_partkey*7%5*0.25 END AS l, CASE WHEN (p_partkey+1)%10=0 THEN 0 ELSE (p_partkey+1)*7%5*0.25 END AS r FROM part),
    t AS (SELECT k, CASE WHEN l>0.6 THEN l ELSE 0 END AS l, CASE WHEN r>0.6 THEN r ELSE 0 END AS r FROM b)
    SELECT k AS parcel_id, 1 AS polygons, 0 AS holes, 4 + CASE WHEN l>0 THEN 1 ELSE 0 END + CASE WHEN r>0 THEN 1 ELSE 0 END AS corners, (800 + 20*(r-l))::DOUBLE AS area FROM t"""


def frame_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roof points in each frame, outside its hole."""
    boxed = frames(spark, sf_dir).withColumns({f"f_{n}": v for n, v in g.rings_box(F.col("rings")).items()})
    box = ("f_min_x", "f_min_y", "f_max_x", "f_max_y")
    met = S.bucket_join(L.points(spark, sf_dir).where("cls = 6"), boxed, S.point_box(), box, 64.0, refine=g.in_rings(F.col("x"), F.col("y"), F.col("rings")))
    return met.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.max("z").alias("top"))


FRAME_POINTS = L.ctes("points") + """, f AS (SELECT s_suppkey AS frame_id, s_suppkey*37%1000*16 AS fx, s_suppkey%2*20 AS fy, s_suppkey%5*12+20 AS w, s_suppkey%3*9+13 AS h FROM supplier)
    SELECT frame_id, count(*) AS points, max(z) AS top FROM points JOIN f ON x >= fx AND x < fx+w AND y >= fy AND y < fy+h AND NOT (x >= fx+4 AND x < fx+w-7 AND y >= fy+3 AND y < fy+h-5) WHERE cls = 6 GROUP BY frame_id"""


def frame_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meshes within three units of a frame's rings or in what they enclose, and how near; those deep in its hole are not."""
    shapes, members = S.shapes(frames(spark, sf_dir), "frame_id", ["rings"])
    boxed = shapes.withColumns({f"f_{n}": v for n, v in g.rings_box(F.col("rings")).items()})
    d2 = g.figures_d2(F.col("rings"), F.array(g.box_ring(*[F.col(c) for c in MESH])))
    met = S.bucket_join(L.meshes(spark, sf_dir), boxed, MESH, ("f_min_x", "f_min_y", "f_max_x", "f_max_y"), 64.0, 3.0)
    near = L.spread(met, "mesh_id").select("mesh_id", "shape", F.explode(F.filter(F.array(d2), lambda v: v <= 9)).alias("d2"))
    return near.join(members, "shape").select("mesh_id", "frame_id", F.round("d2", 6).alias("d2"))


FRAME_MESHES = L.ctes("meshes") + """, f AS (SELECT s_suppkey AS frame_id, s_suppkey*37%1000*16 AS fx, s_suppkey%2*20 AS fy, s_suppkey%5*12+20 AS w, s_suppkey%3*9+13 AS h FROM supplier),
    p AS (SELECT mesh_id, frame_id, greatest(0, mx0-fx-w, fx-mx1) AS dx, greatest(0, my0-fy-h, fy-my1) AS dy, least(mx0-fx-4, fx+w-7-mx1, my0-fy-3, fy+h-5-my1) AS deep FROM meshes JOIN f ON mx0<=fx+w+3 AND fx-3<=mx1 AND my0<=fy+h+3 AND fy-3<=my1),
    d AS (SELECT mesh_id, frame_id, CASE WHEN deep > 0 THEN deep*deep ELSE dx*dx+dy*dy END AS d2 FROM p)
    SELECT mesh_id, frame_id, round(d2, 6)::DOUBLE AS d2 FROM d WHERE d2 <= 9"""


QUERIES = {
    "polygon_repair": (polygon_repair, POLYGON_REPAIR),
    "polygon_union": (polygon_union, POLYGON_UNION),
    "polygon_clip": (polygon_clip, POLYGON_CLIP),
    "polygon_simplify": (polygon_simplify, POLYGON_SIMPLIFY),
    "frame_points": (frame_points, FRAME_POINTS),
    "frame_meshes": (frame_meshes, FRAME_MESHES),
}
