"""Canopy on a screen, turned cameras and the tiles they need, walls with normals and materials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import context as X
from ..operators import surfaces as U
from ..sources import layers as L
from .city import _KINDS

_N, _E = 0.9907696, 0.13555646


def canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, band of canopy cells of 3 metres."""
    k = F.col("l_orderkey")
    cells = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select((k * 7 % 40).alias("row"), (k * 13 % 600).alias("col"), ((k + F.col("l_linenumber")) % 4).alias("band"))
    return cells.groupBy("row", "col").agg(F.max("band").cast("int").alias("band"))


def canopy_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of some screen positions in four views, the canopy cell that shows there."""
    k = F.col("o_orderkey")
    view = F.element_at(F.array(*[F.lit(v) for v in g.VIEWS]), (k % 4 + 1).cast("int"))
    sx, sy = g.isometric(view, k * 29 % 1800 + 0.37, k * 31 % 120 + 0.61, k % 9 + 0.13)
    pixels = L.table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", view.alias("view"), sx.alias("sx"), sy.alias("sy"))
    found = U.canopy_surface(pixels, canopy(spark, sf_dir), 3.0, ["o_orderkey"])
    return found.select("o_orderkey", "band", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("depth", 6).alias("depth"))


# every view's east and north are combinations of the grid's; screen x is their sum, screen y half their difference
CANOPY_SURFACE = f"""WITH c AS (SELECT l_orderkey*7%40 AS r, l_orderkey*13%600 AS q, max((l_orderkey+l_linenumber)%4) AS band FROM lineitem GROUP BY ALL),
    v(i, ee, en, ne, nn) AS (VALUES (0,1,0,0,1),(1,0,1,-1,0),(2,-1,0,0,-1),(3,0,-1,1,0)),
    p AS (SELECT o_orderkey AS k, o_orderkey%4 AS i, o_orderkey*29%1800+0.37::DOUBLE AS x, o_orderkey*31%120+0.61::DOUBLE AS y, o_orderkey%9+0.13::DOUBLE AS h FROM orders),
    g AS (SELECT p.*, v.*, x*{_N}::DOUBLE-y*{_E}::DOUBLE AS ge, x*{_E}::DOUBLE+y*{_N}::DOUBLE AS gn FROM p JOIN v USING (i)),
    s AS (SELECT k, i, ee, en, ne, nn, (ee+ne)*ge+(en+nn)*gn AS sx, ((ee-ne)*ge+(en-nn)*gn)/2-h AS sy FROM g),
    b AS (SELECT *, 1+2.25::DOUBLE*b AS height, sx/2+(sy+1+2.25::DOUBLE*b) AS e, sx/2-(sy+1+2.25::DOUBLE*b) AS n FROM s, range(4) t(b)),
    t AS (SELECT *, ee*e+ne*n AS te, en*e+nn*n AS tn FROM b), w AS (SELECT *, te*{_N}::DOUBLE+tn*{_E}::DOUBLE AS x, tn*{_N}::DOUBLE-te*{_E}::DOUBLE AS y FROM t),
    z AS (SELECT k, w.b AS band, x, y, ((ee-ne)*(x*{_N}::DOUBLE-y*{_E}::DOUBLE)+(en-nn)*(x*{_E}::DOUBLE+y*{_N}::DOUBLE))/2+height AS depth FROM w JOIN c ON r=floor(y/3) AND q=floor(x/3) AND c.band=w.b),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY depth DESC, band DESC) AS place FROM z)
    SELECT k AS o_orderkey, band::INT AS band, round(x,6) AS x, round(y,6) AS y, round(depth,6) AS depth FROM o WHERE place=1"""

CAMERAS = (g.Camera(0.0), g.Camera(33.0, 1.25, 0.8, 1.5), g.Camera(-118.5, 0.5, 2.0, 0.75))


def turned_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in three turned and scaled cameras, and the ground they show when lifted to no height."""
    k = F.col("c_custkey")
    placed = L.table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", (k * 37 % 5000 - 900.5).alias("x"), (k * 91 % 3000 - 700.25).alias("y"), (k % 60).cast("double").alias("h"))
    out = None
    for n, camera in enumerate(CAMERAS):
        sx, sy = camera.project(F.col("x"), F.col("y"), F.col("h"))
        gx, gy = camera.ground(*camera.project(F.col("x"), F.col("y"), F.lit(0.0)))
        one = placed.select("c_custkey", F.lit(n).alias("camera"), *[F.round(v, 5).alias(c) for c, v in (("sx", sx), ("sy", sy), ("gx", gx), ("gy", gy))])
        out = one if out is None else out.unionByName(one)
    return out


_CAMERAS = "c(camera, a, xs, gs, hs) AS (VALUES (0,0.0::DOUBLE,1.0::DOUBLE,1.0::DOUBLE,1.0::DOUBLE),(1,33.0,1.25,0.8,1.5),(2,-118.5,0.5,2.0,0.75))"
TURNED_PLACES = f"""WITH {_CAMERAS}, p AS (SELECT c_custkey, c_custkey*37%5000-900.5::DOUBLE AS x, c_custkey*91%3000-700.25::DOUBLE AS y, (c_custkey%60)::DOUBLE AS h FROM customer),
    t AS (SELECT *, x*{_N}::DOUBLE-y*{_E}::DOUBLE AS be, x*{_E}::DOUBLE+y*{_N}::DOUBLE AS bn, cos(radians(a)) AS co, sin(radians(a)) AS si FROM p, c), u AS (SELECT *, be*co+bn*si AS e, bn*co-be*si AS n FROM t)
    SELECT c_custkey, camera, round(xs*(e+n),5) AS sx, round(gs*(e-n)/2-hs*h,5) AS sy, x AS gx, y AS gy FROM u"""


def turned_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a screen grid that each zone's box meets once turned, for three cameras; borders count."""
    k = F.col("s_suppkey")
    boxes = L.table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("area_id"), *[e.cast("double").alias(c) for c, e in (("x0", k * 37 % 800), ("y0", k * 53 % 600), ("x1", k * 37 % 800 + k % 7 * 20 + 15), ("y1", k * 53 % 600 + k % 5 * 30 + 10))])
    out = None
    for n, camera in enumerate(CAMERAS):
        corners = F.array(*[g.point(*camera.project(F.col(x), F.col(y), F.lit(0.0))) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
        one = U.figure_cover(boxes, ["area_id"], corners, -2000.0, -2000.0, 62.5, 64).withColumn("camera", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("area_id", "camera").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.col("tx") * 64 + F.col("ty")).alias("sum"))


# a tile and a figure meet if one has a corner of the other, or two of their borders cross
TURNED_COVER = f"""WITH {_CAMERAS}, b AS (SELECT s_suppkey AS area_id, (s_suppkey*37%800)::DOUBLE AS x0, (s_suppkey*53%600)::DOUBLE AS y0, (s_suppkey*37%800+s_suppkey%7*20+15)::DOUBLE AS x1, (s_suppkey*53%600+s_suppkey%5*30+10)::DOUBLE AS y1 FROM supplier),
    q AS (SELECT area_id, camera, k, CASE WHEN k IN (0,3) THEN x0 ELSE x1 END AS x, CASE WHEN k IN (0,1) THEN y0 ELSE y1 END AS y, a, xs, gs FROM b, c, range(4) t(k)),
    r AS (SELECT *, x*{_N}::DOUBLE-y*{_E}::DOUBLE AS be, x*{_E}::DOUBLE+y*{_N}::DOUBLE AS bn, cos(radians(a)) AS co, sin(radians(a)) AS si FROM q),
    s AS (SELECT area_id, camera, k, xs*((be*co+bn*si)+(bn*co-be*si)) AS x, gs*((be*co+bn*si)-(bn*co-be*si))/2 AS y FROM r),
    e AS (SELECT a.area_id, a.camera, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM s a JOIN s b ON a.area_id=b.area_id AND a.camera=b.camera AND b.k=(a.k+1)%4),
    m AS (SELECT area_id, camera, floor((min(x)+2000)/62.5)::BIGINT-1 AS i0, floor((max(x)+2000)/62.5)::BIGINT+1 AS i1, floor((min(y)+2000)/62.5)::BIGINT-1 AS j0, floor((max(y)+2000)/62.5)::BIGINT+1 AS j1 FROM s GROUP BY ALL),
    n AS (SELECT area_id, camera, unnest(range(i0, i1+1)) AS i, j0, j1 FROM m), t AS (SELECT area_id, camera, i, unnest(range(j0, j1+1)) AS j FROM n),
    w AS (SELECT *, i*62.5::DOUBLE-2000 AS l, j*62.5::DOUBLE-2000 AS u FROM t WHERE i BETWEEN 0 AND 63 AND j BETWEEN 0 AND 63),
    -- a border of the figure, cut to the tile by its four sides, is left with something
    h AS (SELECT w.area_id, w.camera, i, j, CASE WHEN bx=ax THEN CASE WHEN ax BETWEEN l AND l+62.5 THEN 0 ELSE 2 END ELSE least((l-ax)/(bx-ax), (l+62.5-ax)/(bx-ax)) END AS tx0, CASE WHEN bx=ax THEN CASE WHEN ax BETWEEN l AND l+62.5 THEN 1 ELSE -1 END ELSE greatest((l-ax)/(bx-ax), (l+62.5-ax)/(bx-ax)) END AS tx1,
        CASE WHEN "by"=ay THEN CASE WHEN ay BETWEEN u AND u+62.5 THEN 0 ELSE 2 END ELSE least((u-ay)/("by"-ay), (u+62.5-ay)/("by"-ay)) END AS ty0, CASE WHEN "by"=ay THEN CASE WHEN ay BETWEEN u AND u+62.5 THEN 1 ELSE -1 END ELSE greatest((u-ay)/("by"-ay), (u+62.5-ay)/("by"-ay)) END AS ty1,
        (bx-ax)*(u-ay)-("by"-ay)*(l-ax) AS side FROM w JOIN e USING (area_id, camera)),
    f AS (SELECT area_id, camera, i, j, bool_or(greatest(tx0, ty0, 0) <= least(tx1, ty1, 1)) AS cut, (bool_and(side >= 0) OR bool_and(side <= 0)) AS inside FROM h GROUP BY ALL)
    SELECT area_id, camera, count(*) AS tiles, sum(i*64+j)::BIGINT AS sum FROM f WHERE cut OR inside GROUP BY ALL"""


def wall_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outward normals of the lots' walls, and which walls stand free."""
    lots = L.spread(L.lots(spark, sf_dir), "lot_id").select("lot_id", g.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"))
    return U.walls(lots, "lot_id", 64.0).select("lot_id", "edge", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"), "free")


WALL_NORMALS = L.ctes("lots") + """, n(edge, nx, ny) AS (VALUES (0,0,-1),(1,1,0),(2,0,1),(3,-1,0)),
    p AS (SELECT lot_id, edge, nx, ny, CASE nx WHEN 0 THEN x0+wide/2 WHEN 1 THEN x0+wide+0.05 ELSE x0-0.05 END AS px, CASE ny WHEN 0 THEN y0+deep/2 WHEN 1 THEN y0+deep+0.05 ELSE y0-0.05 END AS py FROM lots, n)
    SELECT p.lot_id, edge, nx::DOUBLE AS nx, ny::DOUBLE AS ny, NOT EXISTS (SELECT 1 FROM lots o WHERE o.lot_id<>p.lot_id AND px>=o.x0 AND px<o.x0+o.wide AND py>=o.y0 AND py<o.y0+o.deep) AS free FROM p"""


def wall_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lot's wall colour from its kind and the seeds of its run, its place and its block."""
    lots = L.lots(spark, sf_dir).select("lot_id", "height", "x0", "y0", "x1", "y1", g.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"))
    known = X.contexts(lots, "lot_id", 64.0).select("lot_id", "kind", "seed")
    x, y, k = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("lot_id")
    kind = F.when(F.col("kind").isin("rowhouse", "twin"), "rowhouse").when(F.col("kind") == "warehouse", "industrial").when(F.col("height") >= 18, "mid_rise").otherwise("low_rise")
    facade = ((k * 31 % 256).cast("int"), (k * 57 % 256).cast("int"), (k * 91 % 256).cast("int"))
    colour = U.wall_material(facade, x, y, U.place_seed(x, y), F.col("seed"), kind)
    return lots.join(known, "lot_id").select("lot_id", F.col("seed"), *[v.alias(c) for c, v in zip(("red", "green", "blue"), colour)])


def _mixed(numbers: str, start: int) -> str:
    """A list of numbers without sign mixed into a seed, as SQL; 64-bit products are taken modulo 2**64."""
    m = "18446744073709551616::UHUGEINT"
    x = f"xor(s, (v + {X.GOLDEN}::UHUGEINT) % {m})"
    x = f"list_transform([{x}], lambda q: xor(q, q // 1073741824::UHUGEINT) * {X.MIX_1}::UHUGEINT % {m})[1]"
    x = f"list_transform([{x}], lambda r: xor(r, r // 134217728::UHUGEINT))[1]"
    x = f"list_transform([{x}], lambda t: xor(t * {X.MIX_2}::UHUGEINT % {m}, t // 2147483648::UHUGEINT))[1]"
    return f"list_reduce(list_prepend({start}::UHUGEINT, {numbers}), lambda s, v: {x})"


def _rgb(table: tuple) -> str:
    return "[" + ",".join("[" + ",".join(map(str, row)) + "]" for row in table) + "]"


WALL_MATERIALS = _KINDS + f""",
    own AS (SELECT lots.*, kind, component, size, {_mixed("[round((x0+wide/2)*4)::UHUGEINT, round((y0+deep/2)*4)::UHUGEINT, (wide*deep*4)::UHUGEINT, (height*4)::UHUGEINT]", X.SEED_BUILDING)} AS own FROM lots JOIN kinds USING (lot_id)),
    runs2 AS (SELECT component, {_mixed("list(own ORDER BY own)", X.SEED_GROUP)} AS run FROM own GROUP BY component),
    p AS (SELECT *, CASE WHEN size>=2 THEN run ELSE own END AS seed, round(x0+wide/2)::BIGINT AS px, round(y0+deep/2)::BIGINT AS py FROM own JOIN runs2 USING (component)),
    q AS (SELECT *, xor(px*2654435769, py*8388608) AS place, xor(floor((x0+wide/2)/400)::BIGINT*2654435769, floor((y0+deep/2)/400)::BIGINT*8388608)%4 AS block,
        CASE WHEN kind IN ('rowhouse','twin') THEN 'row' WHEN kind='warehouse' THEN 'hall' WHEN height>=18 THEN 'high' ELSE 'low' END AS tint FROM p),
    c AS (SELECT *, CASE tint WHEN 'row' THEN {_rgb(tuple(c for f in U.ROWHOUSE_FAMILIES for c in f))}[((seed%4)*4+place%4+1)::BIGINT] WHEN 'hall' THEN {_rgb(U.INDUSTRIAL)}[block+1] WHEN 'high' THEN {_rgb(U.HIGH_RISE)}[block+1] ELSE {_rgb(U.LOW_RISE)}[block+1] END AS other,
        CASE tint WHEN 'row' THEN 0.42::DOUBLE WHEN 'hall' THEN 0.3 WHEN 'high' THEN 0.18 ELSE 0.24 END AS part, 0.94::DOUBLE+(place&7)*0.014::DOUBLE AS tone, [lot_id*31%256, lot_id*57%256, lot_id*91%256] AS own_rgb FROM q)
    SELECT lot_id, CASE WHEN seed >= 9223372036854775808::UHUGEINT THEN (seed::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE seed::BIGINT END AS seed,
        {", ".join(f"least(255, round(round(own_rgb[{k}]*(1-part)+other[{k}]*part)*tone))::INT AS {n}" for k, n in ((1, "red"), (2, "green"), (3, "blue")))} FROM c"""


QUERIES = {
    "canopy_surface": (canopy_surface, CANOPY_SURFACE),
    "turned_places": (turned_places, TURNED_PLACES),
    "turned_cover": (turned_cover, TURNED_COVER),
    "wall_normals": (wall_normals, WALL_NORMALS),
    "wall_materials": (wall_materials, WALL_MATERIALS),
}
