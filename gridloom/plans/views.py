"""Viewports, labels, roads, trees, dates and places: rules per row, and the tiles a view asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import views as V
from ..sources import layers as L

SIDE, WIDE, HIGH = 16_000.0, 1_440.0, 960.0


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view_id, camera and scale (pixels to the metre) of some views over a square plane."""
    k = F.col("s_suppkey")
    return L.table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("view_id"), (k * 997 % 17_000 - 500).cast("double").alias("camera_x"), (k * 613 % 17_000 - 500).cast("double").alias("camera_y"), (k % 9 * 0.0123 + 0.031).alias("scale"))


_VIEW = f"""v0 AS (SELECT s_suppkey AS view_id, (s_suppkey*997%17000-500)::DOUBLE AS cx, (s_suppkey*613%17000-500)::DOUBLE AS cy, s_suppkey%9*0.0123::DOUBLE+0.031::DOUBLE AS scale FROM supplier),
    v1 AS (SELECT *, greatest(0, least(6, ceil(log2({SIDE}*scale*1.5/256))))::INT AS z, {WIDE}/scale/2 AS hw, {HIGH}/scale/2 AS hh FROM v0),
    v2 AS (SELECT *, (2**z)::BIGINT AS n, {SIDE}/(2**z)*scale AS size, CASE WHEN hw*2>={SIDE} THEN {SIDE}/2 ELSE greatest(hw, least({SIDE}-hw, cx)) END AS x, CASE WHEN hh*2>={SIDE} THEN {SIDE}/2 ELSE greatest(hh, least({SIDE}-hh, cy)) END AS y FROM v1),
    v3 AS (SELECT *, {WIDE}/2-x*scale AS px, {HIGH}/2-y*scale AS py FROM v2),
    v AS (SELECT *, greatest(0, floor(-px/size))::BIGINT AS x0, least(n, ceil(({WIDE}-px)/size))::BIGINT AS x1, greatest(0, floor(-py/size))::BIGINT AS y0, least(n, ceil(({HIGH}-py)/size))::BIGINT AS y1, ({WIDE}/2-px)/size AS mx, ({HIGH}/2-py)/size AS my FROM v3),
    a AS (SELECT *, unnest(range(x0, x1)) AS tx FROM v), t AS (SELECT *, unnest(range(y0, y1)) AS ty FROM a)"""


def viewport_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that each view shows at the level that fits the screen, nearest to its middle first."""
    return V.viewport_tiles(cameras(spark, sf_dir), SIDE, WIDE, HIGH, 1.5, 6).select("view_id", "z", "tx", "ty", "place")


VIEWPORT_TILES = f"WITH {_VIEW} SELECT view_id, z, tx, ty, row_number() OVER (PARTITION BY view_id ORDER BY pow(tx-mx,2)+pow(ty-my,2), ty, tx) AS place FROM t"


def prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of tiles around those shown that exist and are not shown, nearest first, six at most."""
    shown = V.viewport_tiles(cameras(spark, sf_dir), SIDE, WIDE, HIGH, 1.5, 6)
    there = (F.col("tx") * 7 + F.col("ty") * 3) % 5 != 0
    return V.prefetch_ring(shown, there, 6)


PREFETCH = f"""WITH {_VIEW}, r AS (SELECT view_id, any_value(z) AS z, greatest(0, min(tx)-1) AS x0, least(any_value(n)-1, max(tx)+1) AS x1, greatest(0, min(ty)-1) AS y0, least(any_value(n)-1, max(ty)+1) AS y1 FROM t GROUP BY view_id),
    b AS (SELECT *, unnest(range(x0, x1+1)) AS tx FROM r), c AS (SELECT *, unnest(range(y0, y1+1)) AS ty FROM b)
    SELECT view_id, z, tx, ty, row_number() OVER (PARTITION BY view_id ORDER BY pow(tx-(x0+x1)/2,2)+pow(ty-(y0+y1)/2,2), ty, tx) AS place FROM c ANTI JOIN t USING (view_id, tx, ty) WHERE (tx*7+ty*3)%5<>0 QUALIFY place<=6"""


def visible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least level at which each area's label shows (by its tier), and its name in title case with the suffix spelt out."""
    k = F.col("s_suppkey")
    tier, display = F.when(k % 5 != 0, k % 4), k % 6 != 0
    name = F.concat(F.lit("old "), F.element_at(F.array(F.lit("mill SQ."), F.lit("rittenhouse sq."), F.lit("north PARK")), (k % 3 + 1).cast("int")))
    level = F.when(display & tier.isNotNull(), F.when(tier == 1, 4).when(tier == 2, 5).otherwise(6))
    return L.table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", level.alias("from_level"), F.replace(F.initcap(name), F.lit(" Sq."), F.lit(" Square")).alias("name"))


VISIBLE_LABELS = """SELECT s_suppkey, CASE WHEN s_suppkey%6<>0 AND s_suppkey%5<>0 THEN CASE s_suppkey%4 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 6 END END AS from_level, ['Old Mill Square','Old Rittenhouse Square','Old North Park'][s_suppkey%3+1] AS name FROM supplier"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the three ranked classes whose class is a whole number, and the pixels that a stroke covers: each pixel takes
    the highest class whose stroke reaches its centre."""
    k = F.col("o_orderkey")
    kind = (F.floor(k / 16) % 12) * 0.5
    lines = L.table(spark, sf_dir, "orders", "o_orderkey").where("o_orderkey % 16 = 1").select(k.alias("line_id"), kind.alias("cls"), *[e.cast("double").alias(c) for c, e in (("ax", k * 31 % 4000), ("ay", k * 17 % 300), ("bx", k * 31 % 4000 + k % 23), ("by", k * 17 % 300 + k % 17))])
    ranked = lines.where((F.col("cls") == F.floor("cls")) & F.col("cls").between(1, 3))
    return V.stroke_pixels(ranked, {1: 9.3, 2: 6.1, 3: 3.7}).groupBy("px", "py").agg(F.min("cls").cast("int").alias("cls"), F.count(F.lit(1)).alias("strokes"))


ROADS = """WITH l AS (SELECT o_orderkey AS k, o_orderkey//16%12*0.5 AS cls, (o_orderkey*31%4000)::DOUBLE AS ax, (o_orderkey*17%300)::DOUBLE AS ay, (o_orderkey*31%4000+o_orderkey%23)::DOUBLE AS bx, (o_orderkey*17%300+o_orderkey%17)::DOUBLE AS "by" FROM orders WHERE o_orderkey%16=1),
    r AS (SELECT *, CASE cls::INT WHEN 1 THEN 9.3 WHEN 2 THEN 6.1 ELSE 3.7 END::DOUBLE/2 AS h FROM l WHERE cls=floor(cls) AND cls BETWEEN 1 AND 3),
    a AS (SELECT *, unnest(range(floor(least(ax,bx)-h)::BIGINT, floor(greatest(ax,bx)+h)::BIGINT+1)) AS px FROM r), b AS (SELECT *, unnest(range(floor(least(ay,"by")-h)::BIGINT, floor(greatest(ay,"by")+h)::BIGINT+1)) AS py FROM a),
    c AS (SELECT *, px+0.5::DOUBLE AS x, py+0.5::DOUBLE AS y, pow(bx-ax,2)+pow("by"-ay,2) AS len FROM b), d AS (SELECT *, CASE WHEN len=0 THEN 0 ELSE greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*("by"-ay))/len)) END AS t FROM c)
    SELECT px, py, min(cls)::INT AS cls, count(*) AS strokes FROM d WHERE pow(x-(ax+(bx-ax)*t),2)+pow(y-(ay+("by"-ay)*t),2) <= h*h GROUP BY ALL"""


def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height and crown of a tree from its trunk, within limits."""
    d = F.col("p_size") * 0.04
    return L.table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.round(F.least(F.greatest(d * 8 + 3, F.lit(3.5)), F.lit(15.0)), 6).alias("height"), F.round(F.least(F.greatest(d * 2.2 + 1, F.lit(1.2)), F.lit(5.0)), 6).alias("crown"))


TREE_SIZES = "SELECT p_partkey, round(least(greatest(p_size*0.04::DOUBLE*8+3,3.5),15),6)::DOUBLE AS height, round(least(greatest(p_size*0.04::DOUBLE*2.2+1,1.2),5),6)::DOUBLE AS crown FROM part"


def capture_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of photographs from camera tags (``2024:05:06 07:08:09``), ISO dates and RFC 3339; others are null."""
    k = F.col("event_id")
    said = F.when(k % 4 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(k % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(k % 4 == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.lit("soon"))
    events = L.table(spark, sf_dir, "events", "event_id", "ts").select("event_id", said.alias("said"))
    return events.select("event_id", V.capture_time(F.col("said")).alias("at"))


CAPTURE_DATES = """SELECT event_id, CASE event_id%4 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 1 THEN epoch(date_trunc('day', ts))::BIGINT WHEN 2 THEN epoch(date_trunc('second', ts))::BIGINT-7200 END AS at FROM events"""


def earth_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth-centred coordinates of model points given as offsets on a tangent plane."""
    k = F.col("c_custkey")
    lon, lat = g.tangent_offset(-75.16, 39.95, (k % 97 * 11).cast("double"), (k % 89 * 7).cast("double"))
    x, y, z = g.earth_centred(F.col("lon"), F.col("lat"), F.col("h"))
    placed = L.table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", lon.alias("lon"), lat.alias("lat"), (k % 50).cast("double").alias("h"))
    return placed.select("c_custkey", *[F.round(v, 3).alias(n) for n, v in (("x", x), ("y", y), ("z", z))])


EARTH_PLACES = """WITH c AS (SELECT 6378137.0::DOUBLE AS a, 1/298.257223563::DOUBLE AS f), e AS (SELECT a, f*(2-f) AS e2 FROM c), w AS (SELECT *, 1-e2*pow(sin(radians(39.95)),2) AS w FROM e),
    p AS (SELECT c_custkey, radians(-75.16+degrees((c_custkey%97*11)/(a/sqrt(w)*cos(radians(39.95))))) AS lam, radians(39.95+degrees((c_custkey%89*7)/(a*(1-e2)/(w*sqrt(w))))) AS phi, (c_custkey%50)::DOUBLE AS h, a, e2 FROM customer, w),
    n AS (SELECT *, a/sqrt(1-e2*pow(sin(phi),2)) AS n FROM p)
    SELECT c_custkey, round((n+h)*cos(phi)*cos(lam),3) AS x, round((n+h)*cos(phi)*sin(lam),3) AS y, round((n*(1-e2)+h)*sin(phi),3) AS z FROM n"""


def well_known_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints as well-known text, their identity as its digest, and the text read back to an area."""
    ring = g.box_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    said = L.spread(L.buildings(spark, sf_dir), "building_id").select("building_id", V.polygon_text(ring).alias("wkt"))
    return said.select("building_id", F.sha2("wkt", 256).alias("footprint_id"), F.round(g.ring_area(V.text_polygon(F.col("wkt"))), 3).alias("area"))


WELL_KNOWN_TEXT = L.ctes("buildings") + """, b AS (SELECT building_id, min_x::BIGINT AS x0, min_y::BIGINT AS y0, max_x::BIGINT AS x1, max_y::BIGINT AS y1 FROM buildings)
    SELECT building_id, sha256('POLYGON (('||x0||' '||y0||', '||x1||' '||y0||', '||x1||' '||y1||', '||x0||' '||y1||', '||x0||' '||y0||'))') AS footprint_id, ((x1-x0)*(y1-y0))::DOUBLE AS area FROM b"""


def angular_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample grids of some bounds in degrees: cells of a level with one more on every side, none above ten thousand."""
    k = F.col("n_nationkey")
    bounds = L.table(spark, sf_dir, "nation", "n_nationkey").select(k.alias("grid"), (-75.2 + k * 0.0031).alias("west"), (39.9 + k * 0.0017).alias("south"), (-75.2 + k * 0.0031 + 0.0011 * (k % 5 + 1)).alias("east"), (39.9 + k * 0.0017 + 0.0007 * (k % 4 + 1)).alias("north"))
    points = V.angular_grid(bounds, "grid", 18, 10_000)
    return points.groupBy("grid").agg(F.count(F.lit(1)).alias("points"), F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))


ANGULAR_GRIDS = """WITH b AS (SELECT n_nationkey AS k, -75.2::DOUBLE+n_nationkey*0.0031::DOUBLE AS w, 39.9::DOUBLE+n_nationkey*0.0017::DOUBLE AS s FROM nation), c AS (SELECT *, w+0.0011::DOUBLE*(k%5+1) AS e, s+0.0007::DOUBLE*(k%4+1) AS n, 90/pow(2,16) AS d FROM b),
    g AS (SELECT k AS grid, floor(w/d)::BIGINT-1 AS x0, floor(e/d)::BIGINT+1 AS x1, floor(s/d)::BIGINT-1 AS y0, floor(n/d)::BIGINT+1 AS y1 FROM c) SELECT grid, (x1-x0+1)*(y1-y0+1) AS points, x0, x1, y0, y1 FROM g"""


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within a corridor's width of its bent line, its ends cut flat."""
    k = F.col("c_custkey")
    points = L.table(spark, sf_dir, "customer", "c_custkey").select(k.alias("id"), (k * 37 % 2000 + 0.5).cast("double").alias("x"), (k * 53 % 300 + 0.5).cast("double").alias("y"))
    s = F.col("n_nationkey")
    x, y = (s * 71 % 1900).cast("double"), (s * 13 % 200).cast("double")
    lines = L.table(spark, sf_dir, "nation", "n_nationkey").select(s.alias("line_id"), F.array(g.point(x, y), g.point(x + 60, y + 20), g.point(x + 90, y + 80)).alias("line"), (s % 4 * 5 + 12.25).alias("width"))
    return V.corridor_members(points, lines, 128.0).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


CORRIDORS = """WITH p AS (SELECT c_custkey AS id, c_custkey*37%2000+0.5::DOUBLE AS x, c_custkey*53%300+0.5::DOUBLE AS y FROM customer), l AS (SELECT n_nationkey AS k, (n_nationkey*71%1900)::DOUBLE AS lx, (n_nationkey*13%200)::DOUBLE AS ly, n_nationkey%4*5+12.25::DOUBLE AS w FROM nation),
    q AS (SELECT k, id, x-lx AS x, y-ly AS y, w FROM p JOIN l ON x BETWEEN lx-w AND lx+90+w AND y BETWEEN ly-w AND ly+80+w),
    s AS (SELECT *, (x*60+y*20)/4000 AS t1, abs(x*20-y*60)/sqrt(4000) AS d1, ((x-60)*30+(y-20)*60)/4500 AS t2, abs((x-60)*60-(y-20)*30)/sqrt(4500) AS d2 FROM q)
    SELECT k AS line_id, count(*) AS n, min(id) AS first FROM s WHERE (t1 BETWEEN 0 AND 1 AND d1<=w) OR (t2 BETWEEN 0 AND 1 AND d2<=w) OR pow(x-60,2)+pow(y-20,2)<=w*w GROUP BY k"""


def water_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each tile that a binary mask selects, mixed with the water's tone, and whether their number is the manifest's."""
    k = F.col("o_orderkey")
    pixels = L.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((k % 31).alias("tile"), (F.col("o_custkey") % 256).cast("int").alias("red"), (k * 7 % 10 < 4).alias("selected"), (k % 29).alias("band"))
    manifest = pixels.groupBy("tile").agg((F.count_if("selected") + F.when(F.col("tile") == 5, 1).otherwise(0)).alias("said"))
    return V.graded_water(pixels, manifest)


WATER_GRADING = """WITH p AS (SELECT o_orderkey%31 AS tile, o_custkey%256 AS red, o_orderkey*7%10<4 AS s, o_orderkey%29 AS band FROM orders), g AS (SELECT *, least(255, round(red*0.44::DOUBLE+42*0.56::DOUBLE))::INT AS b FROM p),
    h AS (SELECT tile, s, CASE WHEN NOT s THEN red WHEN band<1.4 THEN round(b*0.84::DOUBLE+126*0.16::DOUBLE)::INT WHEN band>=14.5 AND band<15.3 THEN round(b*0.88::DOUBLE+27*0.12::DOUBLE)::INT ELSE b END AS r FROM g)
    SELECT tile, count(*) FILTER (s) AS selected, sum(r)::BIGINT AS red, tile<>5 AS agrees FROM h GROUP BY tile"""


def cast_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each building's shadow on the ground: its ring moved by its height along the light, the box of both, and the area that
    its edges sweep."""
    ring = g.box_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return V.shadows(L.buildings(spark, sf_dir).select("building_id", "height", ring.alias("ring")), 0.75, -0.5).select("building_id", F.round("swept", 6).alias("swept"), F.col("box.min_x").alias("x0"), F.col("box.min_y").alias("y0"), F.col("box.max_x").alias("x1"), F.col("box.max_y").alias("y1"))


CAST_SHADOWS = L.ctes("buildings") + """ SELECT building_id, round(height*((max_x-min_x)*0.5+(max_y-min_y)*0.75), 6)::DOUBLE AS swept, min_x AS x0, min_y-height*0.5::DOUBLE AS y0, max_x+height*0.75::DOUBLE AS x1, max_y AS y1 FROM buildings"""


def shoreline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone of each point: open water inside a ring, shoreline within 4.5 of one where a probe nearby finds the mask's water."""
    from .city import zones

    k = F.col("c_custkey")
    points = L.table(spark, sf_dir, "customer", "c_custkey").select(k.alias("id"), (k * 37 % 16_000 + 0.25).cast("double").alias("x"), (k * 53 % 160 - 20 + 0.25).cast("double").alias("y"))
    return V.water_tones(points, zones(spark, sf_dir), 4.5, lambda x, y: (F.floor(x / 3) + F.floor(y / 3)) % 7 == 0)


SHORELINE = L.ctes("zones") + """, p AS (SELECT c_custkey AS id, c_custkey*37%16000+0.25::DOUBLE AS x, c_custkey*53%160-20+0.25::DOUBLE AS y FROM customer),
    m AS (SELECT id, abs(x-cx) AS px, abs(y-cy) AS py, rx, ry FROM p JOIN zones ON abs(x-cx)<=rx+4.5 AND abs(y-cy)<=ry+4.5), t AS (SELECT *, greatest(0, least(1, ((px-rx)*-rx+py*ry)/(rx*rx+ry*ry))) AS t FROM m),
    d AS (SELECT id, bool_or(px/rx+py/ry<1) AS inside, min(pow(px-(rx-rx*t),2)+pow(py-ry*t,2)) AS d2 FROM t GROUP BY id),
    n AS (SELECT id, bool_or((floor((x+dx)/3)+floor((y+dy)/3))::BIGINT%7=0) AS near FROM p, (VALUES (0,0),(4.5,0),(-4.5,0),(0,4.5),(0,-4.5)) o(dx,dy) GROUP BY id)
    SELECT id, CASE WHEN inside THEN 'open' ELSE 'shoreline' END AS tone FROM d JOIN n USING (id) WHERE inside OR (near AND d2<=20.25)"""


def box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints written with a covering box and read back for a window: only row groups that may meet it are read."""
    ring = g.box_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    path = V.write_with_boxes(L.buildings(spark, sf_dir).select("building_id", ring.alias("ring")), "ring")
    return V.read_window(spark, path, 3_000.0, 0.0, 4_500.0, 40.0).select("building_id", F.round(g.ring_area(F.col("ring")), 3).alias("area"))


BOX_SCAN = L.ctes("buildings") + " SELECT building_id, (max_x-min_x)*(max_y-min_y) AS area FROM buildings WHERE min_x<=4500 AND max_x>=3000 AND min_y<=40 AND max_y>=0"

QUERIES = {
    "viewport_tiles": (viewport_tiles, VIEWPORT_TILES),
    "prefetch": (prefetch, PREFETCH),
    "visible_labels": (visible_labels, VISIBLE_LABELS),
    "roads": (roads, ROADS),
    "tree_sizes": (tree_sizes, TREE_SIZES),
    "capture_dates": (capture_dates, CAPTURE_DATES),
    "earth_places": (earth_places, EARTH_PLACES),
    "well_known_text": (well_known_text, WELL_KNOWN_TEXT),
    "angular_grids": (angular_grids, ANGULAR_GRIDS),
    "corridors": (corridors, CORRIDORS),
    "water_grading": (water_grading, WATER_GRADING),
    "cast_shadows": (cast_shadows, CAST_SHADOWS),
    "shoreline": (shoreline, SHORELINE),
    "box_scan": (box_scan, BOX_SCAN),
}
