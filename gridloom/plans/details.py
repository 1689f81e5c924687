"""Rules in full: streets near a house, inferred roofs, shadows as polygons, covered bilinear samples, neighbourhood modes, wall tones,
picture audits, pixel pyramids, labels in two passes, scene manifests, ground tones, and contracts that must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color as C
from ..functions import geometry as g
from ..functions import text
from ..operators import contracts as K
from ..operators import grid as G
from ..operators import pyramid as P
from ..operators import raster as R
from ..operators import spatial as S
from ..operators import surfaces as U
from ..operators import windows as O
from ..sources import layers as L
from .frontage import _LABELS
from .raster import _FRAGMENTS, fragments


#: House numbers to a block.
NUMBERS = 20


def nearby_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each house, the segments of its street within 30 metres of its box whose range holds its number on its side."""
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    label = lambda v: F.element_at(F.array(*map(F.lit, _LABELS)), (v % 4 + 1).cast("int"))
    x, y = k * 29 % 4000, k * 13 % 97
    house = L.table(spark, sf_dir, "customer", "c_custkey").select(k.alias("house_id"), label(k).alias("label"), (k % 60 * 2 + k % 2).alias("number"), *[v.cast("double").alias(c) for c, v in (("x0", x), ("y0", y), ("x1", x + 9), ("y1", y + 14))])
    sx, sy = j * 61 % 4000, j * 31 % 97
    street = L.table(spark, sf_dir, "supplier", "s_suppkey").select(j.alias("segment_id"), label(j).alias("street"), (j % 3 * 40 + j % 2).alias("first"), (j % 3 * 40 + j % 2 + 60).alias("last"), *[v.cast("double").alias(c) for c, v in (("u0", sx), ("v0", sy), ("u1", sx + 120), ("v1", sy + j % 5))])
    # the join's key has the street and a block of numbers beside the cell, so that a dense cell is many keys
    house = house.withColumn("block", F.floor(F.col("number") / NUMBERS))
    street = street.withColumn("numbers", F.explode(F.sequence(F.floor(F.col("first") / NUMBERS), F.floor(F.col("last") / NUMBERS)))).hint("merge")
    fits = (F.col("label") == F.col("street")) & (F.col("block") == F.col("numbers")) & text.range_fits(F.col("first"), F.col("last"), F.col("number"), F.col("number"))
    return S.bucket_join(house, street, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), 64.0, 30.0, fits).select("house_id", "segment_id")


NEARBY_STREETS = """WITH h AS (SELECT c_custkey AS house_id, c_custkey%4 AS l, c_custkey%60*2+c_custkey%2 AS n, c_custkey*29%4000 AS x, c_custkey*13%97 AS y FROM customer),
    s AS (SELECT s_suppkey AS segment_id, s_suppkey%4 AS m, s_suppkey%3*40+s_suppkey%2 AS a, s_suppkey%3*40+s_suppkey%2+60 AS b, s_suppkey*61%4000 AS u, s_suppkey*31%97 AS v, s_suppkey%5 AS d FROM supplier)
    SELECT house_id, segment_id FROM h JOIN s ON l=m AND n BETWEEN a AND b AND n%2=a%2 WHERE x<=u+150 AND u-30<=x+9 AND y<=v+d+30 AND v-30<=y+14"""


def inferred_roofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roof inferred for detached buildings whose ring is nearly a rectangle: gabled with its ridge's ends, or hipped; and
    whether a detached house's front is put on its street edge."""
    k = F.col("p_partkey")
    w, d, lean, short = k % 13 + 4, k % 9 + 5, (k * 7 % 11) * 0.31, (k * 3 % 5) * 0.41
    ring = F.array(g.point(F.lit(0), F.lit(0)), g.point(w, F.lit(0)), g.point(w + lean, d - short), g.point(lean, d))
    rows = L.spread(L.table(spark, sf_dir, "part", "p_partkey"), "p_partkey").select(k.alias("building_id"), ring.alias("ring"), (k % 29 * 0.75 + 2).alias("h"), (k % 3 != 0).alias("detached"), (k % 5).alias("edge"))
    sides, area = g.rectangle_sides(F.col("ring")), g.ring_area(F.col("ring"))
    sized = rows.withColumns({"s": sides, "area": area})
    low, high, h = F.array_min("s"), F.array_max("s"), F.col("h")
    rise = F.least(F.greatest(F.lit(1.0), F.least(F.lit(2.8), low * 0.28)), h * 0.25, h - 3)
    a, b = (F.col("s")[0] + F.col("s")[2]) / 2, (F.col("s")[1] + F.col("s")[3]) / 2
    ratio = F.greatest(a, b) / F.least(a, b)
    fits = F.col("detached") & F.col("s").isNotNull() & (h >= 5) & (h < 18) & F.col("area").between(36, 300) & low.between(4.8, 15) & high.between(4.8, 25) & (rise >= 1)
    form = F.when(fits & (ratio >= 1.4), "gabled").when(fits & (ratio <= 1.3), "hipped")
    middle = lambda k, c: (F.col("ring")[k][c] + F.col("ring")[(k + 1) % 4][c]) / 2
    end = lambda one, two, c: F.round(F.when(form == "gabled", F.when(b > a, middle(one, c)).otherwise(middle(two, c))), 6)
    edge = F.try_element_at(F.transform(g.ring_edges(F.col("ring")), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])), (F.col("edge") + 1).cast("int"))
    front = F.coalesce(F.col("detached") & h.between(5, 18) & F.col("area").between(36, 300) & text.let(edge, lambda v: v.between(4.8, 15)), F.lit(False))
    return sized.select("building_id", form.alias("form"), F.round(F.when(form.isNotNull(), h - rise), 6).alias("wall_top"), end(0, 1, "x").alias("ridge_x"), end(0, 1, "y").alias("ridge_y"), front.alias("front"))


INFERRED_ROOFS = """WITH p AS (SELECT p_partkey AS k, (p_partkey%13+4)::DOUBLE AS w, (p_partkey%9+5)::DOUBLE AS d, (p_partkey*7%11)*0.31::DOUBLE AS l, (p_partkey*3%5)*0.41::DOUBLE AS s, (p_partkey%29*0.75+2)::DOUBLE AS h, p_partkey%3<>0 AS det, p_partkey%5 AS e FROM part),
    q AS (SELECT *, w AS n0, sqrt(l*l+(d-s)*(d-s)) AS n1, sqrt(w*w+s*s) AS n2, sqrt(l*l+d*d) AS n3, (w*(d-s)+(w+l)*d-l*(d-s))/2 AS area FROM p),
    r AS (SELECT *, abs(w*l)/(n0*n1)<=0.16 AND abs(-l*w+(d-s)*s)/(n1*n2)<=0.16 AND abs(w*l-s*d)/(n2*n3)<=0.16 AND abs(-l*w)/(n3*n0)<=0.16 AND abs(-w*w)/(n0*n2)>=0.985 AND abs(-l*l-(d-s)*d)/(n1*n3)>=0.985
        AND abs(n0-n2)<=0.12*greatest(n0,n2) AND abs(n1-n3)<=0.12*greatest(n1,n3) AS rect, least(n0,n1,n2,n3) AS sh, greatest(n0,n1,n2,n3) AS lo, (n0+n2)/2 AS a, (n1+n3)/2 AS b, [n0,n1,n2,n3][e+1] AS side FROM q),
    t AS (SELECT *, least(greatest(1.0, least(2.8, sh*0.28)), h*0.25, h-3) AS rise, greatest(a,b)/least(a,b) AS ratio FROM r),
    u AS (SELECT *, det AND rect AND h>=5 AND h<18 AND area BETWEEN 36 AND 300 AND sh BETWEEN 4.8 AND 15 AND lo BETWEEN 4.8 AND 25 AND rise>=1 AS fits FROM t),
    f AS (SELECT *, CASE WHEN fits AND ratio>=1.4 THEN 'gabled' WHEN fits AND ratio<=1.3 THEN 'hipped' END AS form FROM u)
    SELECT k AS building_id, form, CASE WHEN form IS NOT NULL THEN round(h-rise,6) END AS wall_top, CASE WHEN form='gabled' THEN round(CASE WHEN b>a THEN w/2 ELSE w+l/2 END,6) END AS ridge_x, CASE WHEN form='gabled' THEN round(CASE WHEN b>a THEN 0 ELSE (d-s)/2 END,6) END AS ridge_y,
        coalesce(det AND h BETWEEN 5 AND 18 AND area BETWEEN 36 AND 300 AND side BETWEEN 4.8 AND 15, false) AS front FROM f"""


def shadow_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and corners of the ground that each building's shadow covers."""
    ring = g.box_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    prisms = L.buildings(spark, sf_dir).select("building_id", ring.alias("ring"), F.lit(0.0).alias("bottom"), F.col("height").alias("top"))
    found = U.shadow_polygons(prisms, ["building_id"], 0.4, 0.2)
    return found.groupBy("building_id").agg(F.round(F.sum("area"), 4).alias("area"), F.sum(F.size(F.col("rings")[0])).alias("corners"))


SHADOW_AREAS = L.ctes("buildings") + """ SELECT building_id, round((max_x-min_x)*(max_y-min_y) + 0.4*height*(max_y-min_y) + 0.2*height*(max_x-min_x), 4) AS area, 6::BIGINT AS corners FROM buildings"""


def covered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear heights at places, null unless all four cells around are measured (1) or filled in between (2)."""
    cells = L.cells(spark, sf_dir).groupBy("row", "col").agg(F.max("value").alias("value")).withColumn("coverage", (F.col("row") * 5 + F.col("col") * 3) % 17 % 4)
    k = F.col("c_custkey")
    places = L.table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", (k * 7 % 50 * 0.3 + 0.125).alias("sr"), (k * 11 % 200 * 0.3 + 0.25).alias("sc"))
    found = G.bilinear(places, cells.where(F.col("coverage").isin(1, 2)), "value", ["c_custkey"])
    return found.select("c_custkey", F.round("value", 6).alias("value"))


COVERED_SAMPLES = L.ctes("cells") + """, c AS (SELECT "row" AS r, col AS q, max(value) AS v FROM cells GROUP BY ALL), m AS (SELECT * FROM c WHERE (r*5+q*3)%17%4 IN (1, 2)),
    p AS (SELECT c_custkey, c_custkey*7%50*0.3::DOUBLE+0.125 AS sr, c_custkey*11%200*0.3::DOUBLE+0.25 AS sc FROM customer), f AS (SELECT *, floor(sr) AS r, floor(sc) AS q FROM p)
    SELECT c_custkey, round((a.v*(1-sc+f.q)+b.v*(sc-f.q))*(1-sr+f.r) + (c.v*(1-sc+f.q)+d.v*(sc-f.q))*(sr-f.r), 6) AS value FROM f LEFT JOIN m a ON a.r=f.r AND a.q=f.q LEFT JOIN m b ON b.r=f.r AND b.q=f.q+1 LEFT JOIN m c ON c.r=f.r+1 AND c.q=f.q LEFT JOIN m d ON d.r=f.r+1 AND d.q=f.q+1"""


def water_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The water level that most samples within three cells of each cell agree on."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bins = L.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").where("o_orderkey % 5 = 0").select(F.floor(k / 512).alias("row"), (c * 7 % 40).alias("col"), F.when(c % 3 == 0, k % 23).otherwise(L.div(k, 4096) % 7 + k % 3).alias("bin"))
    counts = bins.groupBy("row", "col", "bin").agg(F.count(F.lit(1)).alias("n"))
    return R.neighbourhood_mode(counts).select("row", "col", "mode", "within", "total", F.round("level", 6).alias("level"))


WATER_LEVELS = """WITH b AS (SELECT o_orderkey//512 AS r, o_custkey*7%40 AS q, CASE WHEN o_custkey%3=0 THEN o_orderkey%23 ELSE o_orderkey//4096%7+o_orderkey%3 END AS bin FROM orders WHERE o_orderkey%5=0),
    s AS (SELECT r+i AS r, q+j AS q, bin, count(*) AS n FROM b, range(-3, 4) a(i), range(-3, 4) c(j) GROUP BY ALL),
    w AS (SELECT m.r, m.q, m.bin, sum(o.n)::BIGINT AS within, sum(o.n*o.bin) AS weight FROM s m JOIN s o ON o.r=m.r AND o.q=m.q AND o.bin BETWEEN m.bin-2 AND m.bin+2 GROUP BY ALL),
    t AS (SELECT r, q, sum(n)::BIGINT AS total FROM s GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY r, q ORDER BY within DESC, bin) AS i FROM w)
    SELECT x.r AS "row", x.q AS col, bin AS mode, within, total, CASE WHEN within>=0.6*total THEN round((weight/within)::DOUBLE, 6) END AS level FROM x JOIN t ON t.r=x.r AND t.q=x.q WHERE i=1"""


def wall_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's tone from samples, channel by channel."""
    k = F.col("l_orderkey")
    s = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").select("l_suppkey", *[(k * m % 256).cast("int").alias(c) for c, m in (("red", 7), ("green", 11), ("blue", 13))])
    return R.wall_tone(s.where("l_suppkey % 9 <> 0 or red < 20"), ["l_suppkey"], ("red", "green", "blue"))


WALL_TONES = """WITH s AS (SELECT l_suppkey AS k, l_orderkey*7%256 AS r, l_orderkey*11%256 AS g, l_orderkey*13%256 AS b FROM lineitem), a AS (SELECT * FROM s WHERE k%9<>0 OR r<20),
    f AS (SELECT * FROM a WHERE r*3+g*6+b BETWEEN 400 AND 2200), m AS (SELECT k, list_sort(list(r))[count(*)//2+1] AS r, list_sort(list(g))[count(*)//2+1] AS g, list_sort(list(b))[count(*)//2+1] AS b FROM f GROUP BY k),
    l AS (SELECT *, (r*3+g*6+b)//10 AS y FROM m), d AS (SELECT DISTINCT k FROM a)
    SELECT d.k AS l_suppkey, coalesce(greatest(56, least(208, (r*3+y*2)//5)), 128)::INT AS red, coalesce(greatest(56, least(208, (g*3+y*2)//5)), 128)::INT AS green, coalesce(greatest(56, least(208, (b*3+y*2)//5)), 128)::INT AS blue FROM d LEFT JOIN l USING (k)"""


def picture_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of equal neighbours and of squares of one tone in each tile."""
    f = fragments(spark, sf_dir).groupBy("tile", F.col("py").alias("row"), F.col("px").alias("col")).agg((F.max("color") % 3).alias("tone"))
    return R.picture_audit(f, ["tile"], "tone")


PICTURE_AUDIT = _FRAGMENTS + """, p AS (SELECT tile, py AS r, px AS c, max(color)%3 AS t FROM f GROUP BY ALL),
    e AS (SELECT a.tile, count(*) FILTER (a.t=b.t) AS eq, count(*) AS n FROM p a JOIN p b ON a.tile=b.tile AND ((b.r=a.r AND b.c=a.c+1) OR (b.r=a.r+1 AND b.c=a.c)) GROUP BY a.tile),
    s AS (SELECT a.tile, count(*) FILTER (a.t=b.t AND a.t=c.t AND a.t=d.t) AS one, count(*) AS n FROM p a JOIN p b ON b.tile=a.tile AND b.r=a.r AND b.c=a.c+1 JOIN p c ON c.tile=a.tile AND c.r=a.r+1 AND c.c=a.c JOIN p d ON d.tile=a.tile AND d.r=a.r+1 AND d.c=a.c+1 GROUP BY a.tile)
    SELECT t.tile, round(100.0*e.eq/e.n, 4)::DOUBLE AS equal_percent, round(100.0*s.one/s.n, 4)::DOUBLE AS uniform_percent FROM (SELECT DISTINCT tile FROM p) t LEFT JOIN e USING (tile) LEFT JOIN s USING (tile)"""


def pixel_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of eight by eight pixels halved once, absent quadrants filled with the ground's tone."""
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    leaves = L.tiles(spark, sf_dir).where("x < 40").select("z", "x", "y", "value")
    pixels = leaves.withColumn("px", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("py", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    tone = lambda m: ((F.col("value") + F.col("px") * m + F.col("py") * 31) % 256).cast("int")
    up = P.roll_up_pixels(pixels.select("z", "x", "y", "px", "py", tone(17).alias("red"), tone(5).alias("green")), 8, {"red": 200, "green": 40})
    return up.select("x", "y", "px", "py", "red", "green")


PIXEL_PYRAMID = L.ctes("tiles") + """, l AS (SELECT x, y, value FROM tiles WHERE x<40), p AS (SELECT x//2 AS x, y//2 AS y, x%2*8+i AS gx, y%2*8+j AS gy, (value+i*17+j*31)%256 AS r, (value+i*5+j*31)%256 AS g FROM l, range(8) a(i), range(8) b(j)),
    t AS (SELECT DISTINCT x, y FROM p), c AS (SELECT t.x, t.y, gx, gy, coalesce(r, 200) AS r, coalesce(g, 40) AS g FROM t CROSS JOIN range(16) a(gx) CROSS JOIN range(16) b(gy) LEFT JOIN p USING (x, y, gx, gy)),
    o AS (SELECT x, y, px, py, 4-2*abs(gx-2*px-0.5) AS wx, 4-2*abs(gy-2*py-0.5) AS wy, r, g FROM c, range(8) d(px), range(8) e(py) WHERE abs(gx-2*px-0.5)<2 AND abs(gy-2*py-0.5)<2)
    SELECT x, y, px, py, round((sum(wx*wy*r)/sum(wx*wy))::DOUBLE)::INT AS red, round((sum(wx*wy*g)/sum(wx*wy))::DOUBLE)::INT AS green FROM o GROUP BY ALL"""


def spread_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each view placed in two passes, one to a cell first."""
    k = F.col("s_suppkey")
    x, y = (k * 97 % 900).cast("double"), (k * 61 % 500).cast("double")
    rows = L.table(spark, sf_dir, "supplier", "s_suppkey").select((k % 7).alias("view"), F.concat(F.lit("area "), (k % 61).cast("string")).alias("name"), (k % 4).alias("rank"), x.alias("x"), y.alias("y"), (x - 40).alias("x0"), (y - 10).alias("y0"), (x + 40).alias("x1"), (y + 10).alias("y1"))
    return R.spread_labels(rows, "view", 9)


SPREAD_LABELS = """WITH RECURSIVE b AS (SELECT s_suppkey%7 AS view, 'area '||(s_suppkey%61) AS name, s_suppkey%4 AS rank, (s_suppkey*97%900)::DOUBLE AS x, (s_suppkey*61%500)::DOUBLE AS y, s_suppkey AS id FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY rank, name, id) AS i, count(*) OVER (PARTITION BY view) AS n FROM b), l AS (SELECT *, i+k*n AS pos, k AS second FROM r, range(2) t(k)),
    s AS (SELECT DISTINCT view, 0::BIGINT AS pos, []::STRUCT(name VARCHAR, x DOUBLE, y DOUBLE)[] AS p FROM b
        UNION ALL SELECT l.view, l.pos, CASE WHEN len(p)<9 AND len(list_filter(p, lambda q: q.name=l.name OR (abs(q.x-l.x)<80 AND abs(q.y-l.y)<20) OR (l.second=0 AND floor(q.x/190)=floor(l.x/190) AND floor(q.y/84)=floor(l.y/84))))=0
            THEN list_append(p, {'name': l.name, 'x': l.x, 'y': l.y}) ELSE p END FROM s JOIN l ON l.view=s.view AND l.pos=s.pos+1),
    e AS (SELECT view, arg_max(p, pos) AS p FROM s GROUP BY view), u AS (SELECT view, unnest(p) AS q, unnest(range(1, len(p)+1)) AS place FROM e) SELECT view, q.name AS name, place FROM u"""


def nearest_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty tiles nearest to a centre within a radius, and how many more there are."""
    d2 = F.pow(F.col("x") - 100, 2) + F.pow(F.col("y") - 100, 2)
    return O.nearest_reported(L.tiles(spark, sf_dir).withColumn("d2", d2).where("d2 <= 3600").select("x", "y", "d2"), ["d2", "y", "x"], 60)


NEAREST_OMITTED = L.ctes("tiles") + ", t AS (SELECT x, y, pow(x-100,2)+pow(y-100,2) AS d2 FROM tiles WHERE pow(x-100,2)+pow(y-100,2)<=3600) SELECT x, y, d2, greatest(0, (SELECT count(*) FROM t)-60) AS omitted FROM t ORDER BY d2, y, x LIMIT 60"


def ground_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground pixels graded by water, park, cover and their own green, then finished, and pressed into sixteen tones."""
    k = F.col("o_orderkey")
    rgb = ((k * 7 % 256).cast("int"), (k * 11 % 256).cast("int"), (k * 13 % 256).cast("int"))
    cover = F.element_at(F.array(F.lit("tree"), F.lit("grass"), F.lit("bare"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    pixels = L.table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", *[v.alias(c) for c, v in zip("rgb", rgb)], (k % 9 == 0).alias("water"), (k % 5 == 0).alias("park"), cover.alias("cover"))
    graded = pixels.select("o_orderkey", *[v.alias(c) for c, v in zip("rgb", C.ground(tuple(F.col(c) for c in "rgb"), F.col("water"), F.col("park"), F.col("cover")))])
    done = C.finish(tuple(F.col(c) for c in "rgb"))
    flat, lit = C.posterize_flat(tuple(F.col(c) for c in "rgb")), C.posterize_lit(tuple(F.col(c) for c in "rgb"), F.lit(0.75))
    return graded.select("o_orderkey", "r", "g", "b", done[0].alias("finished"), flat[1].alias("flat"), lit[2].alias("lit"))


GROUND_TONES = """WITH p AS (SELECT o_orderkey AS k, o_orderkey*7%256 AS r, o_orderkey*11%256 AS g, o_orderkey*13%256 AS b, o_orderkey%9=0 AS water, o_orderkey%5=0 AS park, o_orderkey%4 AS c FROM orders),
    q AS (SELECT *, least(g+12,255)>=r AND g>least(b+4,255) AS green FROM p),
    t AS (SELECT *, CASE WHEN water THEN [0.5,42,132,172] WHEN park AND (c<2 OR (c=3 AND green)) THEN [0.32,67,151,65] WHEN c=0 THEN [0.32,56,126,61] WHEN c=1 THEN [0.24,86,148,73] WHEN c=3 AND green THEN [0.24,72,142,68] ELSE [0,0,0,0] END::DOUBLE[] AS m FROM q),
    x AS (SELECT k, round(r*(1-m[1])+m[2]*m[1]) AS r, round(g*(1-m[1])+m[3]*m[1]) AS g, round(b*(1-m[1])+m[4]*m[1]) AS b FROM t), y AS (SELECT *, r*0.213::DOUBLE+g*0.715::DOUBLE+b*0.072::DOUBLE AS l FROM x)
    SELECT k AS o_orderkey, r::INT AS r, g::INT AS g, b::INT AS b, greatest(0, least(255, round((l+(r-l)*1.14::DOUBLE-127.5)*1.04::DOUBLE+127.5)))::INT AS finished, least(240, (24+g::INT*208//255+8)//16*16)::INT AS flat, least(255, (round(b*0.75)::INT+8)//16*16)::INT AS lit FROM y"""


def heights_and_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable of several heights in feet, and the angle between a wall and its street without direction."""
    k = F.col("p_partkey")
    feet = [F.when(k % 3 == 0, (k % 70).cast("double")), F.when(k % 2 == 0, (k % 2000).cast("double")), F.when(k % 5 != 0, (k % 11).cast("double"))]
    angle = g.angle_between((k % 9 - 4).cast("double"), (k % 7 - 3.5).cast("double"), (k % 5 - 2.5).cast("double"), (k % 8 - 4).cast("double"))
    return L.table(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.round(text.first_height(*feet), 6).alias("height"), F.round(angle, 6).alias("angle"))


_HEIGHT = "CASE WHEN {0}*0.3048006096012192::DOUBLE BETWEEN 2.4 AND 400 THEN {0}*0.3048006096012192::DOUBLE END"
HEIGHTS_AND_ANGLES = f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey%3=0 THEN p_partkey%70 END AS a, CASE WHEN p_partkey%2=0 THEN p_partkey%2000 END AS b, CASE WHEN p_partkey%5<>0 THEN p_partkey%11 END AS c,
        p_partkey%9-4::DOUBLE AS ax, p_partkey%7-3.5::DOUBLE AS ay, p_partkey%5-2.5::DOUBLE AS bx, p_partkey%8-4::DOUBLE AS b_y FROM part)
    SELECT k AS p_partkey, round(coalesce({_HEIGHT.format('a')}, {_HEIGHT.format('b')}, {_HEIGHT.format('c')}, 8.0), 6) AS height, round(degrees(acos(least(1.0, abs(ax*bx+ay*b_y)/(sqrt(ax*ax+ay*ay)*sqrt(bx*bx+b_y*b_y))))), 6) AS angle FROM p"""


def contents_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that do not have the digest stated for them, and market segments whose counts are not the pinned ones. The tables'
    schema is checked on the plan."""
    parts = L.table(spark, sf_dir, "part", "p_partkey", "p_name")
    K.exact_schema(parts, T.StructType().add("p_partkey", T.LongType()).add("p_name", T.StringType()))
    stated = parts.withColumn("digest", F.sha2(F.when(F.col("p_partkey") % 97 == 5, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).cast("binary"), 256))
    found = L.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    pinned = found.where("c_custkey % 50 <> 7 or c_mktsegment < 'C'").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return K.report(K.digests_match(stated, "digest", "p_name", "digest", "p_partkey"), K.same_distribution(found, pinned, "segments", "c_mktsegment"))


CONTENTS_AND_COUNTS = """WITH a AS (SELECT c_mktsegment AS v, count(*) AS n, count(*) FILTER (c_custkey%50<>7 OR c_mktsegment<'C') AS p FROM customer GROUP BY 1)
    SELECT 'digest' AS rule, p_partkey::VARCHAR AS subject, '' AS detail FROM part WHERE p_partkey%97=5 UNION ALL SELECT 'segments', v, 'found '||n FROM a WHERE n<>p UNION ALL SELECT 'segments', v, 'pinned '||p FROM a WHERE n<>p AND p>0"""

QUERIES = {
    "nearby_streets": (nearby_streets, NEARBY_STREETS),
    "inferred_roofs": (inferred_roofs, INFERRED_ROOFS),
    "shadow_areas": (shadow_areas, SHADOW_AREAS),
    "covered_samples": (covered_samples, COVERED_SAMPLES),
    "water_levels": (water_levels, WATER_LEVELS),
    "wall_tones": (wall_tones, WALL_TONES),
    "picture_audit": (picture_audit, PICTURE_AUDIT),
    "pixel_pyramid": (pixel_pyramid, PIXEL_PYRAMID),
    "spread_labels": (spread_labels, SPREAD_LABELS),
    "nearest_omitted": (nearest_omitted, NEAREST_OMITTED),
    "ground_tones": (ground_tones, GROUND_TONES),
    "heights_and_angles": (heights_and_angles, HEIGHTS_AND_ANGLES),
    "contents_and_counts": (contents_and_counts, CONTENTS_AND_COUNTS),
}
