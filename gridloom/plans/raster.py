"""Compositing and picture metrics on pixels derived from line items and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as R
from ..sources import layers as L


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, px, py, depth, color, layer, seq."""
    ok, ln, pk, sk = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    rows = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(
        F.floor(ok / 512).alias("tile"), (pk % 16).alias("px"), (ok % 16).alias("py"), (sk % 8).alias("depth"), (pk * 7 % 256).alias("color"), (ln % 4).alias("layer"), ((ok * 8 + ln) * 100_003 + pk % 100_003).alias("seq")
    )


_FRAGMENTS = """WITH f AS (SELECT l_orderkey//512 AS tile, l_partkey%16 AS px, l_orderkey%16 AS py, l_suppkey%8 AS depth, l_partkey*7%256 AS color, l_linenumber%4 AS layer, (l_orderkey*8+l_linenumber)*100003+l_partkey%100003 AS seq FROM lineitem)"""


def depth_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest_depth(fragments(spark, sf_dir), ["tile", "px", "py"], "color", "depth", "seq")


DEPTH = _FRAGMENTS + " SELECT tile, px, py, arg_max(color, (depth, -seq)) AS color, max(depth) AS depth, count(*) AS fragments FROM f GROUP BY ALL"


def layer_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.layered(fragments(spark, sf_dir), ["tile", "px", "py"], "color", "layer", "depth", "seq")


LAYERS = _FRAGMENTS + " SELECT tile, px, py, arg_max(color, (layer, depth, -seq)) AS color, max(layer) AS layer FROM f GROUP BY tile, px, py"


def triangle_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and mean depth of triangles."""
    k = F.col("p_partkey")
    t = L.table(spark, sf_dir, "part", "p_partkey").select("p_partkey", *[e.cast("double").alias(n) for n, e in {"ax": k % 5, "ay": k % 7, "bx": k % 5 + 8, "by": k % 3, "cx": k % 11, "cy": k % 7 + 8}.items()])
    hit = R.triangle_pixels(t, ("ax", "ay"), ("bx", "by"), ("cx", "cy"))
    return hit.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(F.col("wa") * 1 + F.col("wb") * 2 + F.col("wc") * 4), 6).alias("depth"))


TRIANGLES = """WITH t AS (SELECT p_partkey, p_partkey%5::DOUBLE AS ax, p_partkey%7::DOUBLE AS ay, p_partkey%5+8::DOUBLE AS bx, p_partkey%3::DOUBLE AS by_, p_partkey%11::DOUBLE AS cx, p_partkey%7+8::DOUBLE AS cy FROM part),
    p AS (SELECT *, x+0.5 AS px, y+0.5 AS py, (bx-ax)*(cy-ay)-(cx-ax)*(by_-ay) AS area FROM t, (SELECT unnest(range(20)) AS x), (SELECT unnest(range(20)) AS y)),
    w AS (SELECT p_partkey, ((bx-px)*(cy-py)-(cx-px)*(by_-py))/area AS wa, ((cx-px)*(ay-py)-(ax-px)*(cy-py))/area AS wb FROM p WHERE area<>0)
    SELECT p_partkey, count(*) AS pixels, round(avg(wa*1+wb*2+(1-wa-wb)*4),6) AS depth FROM w WHERE wa>=0 AND wb>=0 AND 1-wa-wb>=0 GROUP BY p_partkey"""


def facade_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median colour of each tile, without the darkest samples."""
    return R.ranked_median(fragments(spark, sf_dir).where("color >= 16"), ["tile"], "color")


FACADE = _FRAGMENTS + " SELECT tile, list_sort(list(color))[count(*)//2+1] AS median FROM f WHERE color>=16 GROUP BY tile"


def water_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_window(fragments(spark, sf_dir).withColumn("bin", F.floor(F.col("color") / 8)), ["tile"], "bin", share=0.2)


WATER = _FRAGMENTS + """, c AS (SELECT tile, color//8 AS bin, count(*) AS n FROM f GROUP BY ALL), a AS (SELECT m.tile, m.bin AS mode, sum(o.n)::BIGINT AS within FROM c m JOIN c o ON o.tile=m.tile AND o.bin BETWEEN m.bin-2 AND m.bin+2 GROUP BY ALL)
    SELECT a.tile, arg_max(mode, (within, -mode)) AS mode, max(within) AS within, any_value(t.total) AS total, max(within)>=0.2*any_value(t.total) AS dominant FROM a JOIN (SELECT tile, sum(n)::BIGINT AS total FROM c GROUP BY tile) t USING (tile) GROUP BY a.tile"""


def tile_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.entropy(fragments(spark, sf_dir).withColumn("bin", F.floor(F.col("color") / 16)), ["tile"], "bin")
    return e.select("tile", F.round("entropy", 6).alias("entropy"), "pixels", (F.col("entropy") >= 1.5).alias("passes"))


ENTROPY = _FRAGMENTS + """, c AS (SELECT tile, color//16 AS bin, count(*) AS n FROM f GROUP BY ALL)
    SELECT tile, round(log2(sum(n)) - sum(n*log2(n))/sum(n), 6) AS entropy, sum(n)::BIGINT AS pixels, log2(sum(n)) - sum(n*log2(n))/sum(n) >= 1.5 AS passes FROM c GROUP BY tile"""


def pixel_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = depth_composite(spark, sf_dir).where("px <> 3")
    a = depth_composite(spark, sf_dir).where("py <> 5").withColumn("color", F.when(F.col("tile") % 3 == 0, F.col("color") + 1).otherwise(F.col("color"))).withColumn("mask", F.col("px") < 8)
    return R.difference(b, a, ["tile", "px", "py"], "color", "mask")


DIFFERENCE = _FRAGMENTS + """, d AS (SELECT tile, px, py FROM f GROUP BY ALL) SELECT count(*) FILTER (px<>3 AND py<>5 AND tile%3=0 AND px<8) AS inside, count(*) FILTER (px<>3 AND py<>5 AND tile%3=0 AND px>=8) AS outside,
    count(*) FILTER ((px<>3) <> (py<>5)) AS unmatched, count(*) FILTER (px<>3 OR py<>5) AS pixels FROM d"""


def water_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic tone of water pixels in world coordinates, in whole thousandths."""
    phase = F.pmod((F.col("tile") * 16 + F.col("px")) * 75 + F.col("py") * 35, F.lit(29_000))
    return fragments(spark, sf_dir).groupBy(F.when(phase < 3_000, "crest").when(phase < 9_000, "rise").otherwise("plain").alias("band")).agg(F.count(F.lit(1)).alias("n"))


BANDS = _FRAGMENTS + ", p AS (SELECT ((tile*16+px)*75+py*35)%29000 AS v FROM f) SELECT CASE WHEN v<3000 THEN 'crest' WHEN v<9000 THEN 'rise' ELSE 'plain' END AS band, count(*) AS n FROM p GROUP BY 1"


def block_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 4 x 4 blocks computed once per block and joined back to the pixels."""
    f = fragments(spark, sf_dir).withColumns({"bx": F.floor(F.col("px") / 4), "by": F.floor(F.col("py") / 4)})
    once = f.groupBy("tile", "bx", "by").agg(F.min_by("color", "seq").alias("tone"))
    return f.join(once, ["tile", "bx", "by"]).groupBy("tile").agg(F.count_if(F.col("color") == F.col("tone")).alias("same"), F.sum("tone").alias("tones"))


MEMO = _FRAGMENTS + ", o AS (SELECT tile, px//4 AS bx, py//4 AS b_y, arg_min(color, seq) AS tone FROM f GROUP BY ALL) SELECT f.tile, count(*) FILTER (color=tone) AS same, sum(tone)::BIGINT AS tones FROM f JOIN o ON o.tile=f.tile AND bx=px//4 AND b_y=py//4 GROUP BY f.tile"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' labels placed in one viewport per region."""
    k = F.col("n_nationkey")
    rows = L.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("view"), F.col("n_name").alias("name"), (k % 3).alias("rank"), (k * 7 % 20).cast("double").alias("x0"), (k * 5 % 9).cast("double").alias("y0"))
    return R.place_labels(rows.withColumns({"x1": F.col("x0") + 6, "y1": F.col("y0") + 2}), "view", 3)


def enclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered cells and enclosed holes of each tile's picture."""
    cells = fragments(spark, sf_dir).where("color >= 64").select("tile", F.col("py").alias("row"), F.col("px").alias("col"))
    return R.outside_fill(cells, ["tile"], 16, 16).groupBy("tile").agg(F.count(F.lit(1)).alias("cells"))


LABELS = """WITH RECURSIVE b AS (SELECT n_regionkey AS view, n_name AS name, n_nationkey%3 AS rank, (n_nationkey*7%20)::DOUBLE AS x0, (n_nationkey*5%9)::DOUBLE AS y0 FROM nation),
    l AS (SELECT view, name, x0, y0, x0+6 AS x1, y0+2 AS y1, row_number() OVER (PARTITION BY view ORDER BY rank, name) AS i FROM b),
    s AS (SELECT DISTINCT view, 0::BIGINT AS i, []::STRUCT(name VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS p FROM l
        UNION ALL SELECT l.view, l.i, CASE WHEN len(p)<3 AND len(list_filter(p, lambda q: q.name=l.name OR NOT (l.x1<=q.x0 OR q.x1<=l.x0 OR l.y1<=q.y0 OR q.y1<=l.y0)))=0
            THEN list_append(p, {'name': l.name, 'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1}) ELSE p END FROM s JOIN l ON l.view=s.view AND l.i=s.i+1),
    e AS (SELECT view, arg_max(p, i) AS p FROM s GROUP BY view), u AS (SELECT view, unnest(p) AS q, unnest(range(1, len(p)+1)) AS place FROM e) SELECT view, q.name AS name, place FROM u"""
ENCLOSED = """WITH RECURSIVE f AS (SELECT DISTINCT l_orderkey//512 AS tile, l_orderkey%16 AS r, l_partkey%16 AS c FROM lineitem WHERE l_partkey*7%256>=64), t AS (SELECT DISTINCT tile FROM f),
    grid AS (SELECT tile, r, c FROM t, range(-1, 17) a(r), range(-1, 17) b(c)), free AS (SELECT * FROM grid ANTI JOIN f USING (tile, r, c)),
    reach AS (SELECT tile, -1::BIGINT AS r, -1::BIGINT AS c FROM t UNION SELECT free.tile, free.r, free.c FROM reach JOIN free ON free.tile=reach.tile AND ((free.r=reach.r AND abs(free.c-reach.c)=1) OR (free.c=reach.c AND abs(free.r-reach.r)=1)))
    SELECT tile, count(*) AS cells FROM grid ANTI JOIN reach USING (tile, r, c) WHERE r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15 GROUP BY tile"""

QUERIES = {
    "depth_composite": (depth_composite, DEPTH),
    "layer_composite": (layer_composite, LAYERS),
    "triangle_raster": (triangle_raster, TRIANGLES),
    "facade_median": (facade_median, FACADE),
    "water_mode": (water_mode, WATER),
    "tile_entropy": (tile_entropy, ENTROPY),
    "pixel_difference": (pixel_difference, DIFFERENCE),
    "water_bands": (water_bands, BANDS),
    "block_memo": (block_memo, MEMO),
    "place_labels": (labels, LABELS),
    "outside_fill": (enclosed, ENCLOSED),
}
