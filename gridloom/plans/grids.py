"""Grid binning, interpolation, focal operators and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import spatial as S
from ..sources import layers as L


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cell_medians(L.cells(spark, sf_dir))


_GRID = L.ctes("cells") + """, grid AS (SELECT "row", col, median(value) AS value FROM cells GROUP BY ALL HAVING count(*) >= 3)"""


def grid_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


def grid_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without samples enough, by inverse squared distance from up to five cells within three."""
    known = grid(spark, sf_dir)
    empty = _all_cells(known).join(known.select("row", "col"), ["row", "col"], "left_anti").select(F.col("row").alias("r"), F.col("col").alias("c"))
    near = S.nearest_k(empty, known, ("c", "r"), ("col", "row"), 3.0, 5, ["r", "c"], ["row", "col"])
    filled = G.inverse_distance(near, ["r", "c"], "value")
    return filled.select(F.col("r").alias("row"), F.col("c").alias("col"), F.round("value", 6).alias("value"))


def _all_cells(known: DataFrame) -> DataFrame:
    """Every place in the rows that the grid has."""
    return known.select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))


GRID_FILLED = _GRID + """, e AS (SELECT r."row" AS r, c.col AS c FROM (SELECT DISTINCT "row" FROM grid) r, (SELECT unnest(range(64)) AS col) c WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g."row"=r."row" AND g.col=c.col)),
    n AS (SELECT r, c, value, pow(r-"row",2)+pow(c-col,2) AS d2 FROM e JOIN grid ON abs(r-"row")<=3 AND abs(c-col)<=3 AND pow(r-"row",2)+pow(c-col,2)<=9
        QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY pow(r-"row",2)+pow(c-col,2), "row", col) <= 5)
    SELECT r AS "row", c AS col, round(sum(value/d2)/sum(1/d2), 6) AS value FROM n GROUP BY r, c"""


def focal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.focal(grid(spark, sf_dir), "value", F.median("value"), "smooth")


_NEAR = """FROM grid a JOIN grid b ON b."row" BETWEEN a."row"-1 AND a."row"+1 AND b.col BETWEEN a.col-1 AND a.col+1 GROUP BY a."row", a.col"""
FOCAL_MEDIAN = _GRID + f""" SELECT a."row", a.col, median(b.value) AS smooth {_NEAR}"""


def box_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.box_average(grid(spark, sf_dir).withColumn("value", F.floor("value")))


BOX_AVERAGE = _GRID + f""" SELECT a."row", a.col, CASE WHEN count(*)=9 THEN floor(sum(floor(b.value))/9)::BIGINT END AS average {_NEAR}"""


def canopy_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance, 0 to 3, of cells with a sample at all."""
    return G.erosion_clearance(L.cells(spark, sf_dir).where("value > 10")).groupBy("clearance").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("row") * 64 + F.col("col")).alias("checksum"))


CANOPY_CLEARANCE = L.ctes("cells") + """, c0 AS (SELECT DISTINCT "row", col FROM cells WHERE value > 10),
    c1 AS (SELECT a."row", a.col FROM c0 a JOIN c0 b ON abs(b."row"-a."row")<=1 AND abs(b.col-a.col)<=1 GROUP BY ALL HAVING count(*)=9),
    c2 AS (SELECT a."row", a.col FROM c1 a JOIN c1 b ON abs(b."row"-a."row")<=1 AND abs(b.col-a.col)<=1 GROUP BY ALL HAVING count(*)=9),
    c3 AS (SELECT a."row", a.col FROM c2 a JOIN c2 b ON abs(b."row"-a."row")<=1 AND abs(b.col-a.col)<=1 GROUP BY ALL HAVING count(*)=9),
    u AS (SELECT "row", col, count(*)-1 AS clearance FROM (FROM c0 UNION ALL FROM c1 UNION ALL FROM c2 UNION ALL FROM c3) GROUP BY ALL)
    SELECT clearance, count(*) AS cells, sum("row"*64+col)::BIGINT AS checksum FROM u GROUP BY clearance"""


def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = L.table(spark, sf_dir, "part", "p_partkey").select("p_partkey", (F.col("p_partkey") % 50 * 0.25).alias("sr"), (F.col("p_partkey") * 7 % 250 * 0.25).alias("sc"))
    return G.bilinear(asked, grid(spark, sf_dir), "value", ["p_partkey"]).select("p_partkey", F.round("value", 6).alias("value"))


BILINEAR_SAMPLE = _GRID + """, s AS (SELECT p_partkey, p_partkey%50*0.25 AS sr, p_partkey*7%250*0.25 AS sc FROM part)
    SELECT p_partkey, CASE WHEN count(value)=4 THEN round(sum((CASE WHEN i=1 THEN sr-floor(sr) ELSE 1-(sr-floor(sr)) END)*(CASE WHEN j=1 THEN sc-floor(sc) ELSE 1-(sc-floor(sc)) END)*value), 6) END AS value
    FROM s, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j) LEFT JOIN grid ON "row"=floor(sr)+i AND col=floor(sc)+j GROUP BY p_partkey"""


def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hillshade(grid(spark, sf_dir), "value", 256.0).select("row", "col", F.round("shade", 6).alias("shade"))


HILLSHADE = _GRID + """ SELECT o."row", o.col, round(coalesce((-((e.value-w.value)/512)*-0.5 - ((n.value-s.value)/512)*0.5 + 0.75)/sqrt(pow((e.value-w.value)/512,2)+pow((n.value-s.value)/512,2)+1), 1.0), 6) AS shade
    FROM grid o LEFT JOIN grid e ON e."row"=o."row" AND e.col=o.col+1 LEFT JOIN grid w ON w."row"=o."row" AND w.col=o.col-1 LEFT JOIN grid n ON n."row"=o."row"+1 AND n.col=o.col LEFT JOIN grid s ON s."row"=o."row"-1 AND s.col=o.col"""


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by class, where water overrides the raster's class."""
    cls = F.when(F.col("o_custkey") % 11 == 0, "water").otherwise(F.lower(F.substring("o_orderpriority", 3, 20)))
    return L.table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("cells"))


CLASS_HISTOGRAM = "SELECT CASE WHEN o_custkey%11=0 THEN 'water' ELSE lower(substring(o_orderpriority, 3, 20)) END AS class, count(*) AS cells FROM orders GROUP BY 1"

QUERIES = {
    "grid_medians": (grid_medians, _GRID + """ SELECT "row", col, value FROM grid"""),
    "grid_filled": (grid_filled, GRID_FILLED),
    "focal_median": (focal_median, FOCAL_MEDIAN),
    "box_average": (box_average, BOX_AVERAGE),
    "canopy_clearance": (canopy_clearance, CANOPY_CLEARANCE),
    "bilinear_sample": (bilinear_sample, BILINEAR_SAMPLE),
    "hillshade": (hillshade, HILLSHADE),
    "class_histogram": (class_histogram, CLASS_HISTOGRAM),
}
