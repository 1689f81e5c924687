"""Spatial, range and key joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pyramid as P
from ..operators import spatial as S
from ..sources import layers as L
from .evidence import BOX, CELL, MESH


def point_in_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meshes' centres in the smallest building that holds them, with the share of the parent they fill, capped."""
    area = S.box_area(MESH)
    centres = L.meshes(spark, sf_dir).select("mesh_id", ((F.col("mx0") + F.col("mx1")) / 2).alias("x"), ((F.col("my0") + F.col("my1")) / 2).alias("y"), area.alias("own_area"))
    held = S.smallest_container(centres, L.buildings(spark, sf_dir), ("x", "y"), BOX, CELL, ["mesh_id", "own_area"], "building_id")
    return held.groupBy("building_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.least("own_area", "area")).alias("parts_area"), (F.sum(F.least("own_area", "area")) >= 0.65 * F.max("area")).alias("detailed"))


POINT_IN_SMALLEST = L.ctes("buildings", "meshes") + """,
    held AS (SELECT mesh_id, (mx1-mx0)*(my1-my0) AS own, arg_min(building_id, ((max_x-min_x)*(max_y-min_y), building_id)) AS building_id, min((max_x-min_x)*(max_y-min_y)) AS area
        FROM meshes JOIN buildings ON (mx0+mx1)/2 BETWEEN min_x AND max_x AND (my0+my1)/2 BETWEEN min_y AND max_y GROUP BY ALL)
    SELECT building_id, count(*) AS parts, sum(least(own, area)) AS parts_area, sum(least(own, area)) >= 0.65*max(area) AS detailed FROM held GROUP BY building_id"""


def photographed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with a mesh within 2 units that is high enough: a semi join."""
    near = S.within_distance(L.buildings(spark, sf_dir), L.meshes(spark, sf_dir), BOX, MESH, CELL, 2.0, F.col("mesh_height") >= 0.5 * F.col("height"))
    return L.buildings(spark, sf_dir).join(near.select("building_id"), "building_id", "left_semi").select("building_id", "height")


PHOTOGRAPHED = L.ctes("buildings", "meshes") + """
    SELECT building_id, height FROM buildings WHERE EXISTS (SELECT 1 FROM meshes WHERE mesh_height >= 0.5*height AND mx0<=max_x+2 AND min_x-2<=mx1 AND my0<=max_y+2 AND min_y-2<=my1
        AND pow(greatest(0, mx0-max_x, min_x-mx1),2)+pow(greatest(0, my0-max_y, min_y-my1),2) <= 4)"""


def tile_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer rows dealt to the 64-unit tiles that they touch; tiles with buildings, without meshes apart."""
    b = P.tiles_of(L.buildings(spark, sf_dir), BOX, 64.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("buildings"), F.max("height").alias("top"))
    m = P.tiles_of(L.meshes(spark, sf_dir), MESH, 64.0, 2.0).select("tx", "ty").distinct()
    return b.join(m.withColumn("has_mesh", F.lit(True)), ["tx", "ty"], "left").select("tx", "ty", "buildings", "top", F.coalesce("has_mesh", F.lit(False)).alias("has_mesh"))


TILE_LAYERS = L.ctes("buildings", "meshes") + """,
    b AS (SELECT unnest(range(floor(min_x/64)::BIGINT, floor(max_x/64)::BIGINT+1)) AS tx, min_y, max_y, height FROM buildings), b2 AS (SELECT tx, unnest(range(floor(min_y/64)::BIGINT, floor(max_y/64)::BIGINT+1)) AS ty, height FROM b),
    m AS (SELECT unnest(range(floor((mx0-2)/64)::BIGINT, floor((mx1+2)/64)::BIGINT+1)) AS tx, my0, my1 FROM meshes), m2 AS (SELECT DISTINCT tx, unnest(range(floor((my0-2)/64)::BIGINT, floor((my1+2)/64)::BIGINT+1)) AS ty FROM m)
    SELECT tx, ty, count(*) AS buildings, max(height) AS top, bool_or(m2.tx IS NOT NULL) AS has_mesh FROM b2 LEFT JOIN m2 USING (tx, ty) GROUP BY tx, ty"""


def nearest_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three meshes nearest to each building's corner within 40 units."""
    m = L.meshes(spark, sf_dir).select("mesh_id", F.col("mx0").alias("qx"), F.col("my0").alias("qy"))
    return S.nearest_k(L.buildings(spark, sf_dir).select("building_id", "min_x", "min_y"), m, ("min_x", "min_y"), ("qx", "qy"), 40.0, 3, ["building_id"], ["mesh_id"]).select("building_id", "mesh_id", "d2", "place")


NEAREST_MESHES = L.ctes("buildings", "meshes") + """
    SELECT building_id, mesh_id, pow(min_x-mx0,2)+pow(min_y-my0,2) AS d2, row_number() OVER (PARTITION BY building_id ORDER BY pow(min_x-mx0,2)+pow(min_y-my0,2), mesh_id) AS place
    FROM buildings JOIN meshes ON abs(min_x-mx0) <= 40 AND abs(min_y-my0) <= 40 AND pow(min_x-mx0,2)+pow(min_y-my0,2) <= 1600 QUALIFY place <= 3"""


def sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one user's frames at most ten places apart and of one segment, some frames excluded: frames are numbered, then
    each is dealt to its later places, so that the range becomes an equality."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = L.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").withColumn("seq", F.row_number().over(order))
    frames = numbered.where("event_id % 50 <> 7").withColumn("segment", F.floor(F.col("seq") / 40))
    ahead = frames.select("user_id", "segment", F.col("event_id").alias("left_id"), F.explode(F.array(*[F.struct((F.col("seq") + k).alias("seq"), F.lit(k).alias("gap")) for k in range(1, 11)])).alias("n"))
    right = frames.select("user_id", "segment", F.col("event_id").alias("right_id"), "seq")
    return ahead.select("user_id", "segment", "left_id", "n.seq", "n.gap").join(right, ["user_id", "segment", "seq"]).select("user_id", "left_id", "right_id", "gap")


SEQUENCE_PAIRS = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), f AS (SELECT *, seq//40 AS segment FROM n WHERE event_id%50<>7)
    SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id, (b.seq-a.seq)::INT AS gap FROM f a JOIN f b ON a.user_id=b.user_id AND a.segment=b.segment AND b.seq BETWEEN a.seq+1 AND a.seq+10"""


def area_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed policy of unordered pairs: nations of one region, least name first."""
    n = L.table(spark, sf_dir, "nation").select("n_name", "n_regionkey", "n_nationkey")
    b = n.select(F.col("n_name").alias("other"), F.col("n_regionkey").alias("r2"), F.col("n_nationkey").alias("k2"))
    pairs = n.join(b, (F.col("n_regionkey") == F.col("r2")) & (F.col("n_name") < F.col("other")))
    policy = spark.createDataFrame([("ALGERIA", "KENYA", "nested"), ("FRANCE", "GERMANY", "shared")], "p text, q text, policy text".replace("text", "string"))
    return pairs.join(policy, (F.least("n_name", "other") == F.col("p")) & (F.greatest("n_name", "other") == F.col("q")), "left").select("n_name", "other", F.coalesce("policy", F.lit("unreviewed")).alias("policy"))


AREA_PAIRS = """WITH p(p, q, policy) AS (VALUES ('ALGERIA','KENYA','nested'), ('FRANCE','GERMANY','shared'))
    SELECT a.n_name, b.n_name AS other, coalesce(policy, 'unreviewed') AS policy FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_name<b.n_name LEFT JOIN p ON p.p=a.n_name AND p.q=b.n_name"""


def plan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan against manifest: missing, unplanned and repeated keys, one full outer join on counts."""
    plan = L.table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("planned"))
    made = L.table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber").where("l_linenumber = 7").select(F.col("l_partkey").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("made"))
    status = F.when(F.col("planned").isNull(), "unplanned").when(F.col("made").isNull(), "missing").when(F.col("made") > 1, "repeated").otherwise("present")
    return plan.join(made, "k", "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


PLAN_MANIFEST = """WITH a AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey%10<>3), b AS (SELECT l_partkey AS k, count(*) AS made FROM lineitem WHERE l_linenumber=7 GROUP BY 1)
    SELECT CASE WHEN a.k IS NULL THEN 'unplanned' WHEN b.k IS NULL THEN 'missing' WHEN made>1 THEN 'repeated' ELSE 'present' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k=b.k GROUP BY 1"""


def gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected source rectangles with the number of footprints that they touch, the first and the last of them."""
    gaps = L.table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", *[e.cast("double").alias(n) for n, e in (("gx0", F.col("s_suppkey") * 97 % 900 * 16), ("gy0", F.lit(0)), ("gx1", F.col("s_suppkey") * 97 % 900 * 16 + 60), ("gy1", F.lit(40)))])
    met = S.bucket_join(L.buildings(spark, sf_dir), gaps, BOX, ("gx0", "gy0", "gx1", "gy1"), CELL)
    return met.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("footprints"), F.min("building_id").alias("first"), F.max("building_id").alias("last"))


GAP_COUNTS = L.ctes("buildings") + """, g AS (SELECT s_suppkey, s_suppkey*97%900*16 AS gx0, 0 AS gy0, s_suppkey*97%900*16+60 AS gx1, 40 AS gy1 FROM supplier)
    SELECT s_suppkey, count(*) AS footprints, min(building_id) AS first, max(building_id) AS last FROM buildings JOIN g ON min_x<=gx1 AND gx0<=max_x AND min_y<=gy1 AND gy0<=max_y GROUP BY s_suppkey"""

QUERIES = {
    "point_in_smallest": (point_in_smallest, POINT_IN_SMALLEST),
    "photographed": (photographed, PHOTOGRAPHED),
    "tile_layers": (tile_layers, TILE_LAYERS),
    "nearest_meshes": (nearest_meshes, NEAREST_MESHES),
    "sequence_pairs": (sequence_pairs, SEQUENCE_PAIRS),
    "area_pairs": (area_pairs, AREA_PAIRS),
    "plan_manifest": (plan_manifest, PLAN_MANIFEST),
    "gap_counts": (gap_counts, GAP_COUNTS),
}
