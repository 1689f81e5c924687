"""Building heights from classified points, coverage and building context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import context as X
from ..operators import evidence as E
from ..operators import spatial as S
from ..sources import layers as L

BOX = ("min_x", "min_y", "max_x", "max_y")
MESH = ("mx0", "my0", "mx1", "my1")
CELL, BUFFER = 32.0, 4.0


def evidence_of(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    return E.height_evidence(L.points(spark, sf_dir), L.buildings(spark, sf_dir), BOX, CELL, BUFFER, keys, min_roof=4, min_ground=3, high_roof=8, high_ground=5)


def height_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence_of(spark, sf_dir, ["building_id"])
    return out.select("building_id", "roof_points", "ground_points", "quality", *[F.round(c, 6).alias(c) for c in ("ground_m", "p10_m", "p50_m", "p90_m", "height_m", "spread_m")])


def _evidence_sql(keys: str) -> str:
    return L.ctes("buildings", "points") + f""",
    met AS (SELECT b.building_id, p.tile, p.cls, p.z FROM points p JOIN buildings b ON
        (p.cls = 6 AND p.x > min_x AND p.x < max_x AND p.y > min_y AND p.y < max_y) OR
        (p.cls = 2 AND p.x BETWEEN min_x-4 AND max_x+4 AND p.y BETWEEN min_y-4 AND max_y+4 AND pow(greatest(0, min_x-p.x, p.x-max_x),2) + pow(greatest(0, min_y-p.y, p.y-max_y),2) <= 16)),
    q AS (SELECT {keys}, count(*) FILTER (cls=6) AS roof_points, count(*) FILTER (cls=2) AS ground_points, quantile_cont(z, 0.25) FILTER (cls=2) AS g,
        quantile_cont(z, 0.1) FILTER (cls=6) AS a, quantile_cont(z, 0.5) FILTER (cls=6) AS m, quantile_cont(z, 0.9) FILTER (cls=6) AS h FROM met GROUP BY {keys}),
    ev AS (SELECT {keys}, roof_points, ground_points, CASE WHEN roof_points >= 8 AND ground_points >= 5 THEN 'high' ELSE 'usable' END AS quality, g*0.01 AS ground_m,
        a*0.01 AS p10_m, m*0.01 AS p50_m, h*0.01 AS p90_m, (h-g)*0.01 AS height_m, (h-a)*0.01 AS spread_m FROM q WHERE roof_points >= 4 AND ground_points >= 3)"""


HEIGHT_EVIDENCE = _evidence_sql("building_id") + """
    SELECT building_id, roof_points, ground_points, quality, round(ground_m,6) AS ground_m, round(p10_m,6) AS p10_m, round(p50_m,6) AS p50_m,
        round(p90_m,6) AS p90_m, round(height_m,6) AS height_m, round(spread_m,6) AS spread_m FROM ev"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_evidence(evidence_of(spark, sf_dir, ["building_id", "tile"]), "building_id", "tile")


def heights_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every building with its measured height where the best evidence is accepted, else its own."""
    found = best(spark, sf_dir).where("accepted").select("building_id", "tile", F.col("height_m").alias("measured"))
    joined = L.buildings(spark, sf_dir).join(found, "building_id", "left")
    return joined.select("building_id", "tile", F.round(F.coalesce("measured", "height"), 6).alias("height"), F.col("measured").isNotNull().alias("is_measured"))


_BEST = """, ok AS (SELECT *, (height_m BETWEEN 2.4 AND 400 AND spread_m <= greatest(1.0, height_m*0.35)) AS accepted FROM ev),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY accepted DESC, quality='high' DESC, ground_points DESC, roof_points DESC, tile) AS n FROM ok),
    best AS (SELECT * FROM ranked WHERE n = 1)"""
HEIGHTS_APPLIED = _evidence_sql("building_id, tile") + _BEST + """
    SELECT b.building_id, r.tile, round(coalesce(r.height_m, b.height), 6) AS height, r.height_m IS NOT NULL AS is_measured
    FROM buildings b LEFT JOIN (SELECT * FROM best WHERE accepted) r USING (building_id)"""


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many buildings of each row of plots have accepted evidence, by number and by area."""
    flags = L.buildings(spark, sf_dir).join(best(spark, sf_dir).where("accepted").select("building_id", "accepted"), "building_id", "left")
    return E.coverage(flags.withColumn("plot_row", (F.col("min_y") / 32).cast("long")), F.col("accepted").isNotNull(), S.box_area(BOX), ["plot_row"])


EVIDENCE_COVERAGE = _evidence_sql("building_id, tile") + _BEST + """,
    f AS (SELECT (min_y/32)::BIGINT AS plot_row, (max_x-min_x)*(max_y-min_y) AS a, coalesce(accepted, false) AS c FROM buildings LEFT JOIN (SELECT building_id, accepted FROM best WHERE accepted) USING (building_id))
    SELECT plot_row, count(*) AS n, count(*) FILTER (c) AS n_covered, sum(a) AS area, coalesce(sum(a) FILTER (c),0) AS area_covered,
        round_even(100.0*count(*) FILTER (c)/count(*), 2) AS percent, round_even(100.0*coalesce(sum(a) FILTER (c),0)/sum(a), 2) AS area_percent FROM f GROUP BY plot_row"""


def mesh_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings near a mesh: any, one of the first rank, and the nearest of them by (distance, id)."""
    near = S.within_distance(L.buildings(spark, sf_dir), L.meshes(spark, sf_dir), BOX, MESH, CELL, 3.0)
    ratio = S.box_area(MESH) / S.box_area(BOX) >= 0.25
    tall = F.col("mesh_height") >= 0.9 * F.col("height")
    return near.groupBy("building_id").agg(
        F.bool_or(ratio).alias("covered"), F.bool_or(ratio & (F.col("priority") == 0)).alias("covered_first"), F.bool_or(tall).alias("tall"), F.count(F.lit(1)).alias("meshes"),
        F.min_by("mesh_id", F.struct(S.box_gap2(BOX, MESH), "mesh_id")).alias("nearest"),
    )


_GAP = "pow(greatest(0, mx0-max_x, min_x-mx1),2)+pow(greatest(0, my0-max_y, min_y-my1),2)"
MESH_COVERAGE = L.ctes("buildings", "meshes") + f""",
    near AS (SELECT *, {_GAP} AS d2, (mx1-mx0)*(my1-my0)/((max_x-min_x)*(max_y-min_y)) >= 0.25 AS r FROM buildings JOIN meshes ON mx0<=max_x+3 AND min_x-3<=mx1 AND my0<=max_y+3 AND min_y-3<=my1 AND {_GAP} <= 9)
    SELECT building_id, bool_or(r) AS covered, bool_or(r AND priority=0) AS covered_first, bool_or(mesh_height >= 0.9*height) AS tall, count(*) AS meshes,
        arg_min(mesh_id, (d2, mesh_id)) AS nearest FROM near GROUP BY building_id"""


def mesh_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drop_covered(L.meshes(spark, sf_dir), [0, 1, 2], MESH, CELL).select("mesh_id", "priority")


def _covers(a: str, b: str) -> str:
    """SQL: a source of ``a`` covers one of ``b``."""
    over = f"greatest(0, least({a}.mx1,{b}.mx1)-greatest({a}.mx0,{b}.mx0))*greatest(0, least({a}.my1,{b}.my1)-greatest({a}.my0,{b}.my0))"
    centre = f"(({b}.mx0+{b}.mx1)/2 BETWEEN {a}.mx0 AND {a}.mx1 AND ({b}.my0+{b}.my1)/2 BETWEEN {a}.my0 AND {a}.my1)"
    meets = f"{a}.mx0<={b}.mx1 AND {b}.mx0<={a}.mx1 AND {a}.my0<={b}.my1 AND {b}.my0<={a}.my1"
    return f"{meets} AND ({centre} OR {over} >= 0.25*({b}.mx1-{b}.mx0)*({b}.my1-{b}.my0))"


MESH_PRIORITY = L.ctes("meshes") + f""", k0 AS (SELECT * FROM meshes WHERE priority=0),
    k1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM meshes m WHERE priority=1 AND NOT EXISTS (SELECT 1 FROM k0 WHERE {_covers('k0', 'm')})),
    k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM meshes m WHERE priority=2 AND NOT EXISTS (SELECT 1 FROM k1 WHERE {_covers('k1', 'm')}))
    SELECT mesh_id, priority FROM k2"""


def building_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party walls of terraced houses, their runs, and the kind of each house."""
    houses = L.houses(spark, sf_dir).select("building_id", "height", g.box_ring(*[F.col(c) for c in BOX]).alias("ring"))
    return X.contexts(houses, "building_id", 32.0).select("building_id", "component", "size", "mask", "kind")


BUILDING_CONTEXT = L.ctes("houses", recursive=True) + """,
    met AS (SELECT a.building_id AS a, b.building_id AS b, CASE WHEN abs(b.min_x-a.max_x)<=0.823 THEN 1 ELSE 3 END AS edge FROM houses a JOIN houses b ON a.min_y=b.min_y AND a.building_id<>b.building_id
        AND (abs(b.min_x-a.max_x)<=0.823 OR abs(a.min_x-b.max_x)<=0.823)),
    reach AS (SELECT building_id AS node, building_id AS root FROM houses UNION SELECT met.b, reach.root FROM reach JOIN met ON met.a=reach.node AND met.a%7<>0 AND met.b%7<>0),
    parts AS (SELECT node AS building_id, min(root) AS component FROM reach GROUP BY node),
    masks AS (SELECT a AS building_id, bit_or(1 << edge) AS mask FROM met GROUP BY a)
    SELECT building_id, component, count(*) OVER (PARTITION BY component) AS size, coalesce(mask,0)::BIGINT AS mask,
        CASE WHEN building_id%7=0 THEN 'rowhouse_like' WHEN count(*) OVER (PARTITION BY component)>=3 THEN 'rowhouse' WHEN count(*) OVER (PARTITION BY component)=2 THEN 'twin' ELSE 'rowhouse_like' END AS kind
    FROM houses JOIN parts USING (building_id) LEFT JOIN masks USING (building_id)"""

QUERIES = {
    "height_evidence": (height_evidence, HEIGHT_EVIDENCE),
    "heights_applied": (heights_applied, HEIGHTS_APPLIED),
    "evidence_coverage": (evidence_coverage, EVIDENCE_COVERAGE),
    "mesh_coverage": (mesh_coverage, MESH_COVERAGE),
    "mesh_priority": (mesh_priority, MESH_PRIORITY),
    "building_context": (building_context, BUILDING_CONTEXT),
}
