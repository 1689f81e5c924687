"""Audits of manifests, inventories and artifacts: each a join or an aggregate over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import audits as A
from ..sources import layers as L


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, x, y, size, digest: lines of a tile inventory, some of them out of range or repeated."""
    k = F.col("o_orderkey")
    z = k % 10
    side = F.pow(F.lit(2.0), z).cast("long")
    return L.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        z.alias("z"), ((k * 7919 + F.col("o_custkey")) % (side + F.when(k % 97 == 0, 2).otherwise(0))).alias("x"), (k * 104729 % side).alias("y"),
        (k % 501 - 1).alias("size"), F.when(k % 89 == 0, "xyz").otherwise(F.sha2(k.cast("string"), 256)).alias("digest"), k.alias("line"),
    )


_INVENTORY = """inv AS (SELECT o_orderkey%10 AS z, (o_orderkey*7919+o_custkey)%((2**(o_orderkey%10))::BIGINT+CASE WHEN o_orderkey%97=0 THEN 2 ELSE 0 END) AS x, o_orderkey*104729%(2**(o_orderkey%10))::BIGINT AS y,
    o_orderkey%501-1 AS size, CASE WHEN o_orderkey%89=0 THEN 'xyz' ELSE sha256(o_orderkey::VARCHAR) END AS digest, o_orderkey AS line FROM orders)"""


def inventory_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of an inventory, counted: levels and places out of range, sizes, digests, repeated tiles."""
    found = A.inventory_faults(inventory(spark, sf_dir), 8)
    return found.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))


INVENTORY_FAULTS = f"""WITH {_INVENTORY}, f AS (SELECT 'level' AS fault, line FROM inv WHERE z NOT BETWEEN 0 AND 8 UNION ALL SELECT 'place', line FROM inv WHERE x<0 OR x>=2**z OR y<0 OR y>=2**z
    UNION ALL SELECT 'size', line FROM inv WHERE size<=0 UNION ALL SELECT 'digest', line FROM inv WHERE NOT regexp_full_match(digest, '[0-9a-f]{{64}}')
    UNION ALL SELECT 'repeated', line FROM (SELECT line, row_number() OVER (PARTITION BY z,x,y ORDER BY line) AS n FROM inv) WHERE n>1)
    SELECT fault, count(*) AS n, min(line) AS first FROM f GROUP BY fault"""


def rollup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored summary by tile level against its recomputation: rows, bytes, bounds; levels that differ are named."""
    inv = inventory(spark, sf_dir)
    now = A.summary(inv, ["z"], {"x": "x", "y": "y"}, "size")
    stored = now.withColumns({"n": F.col("n") + F.when(F.col("z") == 3, 1).otherwise(0), "max_x": F.col("max_x") - F.when(F.col("z") == 5, 1).otherwise(0)}).where("z <> 7")
    return A.summary_differs(stored, now, ["z"])


ROLLUP_CHECK = f"""WITH {_INVENTORY}, s AS (SELECT z, count(*) AS n, sum(size)::BIGINT AS total, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM inv GROUP BY z)
    SELECT z, CASE WHEN z=7 THEN 'not stored' ELSE 'differs' END AS state FROM s WHERE z IN (3,5,7)"""


def level_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box of all tiles of each level, their number and bytes, least and largest."""
    return A.summary(inventory(spark, sf_dir), ["z"], {"x": "x", "y": "y"}, "size")


LEVEL_BOUNDS = f"WITH {_INVENTORY} SELECT z, count(*) AS n, sum(size)::BIGINT AS total, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM inv GROUP BY z"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source file came to: file_id, selected, result, and the identities of inventory, code and footprints."""
    k = F.col("p_partkey")
    return L.table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        k.alias("file_id"), (k % 5 != 0).alias("selected"), F.when(k % 11 == 0, "rejected_source").when(k % 7 == 0, "outside").when(k % 13 == 0, None).otherwise("derived").alias("result"),
        F.when(k % 17 == 0, "old").otherwise("now").alias("identity"), (k % 4 + 1).alias("schema_version"), F.col("p_size").alias("rows"),
    )


_ARTIFACTS = """art AS (SELECT p_partkey AS file_id, p_partkey%5<>0 AS selected, CASE WHEN p_partkey%11=0 THEN 'rejected_source' WHEN p_partkey%7=0 THEN 'outside' WHEN p_partkey%13=0 THEN NULL ELSE 'derived' END AS result,
    CASE WHEN p_partkey%17=0 THEN 'old' ELSE 'now' END AS identity, p_partkey%4+1 AS schema_version, p_size AS "rows" FROM part),
    st AS (SELECT *, CASE WHEN NOT selected THEN 'unselected' WHEN result IS NULL THEN 'pending' WHEN identity<>'now' THEN 'stale' WHEN result='derived' AND schema_version<2 THEN 'invalid' ELSE result END AS state FROM art)"""


def artifact_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each file's artifact, counted: pending, stale (made from other inputs), invalid, derived, outside, rejected."""
    return A.artifact_states(artifacts(spark, sf_dir), "now", 2).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a merge may run: all selected files accounted for, gaps from rejected ones, partial or not."""
    return A.completeness(A.artifact_states(artifacts(spark, sf_dir), "now", 2))


def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections looked at again: those whose source now passes become pending, the others stay as they were, none is lost."""
    states = A.artifact_states(artifacts(spark, sf_dir), "now", 2)
    checks = L.table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 22 = 0").select(F.col("p_partkey").alias("file_id"), F.lit(True).alias("passes"))
    return A.recheck(states, checks).where("state <> recheck_state or state = 'rejected_source'").groupBy("state", "recheck_state").agg(F.count(F.lit(1)).alias("n"))


RECHECK = f"""WITH {_ARTIFACTS} SELECT state, CASE WHEN file_id%22=0 THEN 'pending' ELSE 'rejected_source' END AS recheck_state, count(*) AS n FROM st WHERE state='rejected_source' GROUP BY ALL"""


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows whose source address or size is not the inventory's, or that the inventory lacks."""
    k = F.col("c_custkey")
    listed = L.table(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 19 <> 0").select(k.alias("k"), F.concat(F.lit("src/"), k.cast("string")).alias("url"), (k * 3).alias("bytes"))
    said = L.table(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 3 = 0").select(k.alias("k"), F.concat(F.lit("src/"), (k + F.when(k % 23 == 0, 1).otherwise(0)).cast("string")).alias("said_url"), (k * 3 + F.when(k % 29 == 0, 1).otherwise(0)).alias("said_bytes"))
    return A.provenance(said, listed, "k", ["url", "bytes"])


PROVENANCE = """SELECT c_custkey AS k, CASE WHEN c_custkey%19=0 THEN 'not listed' WHEN c_custkey%23=0 THEN 'url' ELSE 'bytes' END AS fault FROM customer WHERE c_custkey%3=0 AND (c_custkey%19=0 OR c_custkey%23=0 OR c_custkey%29=0)"""


def gap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints touched by the gaps of each group: the number of different ones is at least the largest gap's and at most
    the sum of all."""
    touched = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").select((F.col("l_suppkey") % 5).alias("part"), F.col("l_suppkey").alias("gap_id"), F.col("l_partkey").alias("footprint"))
    return A.union_bounds(touched, ["part"], "gap_id", "footprint")


GAP_BOUNDS = """WITH g AS (SELECT l_suppkey%5 AS part, l_suppkey AS gap_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL), u AS (SELECT l_suppkey%5 AS part, count(DISTINCT l_partkey) AS n_different FROM lineitem GROUP BY ALL)
    SELECT part, any_value(n_different) AS n_different, max(n) AS largest, sum(n)::BIGINT AS total, any_value(n_different) BETWEEN max(n) AND sum(n) AS fits FROM g JOIN u USING (part) GROUP BY part"""


def scene_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose parts are not strictly ascending, and the version that their parts' digests give."""
    parts = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("name"))
    return A.scene_versions(parts, "scene", "place", "name").groupBy("ascending", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("first"))


SCENE_ORDER = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
    s AS (SELECT l_orderkey, coalesce(bool_and(b < l_partkey), true) AS ascending, count(*) = max(l_linenumber) AS whole, sha256(string_agg(l_linenumber||':'||l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS version FROM p GROUP BY l_orderkey)
    SELECT ascending, whole, count(*) AS n, min(version) AS first FROM s GROUP BY ALL"""


def dependent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to an inventory that artifacts depend on, which are refused; others are allowed."""
    k = F.col("s_suppkey")
    old = L.table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("k"), F.sha2(k.cast("string"), 256).alias("digest"))
    new = L.table(spark, sf_dir, "supplier", "s_suppkey").where("s_suppkey % 9 <> 0").select(k.alias("k"), F.sha2((k + F.when(k % 4 == 0, 1).otherwise(0)).cast("string"), 256).alias("digest"))
    used = L.table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber").where("l_linenumber = 7 and l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("k"))
    return A.refused_changes(old, new, used, "k", "digest")


DEPENDENT_CHANGES = """SELECT s_suppkey AS k, CASE WHEN s_suppkey%9=0 THEN 'removed' ELSE 'changed' END AS change, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber=7 AND l_suppkey%2=0) AS refused FROM supplier WHERE s_suppkey%9=0 OR s_suppkey%4=0"""


def conversion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster's class counts: each equal to a recount of its cells, and together the whole grid."""
    cells = L.cells(spark, sf_dir).select((F.floor("value") % 7).alias("cls"))
    stated = cells.groupBy("cls").agg(F.count(F.lit(1)).alias("stated")).withColumn("stated", F.col("stated") + F.when(F.col("cls") == 2, 1).otherwise(0))
    return A.class_audit(cells, stated, "cls")


CONVERSION_AUDIT = L.ctes("cells") + """, c AS (SELECT floor(value)::BIGINT%7 AS cls, count(*) AS n FROM cells GROUP BY 1)
    SELECT cls, n AS counted, n + CASE WHEN cls=2 THEN 1 ELSE 0 END AS stated, cls<>2 AS equal, false AS sums_to_grid FROM c"""


def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned tiles of each view that are there and that are missing, and all attributions of those there, sorted."""
    k = F.col("o_orderkey")
    plan = L.table(spark, sf_dir, "orders", "o_orderkey").select((k % 4).alias("view"), k.alias("tile"))
    images = L.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").where("l_linenumber = 2").select((F.col("l_orderkey") % 4).alias("view"), F.col("l_orderkey").alias("tile"), F.array((F.col("l_suppkey") % 9).cast("string"), (F.col("l_suppkey") % 4).cast("string")).alias("credits"))
    joined = plan.join(images, ["view", "tile"], "left").withColumn("there", F.col("credits").isNotNull())
    counts = joined.groupBy("view").agg(F.count_if("there").alias("present"), F.count_if(~F.col("there")).alias("missing"))
    credits = joined.where("there").select("view", F.explode("credits").alias("c")).distinct().groupBy("view").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("credits"))  # few names
    return counts.join(credits, "view", "left").select("view", "present", "missing", F.coalesce("credits", F.lit("")).alias("credits"))


VIEW_COUNTS = """WITH j AS (SELECT o_orderkey%4 AS view, l_suppkey FROM orders LEFT JOIN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber=2) ON l_orderkey=o_orderkey),
    c AS (SELECT DISTINCT view, unnest([(l_suppkey%9)::VARCHAR, (l_suppkey%4)::VARCHAR]) AS c FROM j WHERE l_suppkey IS NOT NULL)
    SELECT view, count(l_suppkey) AS present, count(*)-count(l_suppkey) AS missing, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM c WHERE c.view=j.view), '') AS credits FROM j GROUP BY view"""


def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups have how many members, with those of one member named apart."""
    sizes = L.table(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.min("l_orderkey").alias("first"), (F.col("size") == 1).alias("single"))


def tile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tiles whose bytes changed between two builds, and whether the new build's coverage fell more than allowed."""
    old, new = inventory(spark, sf_dir).where("line % 6 <> 0"), inventory(spark, sf_dir).where("line % 7 <> 0")
    a = old.groupBy("z", "x", "y").agg(F.max("digest").alias("old"))
    b = new.groupBy("z", "x", "y").agg(F.min("digest").alias("new"))
    both = a.join(b, ["z", "x", "y"], "full")
    counts = both.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("changed"))
    percent = F.round(100.0 * (F.col("added") + F.col("removed") + F.col("changed")) / F.col("tiles"), 2)
    return counts.select("*", percent.alias("percent"), (F.col("removed") * 10 <= F.col("tiles")).alias("passes"))


TILE_DIFF = f"""WITH {_INVENTORY}, a AS (SELECT z,x,y,max(digest) AS o FROM inv WHERE line%6<>0 GROUP BY ALL), b AS (SELECT z,x,y,min(digest) AS n FROM inv WHERE line%7<>0 GROUP BY ALL),
    c AS (SELECT z, count(*) AS tiles, count(*) FILTER (o IS NULL) AS added, count(*) FILTER (n IS NULL) AS removed, count(*) FILTER (o<>n) AS changed FROM a FULL JOIN b USING (z,x,y) GROUP BY z)
    SELECT *, round(100.0*(added+removed+changed)/tiles, 2)::DOUBLE AS percent, removed*10<=tiles AS passes FROM c"""


def picture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each picture: share of equal neighbours to the right, of strong edges, and the largest seam beside the 95th
    percentile (by floor index) of all steps between neighbours."""
    pixels = L.cells(spark, sf_dir).groupBy("row", "col").agg(F.max("value").alias("value")).withColumn("tile", F.floor(F.col("row") / 16))
    right = F.lead("value").over(W.partitionBy("tile", "row").orderBy("col"))
    steps = pixels.withColumns({"next": right, "seam": F.col("col") % 16 == 15}).where("next is not null").withColumn("step", F.abs(F.col("next") - F.col("value")))
    return A.seam_quality(steps, ["tile"], "step", "seam", 25.0)


PICTURE_QUALITY = L.ctes("cells") + """, p AS (SELECT "row", col, max(value) AS v, "row"//16 AS tile FROM cells GROUP BY ALL), n AS (SELECT tile, col, v, lead(v) OVER (PARTITION BY tile, "row" ORDER BY col) AS nx FROM p),
    s AS (SELECT tile, col%16=15 AS seam, abs(nx-v) AS step FROM n WHERE nx IS NOT NULL),
    r AS (SELECT tile, step, row_number() OVER (PARTITION BY tile ORDER BY step) AS i, count(*) OVER (PARTITION BY tile) AS n FROM s)
    SELECT tile, round(100.0*count(*) FILTER (step=0)/count(*),4)::DOUBLE AS equal_percent, round(100.0*count(*) FILTER (step>=25)/count(*),4)::DOUBLE AS edge_percent,
        round(max(step) FILTER (seam)/nullif((SELECT min(step) FROM r WHERE r.tile=s.tile AND r.i=floor((r.n-1)*0.95)+1),0),4) AS seam_ratio FROM s GROUP BY tile"""


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each plan holds exactly the expected tiles: citywide, else a pilot; with the tiles that both have."""
    k = F.col("o_orderkey")
    plan = L.table(spark, sf_dir, "orders", "o_orderkey").select((k % 3).alias("plan"), F.floor(k / 3).alias("tile")).where("plan <> 1 or tile % 10 <> 0")
    expected = L.table(spark, sf_dir, "orders", "o_orderkey").select((k % 3).alias("plan"), F.floor(k / 3).alias("tile")).where("plan <> 2 or tile % 50 <> 0")
    return A.set_scope(plan, expected, ["plan"], "tile")


SCOPE = """WITH a AS (SELECT DISTINCT o_orderkey%3 AS plan, o_orderkey//3 AS tile FROM orders WHERE o_orderkey%3<>1 OR o_orderkey//3%10<>0), b AS (SELECT DISTINCT o_orderkey%3 AS plan, o_orderkey//3 AS tile FROM orders WHERE o_orderkey%3<>2 OR o_orderkey//3%50<>0)
    SELECT plan, count(a.tile) AS planned, count(b.tile) AS expected, count(*) FILTER (a.tile IS NOT NULL AND b.tile IS NOT NULL) AS shared, CASE WHEN count(*) FILTER (a.tile IS NULL OR b.tile IS NULL)=0 THEN 'citywide' ELSE 'pilot' END AS scope
    FROM (SELECT plan, tile, tile AS t FROM a) a FULL JOIN b USING (plan, tile) GROUP BY plan"""


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of a set of inputs from their names, sizes and digests, and whether a cached build may be used again."""
    k = F.col("s_suppkey")
    inputs = L.table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select((k % 7).alias("build"), F.col("s_name").alias("name"), F.sha2(k.cast("string"), 256).alias("digest"))
    cached = A.input_versions(inputs.where("name not like '%5'"), "build", "name", "digest").withColumnRenamed("version", "cached")
    return A.input_versions(inputs, "build", "name", "digest").join(cached, "build", "left").select("build", "version", F.coalesce(F.col("version") == F.col("cached"), F.lit(False)).alias("reuse"))


IDENTITY = """WITH i AS (SELECT s_suppkey%7 AS build, s_name AS name, sha256(s_suppkey::VARCHAR) AS d FROM supplier), v AS (SELECT build, sha256(string_agg(name||'='||d, ';' ORDER BY name)) AS version, bool_or(name LIKE '%5') AS other FROM i GROUP BY build)
    SELECT build, version, NOT other AS reuse FROM v"""


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of each area with their aliases spelt out, each once, in the order in which they are met."""
    k = F.col("n_nationkey")
    areas = L.table(spark, sf_dir, "nation", "n_nationkey").select(k.alias("area"), F.array(*[F.concat(F.lit("G"), ((k + j) % 5).cast("string")) for j in (0, 1, 3)]).alias("named"))
    aliases = F.create_map(F.lit("G1"), F.array(F.lit("G2"), F.lit("G7")), F.lit("G4"), F.array(F.lit("G8")))
    flat = F.flatten(F.transform("named", lambda x: F.coalesce(F.try_element_at(aliases, x), F.array(x))))
    return areas.select("area", F.array_join(F.array_distinct(flat), ",").alias("parents"))


PARENTS = """WITH a AS (SELECT n_nationkey AS area, unnest([0,1,3]) AS j, n_nationkey FROM nation), b AS (SELECT area, j, 'G'||((n_nationkey+j)%5) AS g FROM a),
    c AS (SELECT area, j, 0 AS i, CASE g WHEN 'G1' THEN 'G2' WHEN 'G4' THEN 'G8' ELSE g END AS p FROM b UNION ALL SELECT area, j, 1, 'G7' FROM b WHERE g='G1'),
    d AS (SELECT area, p, min(j*2+i) AS o FROM c GROUP BY ALL) SELECT area, string_agg(p, ',' ORDER BY o) AS parents FROM d GROUP BY area"""


def newest_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest valid copy of each source whose name begins with its digest, and the least snapshot by name."""
    k = F.col("event_id")
    files = L.table(spark, sf_dir, "events", "event_id", "user_id", "ts").select((F.col("user_id") % 50).alias("source"), "ts", k.alias("id"), F.sha2(k.cast("string"), 256).alias("digest"), F.concat(F.substring(F.sha2((k + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"), 256), 1, 12), F.lit(".json")).alias("name"))
    return A.newest_valid(files, "source", "ts", "id", "name", "digest")


NEWEST_CACHED = """WITH f AS (SELECT user_id%50 AS source, ts, event_id AS id, sha256(event_id::VARCHAR) AS d, sha256((event_id+CASE WHEN event_id%3=0 THEN 1 ELSE 0 END)::VARCHAR)[1:12]||'.json' AS name FROM events)
    SELECT source, count(*) AS files, arg_max(id, (ts, id)) FILTER (d[1:12]=name[1:12]) AS newest, min(name) AS snapshot FROM f GROUP BY source"""


def terrain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells (64 units) that overlap a rejected rectangle; cells that only touch it do not count."""
    k = F.col("s_suppkey")
    gaps = L.table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("gap_id"), *[e.cast("double").alias(c) for c, e in (("gx0", k * 37 % 100 * 32), ("gy0", k % 7 * 32), ("gx1", k * 37 % 100 * 32 + 96), ("gy1", k % 7 * 32 + 64))])
    met = A.strict_cells(gaps, "gap_id", ("gx0", "gy0", "gx1", "gy1"), 64.0)
    return met.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("gaps"))


TERRAIN_GAPS = """WITH g AS (SELECT s_suppkey AS k, s_suppkey*37%100*32 AS x0, s_suppkey%7*32 AS y0, s_suppkey*37%100*32+96 AS x1, s_suppkey%7*32+64 AS y1 FROM supplier),
    c AS (SELECT k, unnest(range(x0//64, (x1+63)//64)) AS cx, y0, y1 FROM g), d AS (SELECT k, cx, unnest(range(y0//64, (y1+63)//64)) AS cy FROM c) SELECT cx, cy, count(*) AS gaps FROM d GROUP BY ALL"""


def mask_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of the mask's cell under each point; the outer edge belongs to the last row and column, points beyond have none."""
    mask = L.cells(spark, sf_dir).groupBy("row", "col").agg((F.floor(F.max("value")) % 5).alias("cls"))
    k = F.col("c_custkey")
    points = L.table(spark, sf_dir, "customer", "c_custkey").select(k.alias("id"), (k * 13 % 200 * 1.0 - 3).alias("x"), (F.lit(400.0) - k * 7 % 430).alias("y"))
    return A.sample_mask(points, mask, 0.0, 192.0, 0.0, 396.0, 3.0)


MASK_SAMPLES = L.ctes("cells") + """, m AS (SELECT "row", col, floor(max(value))::BIGINT%5 AS cls FROM cells GROUP BY ALL), p AS (SELECT c_custkey AS id, c_custkey*13%200*1.0::DOUBLE-3 AS x, 400.0::DOUBLE-c_custkey*7%430 AS y FROM customer),
    q AS (SELECT id, CASE WHEN x BETWEEN 0 AND 192 AND y BETWEEN 0 AND 396 THEN least(floor(x/3), 63)::BIGINT END AS col, CASE WHEN x BETWEEN 0 AND 192 AND y BETWEEN 0 AND 396 THEN least(floor((396-y)/3), 131)::BIGINT END AS "row" FROM p)
    SELECT id, nullif(cls, 0) AS cls FROM q LEFT JOIN m USING ("row", col)"""

QUERIES = {
    "inventory_faults": (inventory_faults, INVENTORY_FAULTS),
    "rollup_check": (rollup_check, ROLLUP_CHECK),
    "level_bounds": (level_bounds, LEVEL_BOUNDS),
    "artifact_states": (artifact_states, f'WITH {_ARTIFACTS} SELECT state, count(*) AS n, sum("rows")::BIGINT AS "rows" FROM st GROUP BY state'),
    "completeness": (completeness, f"""WITH {_ARTIFACTS} SELECT count(*) FILTER (selected) AS selected, count(*) FILTER (state IN ('derived','outside','rejected_source')) AS accounted, count(*) FILTER (state='derived') AS evidence,
        count(*) FILTER (state='rejected_source') AS rejected, bool_or(state IN ('pending','stale','invalid')) AS partial, NOT bool_or(state IN ('pending','stale','invalid','rejected_source')) AS complete FROM st"""),
    "recheck": (recheck, RECHECK),
    "provenance": (provenance, PROVENANCE),
    "gap_bounds": (gap_bounds, GAP_BOUNDS),
    "scene_order": (scene_order, SCENE_ORDER),
    "dependent_changes": (dependent_changes, DEPENDENT_CHANGES),
    "conversion_audit": (conversion_audit, CONVERSION_AUDIT),
    "view_counts": (view_counts, VIEW_COUNTS),
    "group_sizes": (group_sizes, "SELECT size, count(*) AS groups, min(k) AS first, size=1 AS single FROM (SELECT l_orderkey AS k, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY size"),
    "tile_diff": (tile_diff, TILE_DIFF),
    "picture_quality": (picture_quality, PICTURE_QUALITY),
    "scope": (scope, SCOPE),
    "identity": (identity, IDENTITY),
    "parents": (parents, PARENTS),
    "newest_cached": (newest_cached, NEWEST_CACHED),
    "terrain_gaps": (terrain_gaps, TERRAIN_GAPS),
    "mask_samples": (mask_samples, MASK_SAMPLES),
}
