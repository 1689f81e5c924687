"""What must not grow faster than the input: copies of figures, expressions used in themselves, tables broadcast by an estimate."""

import hashlib
import json

from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.operators import contracts as K
from gridloom.operators import polygons as P
from gridloom.operators import spatial as S
from gridloom.operators import views as V
from gridloom.operators import windows as O
from gridloom.plans import registry
from gridloom.sources import rasters


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixed_levels_of_a_digest(spark):
    rows = spark.range(1_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    level = [(k, hashlib.sha256(json.dumps({"k": k, "v": k % 7}, separators=(",", ":")).encode()).hexdigest()) for k in range(1_000)]
    for _ in range(2):
        runs = {}
        for k, d in level:
            runs.setdefault(k // 4, []).append(d)
        level = [(k, hashlib.sha256("".join(d).encode()).hexdigest()) for k, d in sorted(runs.items())]
    assert len(level) > 4
    want = hashlib.sha256("".join(d for _, d in level).encode()).hexdigest()
    assert tuple(K.table_digest(rows, "k", ["v"], span=4, levels=2).first()) == (want, 1_000)


def test_nested_steps_on_rings_hold_each_ring_once(spark):
    row = spark.range(1).select((F.col("id") + 0.0).alias("a"))
    ring = g.box_ring(F.col("a"), F.col("a"), F.col("a") + 9, F.col("a") + 9)
    clipped = g.ring_area(g.clip_to_box(ring, F.lit(2.0), F.lit(-1.0), F.lit(6.0), F.lit(5.0)))
    texts = g.ring_area(V.text_polygon(V.polygon_text(ring)))
    away = g.rings_d2(ring, g.box_ring(F.lit(12), F.lit(0), F.lit(14), F.lit(4)))
    for column, value, most in ((clipped, 20.0, 60_000), (texts, 81.0, 30_000), (away, 9.0, 60_000)):
        df = row.select(column.alias("v"))
        assert df.first()["v"] == value
        assert len(df._jdf.queryExecution().analyzed().toString()) < most


def test_equal_figures_are_met_once(spark):
    df = spark.range(1_000).select(F.col("id").alias("k"), (F.col("id") % 3 * 10.0).alias("x"))
    one, members = S.shapes(df, "k", ["x"])
    assert sorted(map(tuple, one.select("shape", "x").collect())) == [(0, 0.0), (1, 10.0), (2, 20.0)]
    assert members.where("shape = k % 3").count() == members.count() == 1_000


def test_tones_of_copies_and_of_edges(spark):
    """Six million pairs of copies are one; a point on a ring's edge is not inside."""
    points = spark.range(2_000).select(F.col("id"), F.when(F.col("id") == 0, 0.0).otherwise(5.0).alias("x"), F.lit(5.0).alias("y"))
    ring = g.box_ring(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    water = spark.range(3_000).select(ring.alias("zone"), *[F.lit(v).alias(c) for c, v in (("zmin_x", 0.0), ("zmin_y", 0.0), ("zmax_x", 10.0), ("zmax_y", 10.0))])
    tones = V.water_tones(points, water, 1.0, lambda x, y: F.lit(True))
    assert {(r["tone"], r["count"]) for r in tones.groupBy("tone").count().collect()} == {("open", 1_999), ("shoreline", 1)}
    assert V.water_tones(points, water, 1.0, lambda x, y: F.lit(False)).count() == 1_999


def test_the_two_nearest_decide(spark):
    rows = spark.range(600).select((F.col("id") % 5).alias("k"), (F.col("id") * 7 % 11).alias("c"), (F.col("id") * 13 % 17 * 0.25).alias("d"))
    two = O.nearest_two(rows, ["k"], "c", "d")
    assert two.groupBy("k").count().agg(F.max("count")).first()[0] == 2
    won = lambda df: sorted(map(tuple, O.clear_winner(df, ["k"], "c", "d", 0.5).collect()), key=repr)
    assert won(two) == won(rows)


def test_edges_are_joined_by_shuffle(spark):
    figure = spark.range(1).select(F.col("id").alias("k"), F.array(g.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(4))).alias("rings"))
    edges = P.edges_of(figure, ["k"]).withColumn("n", F.lit(1))
    assert "Broadcast" not in _plan(P.crossings(edges, ["k"]))
    assert "Broadcast" not in _plan(P.windings(edges, ["k"], ["n"]))


def test_dense_joins_are_dealt_by_shuffle(spark, sf):
    for name in ("nearby_streets", "area_overlaps"):
        assert "Broadcast" not in _plan(registry.QUERIES[name](spark, sf)), name


def test_a_dense_block_of_a_raster_costs_what_its_cells_do(spark):
    """65,536 cells in one block: an array made again for each cell would be four billion steps."""
    grid = rasters.Grid(width=1_024, height=64)
    cells = spark.range(1_024 * 64).select(F.floor(F.col("id") / 1_024).alias("row"), (F.col("id") % 1_024).alias("col"), (F.col("id") % 15 + 1).alias("value"))
    packed = rasters.pack(cells, grid)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "get(concat(array(-1)" not in plan
    assert rasters.unpack(packed, grid).exceptAll(cells).count() == 0 and packed.count() == 1
