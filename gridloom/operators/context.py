"""Building context from rings at any angle: party edges, runs of row houses, families, kinds and seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from .graph import checkpoint, connected_components
from .spatial import bucket_join

# Limits of the footprint profile in metres and square metres, and of party edges.
ROW_AREA, ROW_WIDTH, ROW_DEPTH, ROW_HEIGHT = (29.728973, 220.1802), (3.048, 9.144), (7.9248, 32.004), (5.5, 16.0)
FAMILY_AREA, FAMILY_WIDTH, FAMILY_DEPTH, FAMILY_HEIGHT = (20.43867, 315.87033), (2.4384, 10.3632), (5.4864, 36.576), (4.5, 20.0)
WAREHOUSE_AREA, WAREHOUSE_HEIGHT, DETACHED_HEIGHT = 449.6507, 20.0, 18.0
EDGE_GAP, LEAST_OVERLAP, OVERLAP_SHARE, PARALLEL = 0.82296, 2.4384, 0.6, 0.9848077
SEED_BUILDING, SEED_GROUP, GOLDEN = 0x510E527FADE682D1, 0x6A09E667F3BCC909, 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def profile(buildings: DataFrame, ring: str = "ring", height: str = "height") -> DataFrame:
    """Adds area, depth (the longest edge), row and family: whether shape and height fit a row house, or its wider family."""
    lengths = F.transform(g.ring_edges(F.col(ring)), lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)))
    sized = buildings.withColumns({"area": g.ring_area(F.col(ring)), "depth": F.coalesce(F.array_max(lengths), F.lit(0.0))})
    width = F.when(F.col("depth") > 0, F.col("area") / F.col("depth")).otherwise(F.lit(0.0))
    fits = lambda area, wide, deep, high: F.col("area").between(*area) & width.between(*wide) & F.col("depth").between(*deep) & F.col(height).between(*high)
    return sized.withColumns({"row": fits(ROW_AREA, ROW_WIDTH, ROW_DEPTH, ROW_HEIGHT), "family": fits(FAMILY_AREA, FAMILY_WIDTH, FAMILY_DEPTH, FAMILY_HEIGHT)})


def _measured(ring: str) -> Column:
    """Edges with their direction and length: a, b, ux, uy, size."""
    size = lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2))
    sized = F.transform(g.ring_edges(F.col(ring)), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), size(e).alias("size")))
    return F.transform(sized, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), ((e["b"]["x"] - e["a"]["x"]) / e["size"]).alias("ux"), ((e["b"]["y"] - e["a"]["y"]) / e["size"]).alias("uy"), e["size"].alias("size")))


def _overlap(e: Column, f: Column) -> Column:
    """Length that edge f shares with the parallel edge e beside it; null if it is not parallel, or too far."""
    away = lambda p: F.abs((p["y"] - e["a"]["y"]) * e["ux"] - (p["x"] - e["a"]["x"]) * e["uy"])
    along = lambda p: (p["x"] - e["a"]["x"]) * e["ux"] + (p["y"] - e["a"]["y"]) * e["uy"]
    shared = F.least(e["size"], F.greatest(along(f["a"]), along(f["b"]))) - F.greatest(F.lit(0.0), F.least(along(f["a"]), along(f["b"])))
    return F.when((F.abs(e["ux"] * f["ux"] + e["uy"] * f["uy"]) >= PARALLEL) & (away(f["a"]) <= EDGE_GAP) & (away(f["b"]) <= EDGE_GAP), shared)


def party_edges(profiled: DataFrame, key: str, cell: float, ring: str = "ring", height: str = "height") -> DataFrame:
    """Pairs of facing edges of two buildings: a < b, edge_a, edge_b, and whether they join a row or a family. Boxes and edges
    are written before the join, so that their expressions are not planned again in each of its conditions."""
    box = ("min_x", "min_y", "max_x", "max_y")
    side = checkpoint(profiled.withColumns({**g.ring_box(F.col(ring)), "edges": _measured(ring)}).select(key, *box, "edges", "depth", "row", "family", F.col(height).alias("h")))
    right = side.select(*[F.col(c).alias(f"o_{c}") for c in side.columns])
    met = bucket_join(side, right, box, tuple(f"o_{c}" for c in box), cell, EDGE_GAP, F.col(key) < F.col(f"o_{key}"))
    left_edges = met.select("*", F.posexplode("edges").alias("edge_a", "ea"))
    pairs = left_edges.select("*", F.posexplode("o_edges").alias("edge_b", "eb")).withColumn("shared", _overlap(F.col("ea"), F.col("eb")))
    pairs = pairs.where((F.col("shared") > 0) & (F.col("shared") >= LEAST_OVERLAP) & (F.col("shared") >= OVERLAP_SHARE * F.least("ea.size", "eb.size")))
    alike = (F.abs(F.col("h") - F.col("o_h")) <= 4.5) | (F.least("h", "o_h") >= 0.7 * F.greatest("h", "o_h"))
    family = F.col("family") & F.col("o_family") & (F.col("ea.size") >= 0.6 * F.col("depth")) & (F.col("eb.size") >= 0.6 * F.col("o_depth")) & alike
    return pairs.select(F.col(key).alias("a"), F.col(f"o_{key}").alias("b"), "edge_a", "edge_b", family.alias("joins_family"), (family & F.col("row") & F.col("o_row")).alias("joins_row"))


def _mixed(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = seed ^ (value + np.uint64(GOLDEN))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
        x ^= x >> np.uint64(27)
        return (x * np.uint64(MIX_2)) ^ (x >> np.uint64(31))


@F.pandas_udf(T.LongType())
def seed_of(values: pd.Series) -> pd.Series:
    """A building's seed from its quantised centre, area and height: four whole numbers, mixed in that order."""
    table = np.stack(values.to_list()).astype(np.int64).view(np.uint64)
    seed = np.full(len(table), SEED_BUILDING, dtype=np.uint64)
    for k in range(table.shape[1]):
        seed = _mixed(seed, table[:, k])
    return pd.Series(seed.view(np.int64))


@F.pandas_udf(T.LongType())
def group_seed(seeds: pd.Series) -> pd.Series:
    """One seed of a run of houses, whatever their order."""
    out = []
    for row in seeds:
        seed = np.array([SEED_GROUP], dtype=np.uint64)
        for value in np.sort(np.asarray(row, dtype=np.int64).view(np.uint64)):
            seed = _mixed(seed, np.array([value], dtype=np.uint64))
        out.append(int(seed.view(np.int64)[0]))
    return pd.Series(out, dtype="int64")


def building_seeds(profiled: DataFrame, ring: str = "ring", height: str = "height") -> Column:
    box = g.ring_box(F.col(ring))
    whole = lambda x: F.round(x * 4).cast("long")
    return seed_of(F.array(whole((box["min_x"] + box["max_x"]) / 2), whole((box["min_y"] + box["max_y"]) / 2), whole(F.col("area")), whole(F.col(height))))


def contexts(buildings: DataFrame, key: str, cell: float, ring: str = "ring", height: str = "height") -> DataFrame:
    """key, component and family (smallest key of the run and of the family), size, family_size, mask (a bit for each
    party edge), kind (rowhouse, twin, rowhouse_like, warehouse, detached, generic, in this order) and seed (of the run, else
    of the family, else the building's own). A run is a row of houses on the ground, so its seeds fit one row."""
    sized = checkpoint(profile(buildings, ring, height))
    pairs = checkpoint(party_edges(sized, key, cell, ring, height))  # read four times below
    bit = lambda e: F.expr(f"shiftleft(1L, {e})")
    both = pairs.select(F.col("a").alias(key), bit("edge_a").alias("m")).union(pairs.select("b", bit("edge_b")))
    masks = both.groupBy(key).agg(F.bit_or("m").alias("mask"))
    seeds = checkpoint(sized.select(key, "area", "row", "family", F.col(height).alias("h"), building_seeds(sized, ring, height).alias("own")))
    out = seeds.withColumnRenamed("family", "is_family")
    for name, joins in (("component", "joins_row"), ("family", "joins_family")):
        parts = connected_components(seeds, pairs.where(joins).select("a", "b").distinct(), key).withColumnRenamed("component", name)
        sizes = parts.join(seeds.select(key, "own"), key).groupBy(name).agg(F.count(F.lit(1)).alias(f"{name}_size"), F.collect_list("own").alias("__s"))
        sizes = sizes.select(name, f"{name}_size", F.when(F.col(f"{name}_size") >= 2, group_seed("__s")).alias(f"{name}_seed"))
        out = out.join(parts, key).join(sizes, name)
    out = out.join(masks, key, "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    kind = (
        F.when(F.col("row") & (F.col("component_size") >= 3), "rowhouse").when(F.col("row") & (F.col("component_size") == 2), "twin")
        .when(F.col("row") | F.col("is_family"), "rowhouse_like").when((F.col("area") >= WAREHOUSE_AREA) & (F.col("h") <= WAREHOUSE_HEIGHT), "warehouse")
        .when((F.col("mask") == 0) & (F.col("area") <= WAREHOUSE_AREA) & (F.col("h") < DETACHED_HEIGHT), "detached").otherwise("generic")
    )
    seed = F.when(F.col("component_size") >= 2, F.col("component_seed")).when(F.col("is_family") & (F.col("family_size") >= 2), F.col("family_seed")).otherwise(F.col("own"))
    return out.select(key, "component", "family", F.col("component_size").alias("size"), "family_size", "mask", kind.alias("kind"), seed.alias("seed"))
