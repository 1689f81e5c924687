"""Tile pyramids: tiles of a box, roll-up by quadrants, incremental roll-up of dirty parents, ancestors, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint
from .spatial import Box


def tiles_of(df: DataFrame, box: Box, size: float, pad: float = 0.0) -> DataFrame:
    """Rows repeated for each tile (tx, ty) that their box, widened by ``pad``, touches."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - pad) / size), F.floor((F.col(hi) + pad) / size)))
    return df.withColumn("tx", span(box[0], box[2])).withColumn("ty", span(box[1], box[3]))


def parents(tiles: DataFrame) -> DataFrame:
    """Distinct parents (z, x, y) of tiles."""
    return tiles.select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).distinct()


def roll_up(tiles: DataFrame, fill: int = 0, value: str = "value") -> DataFrame:
    """The level above: whole-number mean of four quadrants, absent ones counted as ``fill``."""
    up = tiles.select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), value)
    return up.groupBy("z", "x", "y").agg(F.floor((F.sum(value) + (4 - F.count(F.lit(1))) * fill) / 4).cast("long").alias(value))


def roll_up_pixels(pixels: DataFrame, side: int, fill: dict[str, int]) -> DataFrame:
    """The level above, as pixels (z, x, y, px, py and the channels that ``fill`` names): four tiles side by side are halved with a
    triangle filter, whose weights are 1, 3, 3, 1 along either axis and less at the picture's border. Absent quadrants count as
    ``fill``; a parent with no child is absent."""
    channels = list(fill)
    placed = pixels.select(
        (F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"),
        ((F.col("x") % 2) * side + F.col("px")).alias("gx"), ((F.col("y") % 2) * side + F.col("py")).alias("gy"), *channels,
    )

    def reached(g: str) -> Column:
        own, other = F.floor(F.col(g) / 2), F.floor(F.col(g) / 2) + F.when(F.col(g) % 2 == 1, 1).otherwise(-1)
        return F.array(F.struct(own.alias("at"), F.lit(3).alias("w")), F.struct(other.alias("at"), F.lit(1).alias("w")))

    dealt = placed.withColumn("a", F.explode(reached("gx"))).where(F.col("a.at").between(0, side - 1)).withColumn("b", F.explode(reached("gy"))).where(F.col("b.at").between(0, side - 1))
    weight = F.col("a.w") * F.col("b.w")
    summed = dealt.groupBy("z", "x", "y", F.col("a.at").alias("px"), F.col("b.at").alias("py")).agg(F.sum(weight).alias("w"), *[F.sum(weight * F.col(c)).alias(c) for c in channels])
    every = placed.select("z", "x", "y").distinct().withColumn("px", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long")))).withColumn("py", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))))
    edge = lambda p: F.when(F.col(p).isin(0, side - 1), 7).otherwise(8)
    whole = edge("px") * edge("py")
    joined = every.join(summed, ["z", "x", "y", "px", "py"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    return joined.select("z", "x", "y", "px", "py", *[F.round((F.coalesce(F.col(c), F.lit(0)) + (whole - F.col("w")) * fill[c]) / whole).cast("int").alias(c) for c in channels])


def pyramid(leaves: DataFrame, to_level: int = 0, from_level: int = 8) -> DataFrame:
    """All levels. Each is at most a quarter of the one below, so the loop is bounded by the depth, not by the data."""
    level, out = leaves, leaves
    for _ in range(from_level - to_level):
        level = roll_up(level)
        out = out.unionByName(level)
    return out


def roll_up_dirty(stored: DataFrame, changed: DataFrame, from_level: int = 8, to_level: int = 0, value: str = "value") -> DataFrame:
    """Stored pyramid, a written table, with changed leaves (z, x, y, value; null: gone) and only their ancestors computed
    anew. Each level is written before the next is made from it."""
    keys = ["z", "x", "y"]
    whole = stored.select(*keys, value)
    changed = checkpoint(changed.select(*keys, value))
    level = checkpoint(whole.where(F.col("z") == from_level).join(changed.select(*keys), keys, "left_anti").unionByName(changed.where(F.col(value).isNotNull())))
    out, dirty = level, changed.select(*keys).distinct()
    for z in range(from_level, to_level, -1):
        dirty = parents(dirty)
        stale = level.withColumns({"__x": F.shiftright("x", 1), "__y": F.shiftright("y", 1)})
        touched = stale.join(dirty.select(F.col("x").alias("__x"), F.col("y").alias("__y")), ["__x", "__y"], "left_semi").select(*keys, value)
        fresh = roll_up(touched, value=value)
        kept = whole.where(F.col("z") == z - 1).join(dirty, keys, "left_anti")
        level = checkpoint(kept.unionByName(fresh))
        out = out.unionByName(level)
    return out


def nearest_ancestor(wanted: DataFrame, available: DataFrame, levels: int = 8) -> DataFrame:
    """For each wanted tile the deepest available tile that is itself or an ancestor: z, x, y, from_z (null if none)."""
    up = wanted.withColumn("__k", F.explode(F.sequence(F.lit(0), F.least(F.lit(levels), F.col("z").cast("int")))))
    shifted = up.select("z", "x", "y", (F.col("z") - F.col("__k")).alias("__z"), (F.expr("shiftright(x, __k)")).alias("__x"), F.expr("shiftright(y, __k)").alias("__y"))
    there = available.select(F.col("z").alias("__z"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.lit(1).alias("__there")).distinct()
    return shifted.join(there, ["__z", "__x", "__y"], "left").groupBy("z", "x", "y").agg(F.max(F.when(F.col("__there") == 1, F.col("__z"))).alias("from_z"))


def blocks(tiles: DataFrame, size: int = 4) -> DataFrame:
    """Tiles gathered in square blocks: bx, by, tiles (sorted places; at most size * size of them)."""
    return tiles.groupBy(F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by")).agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("tiles"))


def span_grid(low: Column, high: Column, step: float) -> Column:
    """Regular cells from low to high as (start, end) structs, the last one clipped."""
    n = F.ceil((high - low) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((low + k * step).alias("start"), F.least(low + (k + 1) * step, high).alias("end")))
