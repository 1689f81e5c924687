"""Grids as long tables (row, col, ...): binning, interpolation, focal operators, sampling.

Neighbourhoods are read by exploding each cell to the places that need it and grouping there: one shuffle per pass, and
at most nine copies of a cell, whatever the grid's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def cell_medians(samples: DataFrame, value: str = "value", least: int = 3) -> DataFrame:
    """row, col, value: the exact median of cells with enough samples."""
    return samples.groupBy("row", "col").agg(F.median(value).alias(value), F.count(value).alias("__n")).where(F.col("__n") >= least).drop("__n")


def spread(cells: DataFrame, value: str, offsets: list[tuple[int, int]] = OFFSETS) -> DataFrame:
    """Every cell's value at each of its neighbours' places: row, col, dr, dc, value."""
    around = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in offsets])
    each = cells.select("row", "col", value, F.explode(around).alias("o"))
    return each.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), value)


def focal(cells: DataFrame, value: str, how: Column, name: str) -> DataFrame:
    """``how`` over the 3 x 3 neighbourhood of every cell there is, from the values before the pass."""
    own = F.max((F.col("dr") == 0) & (F.col("dc") == 0))
    return spread(cells, value).groupBy("row", "col").agg(how.alias(name), own.alias("__own")).where("__own").drop("__own")


def box_average(cells: DataFrame, value: str = "value") -> DataFrame:
    """Whole-number average of nine cells; null if one is missing."""
    whole = F.when(F.count(value) == 9, F.floor(F.sum(value) / 9))
    return focal(cells, value, whole, "average")


def erosion_clearance(cells: DataFrame, steps: int = 3) -> DataFrame:
    """row, col, clearance: how many times the area can be eroded by its 8-neighbourhood and still hold the cell, up to
    ``steps``. A place beyond the area counts as outside."""
    now = cells.select("row", "col").distinct()
    out = now.withColumn("clearance", F.lit(0))
    for _ in range(steps):
        full = F.count(F.lit(1)) == 9
        now = focal(now.withColumn("__one", F.lit(1)), "__one", full, "__full").where("__full").select("row", "col")
        out = out.unionByName(now.withColumn("clearance", F.lit(1)))
    return out.groupBy("row", "col").agg(F.sum("clearance").alias("clearance"))


def inverse_distance(neighbours: DataFrame, keys: list[str], value: str, d2: str = "d2") -> DataFrame:
    """Mean weighted by 1 / d2; where a neighbour lies exactly here, its value (the first in ``place``)."""
    hit = F.min_by(value, F.when(F.col(d2) == 0, F.col("place")))
    safe = F.nullif(F.col(d2), F.lit(0.0))
    return neighbours.groupBy(*keys).agg(F.coalesce(hit, F.sum(F.col(value) / safe) / F.sum(1 / safe)).alias(value))


def bilinear(samples: DataFrame, cells: DataFrame, value: str, keys: list[str], row: str = "sr", col: str = "sc") -> DataFrame:
    """Value at fractional (row, col) from four corners; null unless all four are there."""
    r, c = F.floor(row), F.floor(col)
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    asked = samples.withColumn("__o", F.explode(corners)).withColumns({"row": r + F.col("__o.i"), "col": c + F.col("__o.j")})
    fr, fc = F.col(row) - r, F.col(col) - c
    weight = F.when(F.col("__o.i") == 1, fr).otherwise(1 - fr) * F.when(F.col("__o.j") == 1, fc).otherwise(1 - fc)
    met = asked.withColumn("__w", weight).join(cells.select("row", "col", F.col(value).alias("__v")), ["row", "col"], "left")
    return met.groupBy(*keys).agg(F.when(F.count("__v") == 4, F.sum(F.col("__w") * F.col("__v"))).alias(value))


def hillshade(cells: DataFrame, value: str, step: float, light: tuple[float, float, float] = (-0.5, 0.5, 0.75)) -> DataFrame:
    """Shade from central differences of four neighbours; neutral 1 where one is missing."""
    at = lambda i, j: F.max(F.when((F.col("dr") == i) & (F.col("dc") == j), F.col(value)))
    near = spread(cells, value, [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)])
    four = near.groupBy("row", "col").agg(at(0, 0).alias("o"), at(0, 1).alias("e"), at(0, -1).alias("w"), at(1, 0).alias("n"), at(-1, 0).alias("s")).where("o is not null")
    dx, dy = (F.col("e") - F.col("w")) / (2 * step), (F.col("n") - F.col("s")) / (2 * step)
    shade = (-dx * light[0] - dy * light[1] + light[2]) / F.sqrt(dx * dx + dy * dy + 1)
    return four.select("row", "col", F.coalesce(shade, F.lit(1.0)).alias("shade"))
