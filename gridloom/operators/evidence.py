"""Height evidence: exact quantiles per footprint, an acceptance gate, ranked de-duplication, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import Box, box_gap2, bucket_join, inside, point_box

ROOF, GROUND = 6, 2
MIN_ROOF, MIN_GROUND = 10, 5
HIGH_ROOF, HIGH_GROUND = 100, 20


def height_evidence(points: DataFrame, footprints: DataFrame, box: Box, cell: float, buffer: float, keys: list[str], unit: float = 0.01,
                    min_roof: int = MIN_ROOF, min_ground: int = MIN_GROUND, high_roof: int = HIGH_ROOF, high_ground: int = HIGH_GROUND) -> DataFrame:
    """Per footprint and tile: roof points inside it and ground points within ``buffer`` of it, exact quantiles with linear
    interpolation of the raw whole-number z, scaled afterwards. Columns of ``points``: cls, x, y, z."""
    near = (F.col("cls") == ROOF) & inside("x", "y", box) | (F.col("cls") == GROUND) & (box_gap2(point_box(), box) <= buffer * buffer)
    met = bucket_join(points.where(F.col("cls").isin(ROOF, GROUND)), footprints, point_box(), box, cell, buffer, near)
    roof, ground = F.when(F.col("cls") == ROOF, F.col("z")), F.when(F.col("cls") == GROUND, F.col("z"))
    grouped = met.groupBy(*keys).agg(
        F.count(roof).alias("roof_points"), F.count(ground).alias("ground_points"),
        F.percentile(ground, F.lit(0.25)).alias("g"), F.percentile(roof, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"),
    ).where((F.col("roof_points") >= min_roof) & (F.col("ground_points") >= min_ground))
    high = (F.col("roof_points") >= high_roof) & (F.col("ground_points") >= high_ground)
    q = F.col("q")
    return grouped.select(
        *keys, "roof_points", "ground_points", (F.col("g") * unit).alias("ground_m"), *[(q[k] * unit).alias(n) for k, n in enumerate(("p10_m", "p50_m", "p90_m"))],
        ((q[2] - F.col("g")) * unit).alias("height_m"), ((q[2] - q[0]) * unit).alias("spread_m"), F.when(high, "high").otherwise("usable").alias("quality"),
    )


def accepted(height: Column, spread: Column, low: float = 2.4, high: float = 400.0) -> Column:
    """A height within its limits whose roof does not spread too far. Not a number is never accepted."""
    return height.between(low, high) & ~F.isnan(height) & (spread <= F.greatest(F.lit(1.0), height * 0.35))


def best_evidence(evidence: DataFrame, key: str, tile: str) -> DataFrame:
    """One row per footprint: accepted first, then high quality, more ground points, more roof points, smaller tile."""
    ok = accepted(F.col("height_m"), F.col("spread_m"))
    order = W.partitionBy(key).orderBy(ok.desc(), (F.col("quality") == "high").desc(), F.col("ground_points").desc(), F.col("roof_points").desc(), tile)
    return evidence.withColumn("accepted", ok).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def coverage(flags: DataFrame, covered: Column, area: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and areas, all and covered, with percentages to two digits, half to even; of nothing, 0."""
    percent = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.bround(100.0 * a / F.nullif(b, F.lit(0)), 2))
    sums = flags.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("n_covered"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"), F.coalesce(F.sum(F.when(covered, area)), F.lit(0.0)).alias("area_covered")
    )
    return sums.withColumns({"percent": percent(F.col("n_covered"), F.col("n")), "area_percent": percent(F.col("area_covered"), F.col("area"))})
