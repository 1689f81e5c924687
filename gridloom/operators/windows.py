"""Ordered operators: gaps, contiguity, margins between best and second best, running caps, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_profile(df: DataFrame, keys: list[str], at: Column, tie: str) -> DataFrame:
    """Per group: rows, the largest gap to the row before, where it starts (the first of equals), strictly rising or not."""
    order = W.partitionBy(*keys).orderBy("__at", tie)
    steps = df.withColumn("__at", at).withColumns({"__gap": F.col("__at") - F.lag("__at").over(order), "__before": F.lag("__at").over(order)})
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("__gap").alias("largest_gap"), F.max_by("__before", F.struct("__gap", -F.col("__before"))).alias("gap_starts"),
        F.coalesce(F.bool_and(F.col("__gap") > 0), F.lit(True)).alias("strictly_rising"),
    )


def contiguous(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Whether a group's numbers are whole, without gap or repeat."""
    n = F.count_distinct(number)
    return df.groupBy(*keys).agg(F.min(number).alias("first"), F.max(number).alias("last"), ((F.max(number) - F.min(number) + 1 == n) & (n == F.count(F.lit(1)))).alias("contiguous"))


def clear_winner(df: DataFrame, keys: list[str], candidate: str, distance: str, margin: float) -> DataFrame:
    """The nearest candidate of each group if the second is at least ``margin`` farther; else the row is ambiguous. One
    candidate's rows count by their least distance."""
    best = df.groupBy(*keys, candidate).agg(F.min(distance).alias(distance))
    order = W.partitionBy(*keys).orderBy(distance, candidate)
    first = best.withColumns({"__n": F.row_number().over(order), "__next": F.lead(distance).over(order)}).where("__n = 1")
    clear = F.coalesce(F.col("__next") - F.col(distance) >= margin, F.lit(True))
    return first.select(*keys, F.when(clear, F.col(candidate)).alias(candidate), distance, F.when(clear, "accepted").otherwise("ambiguous").alias("status"))


def nearest_two(df: DataFrame, keys: list[str], candidate: str, distance: str) -> DataFrame:
    """(keys, candidate, distance): the two candidates of each group that ``clear_winner`` can need, by distance and candidate."""
    best = df.groupBy(*keys, candidate).agg(F.min(distance).alias(distance))
    order = W.partitionBy(*keys).orderBy(distance, candidate)
    return best.withColumn("__n", F.row_number().over(order)).where("__n <= 2").drop("__n")


def evict(df: DataFrame, group: str, size: str, order: list, cap: int) -> DataFrame:
    """Rows of each store to delete, oldest first, until what stays is within ``cap``."""
    total = F.sum(size).over(W.partitionBy(group))
    before = F.coalesce(F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumns({"__total": total, "__before": before}).where(F.col("__total") - F.col("__before") > cap).drop("__total", "__before")


def nearest_reported(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order``, each with omitted: how many rows were left out."""
    total = df.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("omitted"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one row
