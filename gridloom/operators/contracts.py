"""Fail-closed data contracts. A rule gives a table of violations (rule, subject, detail); an empty table passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import checkpoint


class ContractError(ValueError):
    """A contract does not hold."""


def exact_schema(df: DataFrame, schema: T.StructType) -> None:
    """Names, types and their order, checked on the plan alone."""
    have = [(f.name, f.dataType) for f in df.schema]
    want = [(f.name, f.dataType) for f in schema]
    if have != want:
        raise ContractError(f"columns are {have}, not {want}")


def _violation(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def where_not(df: DataFrame, rule: str, holds: Column, subject: str, detail: Column | None = None) -> DataFrame:
    """Rows for which ``holds`` is false or unknown."""
    return _violation(df.where(~F.coalesce(holds, F.lit(False))), rule, F.col(subject), F.lit("") if detail is None else detail)


def unique_key(df: DataFrame, rule: str, key: str) -> DataFrame:
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > 1) | F.col(key).isNull())
    return _violation(repeated, rule, F.col(key), F.col("__n"))


def row_count(df: DataFrame, rule: str, least: int, most: int | None = None) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    bad = F.col("__n") < least if most is None else (F.col("__n") < least) | (F.col("__n") > most)
    return _violation(n.where(bad), rule, F.lit("rows"), F.col("__n"))


def single_value(df: DataFrame, rule: str, column: str) -> DataFrame:
    n = df.agg(F.min(column).alias("__a"), F.max(column).alias("__b"))
    return _violation(n.where(~F.col("__a").eqNullSafe(F.col("__b"))), rule, F.lit(column), F.concat_ws("..", "__a", "__b"))


def in_order(df: DataFrame, rule: str, keys: list[str], order: str, value: str) -> DataFrame:
    """``value`` must rise strictly along ``order`` within each group."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return _violation(df.withColumn("__before", before).where(F.col("__before") >= F.col(value)), rule, F.concat_ws("/", *keys), F.col(value))


def same_keys(left: DataFrame, right: DataFrame, rule: str, key: str) -> DataFrame:
    """Both sides must have exactly the same keys."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return _violation(a.join(b, key, "left_anti"), rule, F.col(key), F.lit("left only")).unionByName(_violation(b.join(a, key, "left_anti"), rule, F.col(key), F.lit("right only")))


def same_distribution(df: DataFrame, pinned: DataFrame, rule: str, column: str) -> DataFrame:
    """Counts by value against pinned counts (value, n)."""
    have = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    both = have.exceptAll(pinned.select("value", "n")).withColumn("side", F.lit("found")).unionByName(pinned.select("value", "n").exceptAll(have).withColumn("side", F.lit("pinned")))
    return _violation(both, rule, F.col("value"), F.concat_ws(" ", "side", "n"))


def digests_match(df: DataFrame, rule: str, content: str, digest: str, subject: str) -> DataFrame:
    return where_not(df, rule, F.sha2(F.col(content).cast("binary"), 256) == F.col(digest), subject)


def report(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def enforce(violations: DataFrame) -> None:
    """Raises with the first violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ContractError("; ".join(f"{r.rule}: {r.subject} {r.detail}" for r in found))


def table_digest(df: DataFrame, key: str, columns: list[str], span: int = 4096, levels: int | None = None) -> DataFrame:
    """One digest of a table in the order of its key, a unique whole number. Rows are digested in runs of ``span`` keys, these in runs of
    ``span``, and so on until at most ``span`` are left, which are digested together: no task holds more than a run, however
    sparse the keys are (six steps cover 64 bits). ``levels`` fixes the number of these steps, whatever the number of rows, for a digest
    that others state; what is then left, a digest for each ``span ** levels`` keys, is held together."""
    row = F.sha2(F.to_json(F.struct(key, *columns), {"ignoreNullFields": "false"}), 256)
    level = df.select(F.col(key).alias("k"), row.alias("d"), F.lit(1).cast("long").alias("n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda s: s["d"]), ""), 256)
    up = lambda rows: rows.groupBy(F.expr(f"k div {span}").alias("k")).agg(joined.alias("d"), F.sum("n").alias("n"))
    for _ in range(2 if levels is None else levels):
        level = up(level)
    if levels is not None:
        return level.agg(joined.alias("digest"), F.sum("n").alias("rows"))
    level = checkpoint(level)
    while level.count() > span:
        level = checkpoint(up(level))
    return level.agg(joined.alias("digest"), F.sum("n").alias("rows"))
