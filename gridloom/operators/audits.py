"""Checks of inventories, artifacts and summaries, as joins and aggregates that any number of rows passes through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def inventory_faults(lines: DataFrame, top: int) -> DataFrame:
    """(fault, line) of tile lines z, x, y, size, digest, line: a level beyond ``top``, a place outside the level, no bytes,
    a digest that is none, or a tile that an earlier line has."""
    side = F.pow(F.lit(2.0), F.col("z"))
    out = lambda c: (F.col(c) < 0) | (F.col(c) >= side)
    place = F.row_number().over(W.partitionBy("z", "x", "y").orderBy("line"))
    rules = {"level": ~F.col("z").between(0, top), "place": out("x") | out("y"), "size": F.col("size") <= 0, "digest": ~F.col("digest").rlike("^[0-9a-f]{64}$"), "repeated": F.col("__n") > 1}
    faults = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return lines.withColumn("__n", place).select(F.explode(faults).alias("fault"), "line")


def summary(df: DataFrame, keys: list[str], ranges: dict[str, str], size: str) -> DataFrame:
    """Rows, total size and the least and largest of each of ``ranges`` per group."""
    ends = [f(c).alias(f"{label}_{name}") for name, c in ranges.items() for label, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), *ends)


def summary_differs(stored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose stored summary is not what a recomputation gives: differs, not stored, or not there any more."""
    values = [c for c in now.columns if c not in keys]
    a, b = stored.select(*keys, F.struct(*values).alias("__a")), now.select(*keys, F.struct(*values).alias("__b"))
    state = F.when(F.col("__a").isNull(), "not stored").when(F.col("__b").isNull(), "not there").when(F.col("__a") != F.col("__b"), "differs")
    return a.join(b, keys, "full").select(*keys, state.alias("state")).where("state is not null")


def artifact_states(artifacts: DataFrame, identity: str, least_version: int) -> DataFrame:
    """Adds the state of each artifact: unselected, pending (none yet), stale (made from other inputs), invalid, or its result."""
    state = (
        F.when(~F.col("selected"), "unselected").when(F.col("result").isNull(), "pending").when(F.col("identity") != identity, "stale")
        .when((F.col("result") == "derived") & (F.col("schema_version") < least_version), "invalid").otherwise(F.col("result"))
    )
    return artifacts.withColumn("state", state)


def completeness(states: DataFrame) -> DataFrame:
    """One row: selected, accounted for, with evidence, rejected; partial if one is missing, complete if none is missing or rejected."""
    missing, state = F.col("state").isin("pending", "stale", "invalid"), F.col("state")
    return states.agg(
        F.count_if("selected").alias("selected"), F.count_if(state.isin("derived", "outside", "rejected_source")).alias("accounted"), F.count_if(state == "derived").alias("evidence"),
        F.count_if(state == "rejected_source").alias("rejected"), F.bool_or(missing).alias("partial"), (~F.bool_or(missing | (state == "rejected_source"))).alias("complete"),
    )


def recheck(states: DataFrame, checks: DataFrame) -> DataFrame:
    """``recheck_state``: a rejection whose new check passes is pending again; everything else keeps its state."""
    joined = states.join(checks.select("file_id", "passes"), "file_id", "left")
    return joined.withColumn("recheck_state", F.when((F.col("state") == "rejected_source") & F.coalesce("passes", F.lit(False)), "pending").otherwise(F.col("state"))).drop("passes")


def provenance(said: DataFrame, listed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fault): the first column in which a manifest row (said_...) differs from the inventory, or that it is not listed."""
    joined = said.join(listed.withColumn("__listed", F.lit(True)), key, "left")
    fault = reduce(lambda acc, c: acc.when(~F.col(c).eqNullSafe(F.col(f"said_{c}")), c), columns, F.when(F.col("__listed").isNull(), "not listed"))
    return joined.select(key, fault.alias("fault")).where("fault is not null")


def union_bounds(df: DataFrame, keys: list[str], part: str, member: str) -> DataFrame:
    """Different members of each group against its parts: at least the largest part's and at most the sum of all."""
    parts = df.groupBy(*keys, part).agg(F.count_distinct(member).alias("n")).groupBy(*keys).agg(F.max("n").alias("largest"), F.sum("n").alias("total"))
    every = df.groupBy(*keys).agg(F.count_distinct(member).alias("n_different"))
    return every.join(parts, keys).withColumn("fits", F.col("n_different").between(F.col("largest"), F.col("total")))


def scene_versions(parts: DataFrame, scene: str, place: str, name: str) -> DataFrame:
    """Per scene: whether names ascend strictly, places are whole (no gap), and the version its parts give."""
    before = F.lag(name).over(W.partitionBy(scene).orderBy(place, name))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, name))), lambda x: F.concat(x[place].cast("string"), F.lit(":"), x[name].cast("string"))), ",")
    return parts.withColumn("__before", before).groupBy(scene).agg(  # a scene has a handful of parts
        F.coalesce(F.bool_and(F.col("__before") < F.col(name)), F.lit(True)).alias("ascending"), (F.count(F.lit(1)) == F.max(place)).alias("whole"), F.sha2(said, 256).alias("version")
    )


def refused_changes(old: DataFrame, new: DataFrame, used: DataFrame, key: str, digest: str) -> DataFrame:
    """Changed and removed entries of an inventory; refused where an artifact depends on them."""
    joined = old.join(new.withColumnRenamed(digest, "__new"), key, "left")
    changed = joined.select(key, F.when(F.col("__new").isNull(), "removed").when(F.col("__new") != F.col(digest), "changed").alias("change")).where("change is not null")
    return changed.join(used.select(key).distinct().withColumn("__used", F.lit(True)), key, "left").select(key, "change", F.col("__used").isNotNull().alias("refused"))


def class_audit(cells: DataFrame, stated: DataFrame, column: str) -> DataFrame:
    """Counted and stated cells of each class, whether they agree, and whether the stated ones add up to the grid."""
    counted = cells.groupBy(column).agg(F.count(F.lit(1)).alias("counted"))
    both = counted.join(stated, column, "full").select(column, F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("stated", F.lit(0)).alias("stated"))
    sums = both.agg((F.sum("counted") == F.sum("stated")).alias("sums_to_grid"))
    return both.withColumn("equal", F.col("counted") == F.col("stated")).crossJoin(F.broadcast(sums))  # one row


def seam_quality(steps: DataFrame, keys: list[str], step: str, seam: str, edge: float) -> DataFrame:
    """Percent of steps that are none, percent that are edges, and the largest seam over the 95th percentile by floor index."""
    order = W.partitionBy(*keys).orderBy(step)
    placed = steps.withColumns({"__i": F.row_number().over(order), "__n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    percent = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 4)
    p95 = F.min(F.when(F.col("__i") == F.floor((F.col("__n") - 1) * 0.95) + 1, F.col(step)))
    return placed.groupBy(*keys).agg(percent(F.col(step) == 0).alias("equal_percent"), percent(F.col(step) >= edge).alias("edge_percent"), F.round(F.max(F.when(F.col(seam), F.col(step))) / F.nullif(p95, F.lit(0.0)), 4).alias("seam_ratio"))


def set_scope(plan: DataFrame, expected: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Citywide where a plan's members are exactly the expected ones, else pilot."""
    a, b = plan.select(*keys, member).distinct().withColumn("__a", F.lit(1)), expected.select(*keys, member).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, [*keys, member], "full")
    other = F.count_if(F.col("__a").isNull() | F.col("__b").isNull())
    return both.groupBy(*keys).agg(F.count("__a").alias("planned"), F.count("__b").alias("expected"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"), F.when(other == 0, "citywide").otherwise("pilot").alias("scope"))


def input_versions(inputs: DataFrame, build: str, name: str, digest: str) -> DataFrame:
    """One digest of a build's inputs, in the order of their names. A build has a few inputs."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(name, digest))), lambda x: F.concat(x[name], F.lit("="), x[digest]))
    return inputs.groupBy(build).agg(F.sha2(F.array_join(lines, ";"), 256).alias("version"))


def newest_valid(files: DataFrame, source: str, at: str, key: str, name: str, digest: str, prefix: int = 12) -> DataFrame:
    """Per source: its files, the newest whose name begins with its digest, and the least name (never chosen by time)."""
    valid = F.substring(digest, 1, prefix) == F.substring(name, 1, prefix)
    newest = F.max_by(F.when(valid, F.col(key)), F.when(valid, F.struct(at, key)))
    return files.groupBy(source).agg(F.count(F.lit(1)).alias("files"), newest.alias("newest"), F.min(name).alias("snapshot"))


def strict_cells(boxes: DataFrame, key: str, box: tuple[str, str, str, str], size: float) -> DataFrame:
    """(key, cx, cy) of the grid cells whose inside each box overlaps."""
    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.ceil(F.col(high) / size) - 1))

    real = boxes.where((F.col(box[0]) < F.col(box[2])) & (F.col(box[1]) < F.col(box[3])))
    return real.withColumn("cx", span(box[0], box[2])).withColumn("cy", span(box[1], box[3])).select(key, "cx", "cy")


def sample_mask(points: DataFrame, mask: DataFrame, min_x: float, max_x: float, min_y: float, max_y: float, size: float, unknown: int = 0) -> DataFrame:
    """(id, cls) of each point: the class of the cell that holds it, rows counted from the top. The grid is closed: its outer
    edges belong to the last cells. Points outside and unknown classes give null."""
    inside = F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y)
    last = lambda low, high: int((high - low) / size) - 1
    cell = lambda v, n: F.when(inside, F.least(F.floor(v / size), F.lit(n)).cast("long"))
    placed = points.select("id", cell(F.col("x") - min_x, last(min_x, max_x)).alias("col"), cell(F.lit(max_y) - F.col("y"), last(min_y, max_y)).alias("row"))
    return placed.join(mask, ["row", "col"], "left").select("id", F.nullif(F.col("cls"), F.lit(unknown)).alias("cls"))
