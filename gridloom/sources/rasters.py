"""Raster artifacts: masks and terrain as packed blocks, each with its digest, and one over all digests.

A block holds ``rows`` rows of a grid, ``digits`` hexadecimal digits to a cell (one: sixteen classes; four: signed heights). Blocks
are made, checked and opened by column expressions alone. Writing reads everything back and compares before the new
generation becomes current; reading names the blocks that were changed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError
from . import publish


@dataclass(frozen=True)
class Grid:
    """``lowest`` is the least value that can be stored; cells that are not given hold ``empty``."""

    width: int
    height: int
    digits: int = 1
    lowest: int = 0
    empty: int = 0
    rows: int = 64

    @property
    def values(self) -> int:
        return 16**self.digits


def pack(cells: DataFrame, grid: Grid) -> DataFrame:
    """(block, payload, sha256) from (row, col, value). Cells outside the grid, given twice, or with a value that does not fit, are an
    error; a block without cells is written too."""
    inside = F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1) & F.col("value").between(grid.lowest, grid.lowest + grid.values - 1)
    code = F.when(inside, F.col("value") - grid.lowest).otherwise(F.raise_error(F.concat(F.lit("a cell or its value is outside the grid: "), F.to_json(F.struct("row", "col", "value")))).cast("long"))
    fill = F.lpad(F.hex(F.lit(grid.empty - grid.lowest)), grid.digits, "0")
    placed = cells.select(F.floor(F.col("row") / grid.rows).alias("block"), (F.col("row") % grid.rows * grid.width + F.col("col")).cast("int").alias("at"), F.lpad(F.hex(code), grid.digits, "0").alias("code"))
    # runs of empty cells between those that are given; the stretch after the last one ends the block
    given = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("cells"))  # one block
    blocks = cells.sparkSession.range(-(-grid.height // grid.rows)).select(F.col("id").alias("block"))
    size = F.least(F.lit(grid.rows), F.lit(grid.height) - F.col("block") * grid.rows).cast("int") * grid.width
    held = blocks.join(given, "block", "left").withColumn("cells", F.coalesce("cells", F.expr("cast(array() as array<struct<at:int,code:string>>)")))
    # the place before each cell's own: an array of its own beside the cells, since a lambda would make it again for each cell
    held = held.withColumn("before", F.concat(F.array(F.lit(-1)), F.transform("cells", lambda c: c["at"])))

    def text(c: Column, b: Column) -> Column:
        gap = c["at"] - b - 1
        return F.concat(F.repeat(fill, F.when(gap >= 0, gap).otherwise(F.raise_error(F.lit("a cell is given twice")).cast("int"))), c["code"])

    texts = F.zip_with("cells", F.slice("before", F.lit(1), F.size("cells")), text)
    rest = F.repeat(fill, size - 1 - F.element_at("before", -1))
    odd = F.when(size * grid.digits % 2 == 1, "0").otherwise("")
    even = F.concat(F.array_join(texts, ""), rest, odd)
    return held.select("block", F.unhex(even).alias("payload")).withColumn("sha256", F.sha2("payload", 256))


def unpack(blocks: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, value) of all cells that are not empty."""
    size = F.least(F.lit(grid.rows), F.lit(grid.height) - F.col("block") * grid.rows).cast("int") * grid.width
    code = F.expr(f"substring(digits, at * {grid.digits} + 1, {grid.digits})")
    opened = blocks.select("block", F.hex("payload").alias("digits"), size.alias("size"))
    lines = opened.select("block", F.explode(F.sequence(F.lit(0), (F.col("size") / grid.width).cast("int") - 1)).alias("line"), "digits")
    lines = lines.select("block", "line", F.expr(f"substring(digits, line * {grid.width * grid.digits} + 1, {grid.width * grid.digits})").alias("digits"))
    cells = lines.select("block", "line", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("at"), "digits").select("block", "line", "at", (F.conv(code, 16, 10).cast("long") + grid.lowest).alias("value"))
    return cells.where(F.col("value") != grid.empty).select((F.col("block") * grid.rows + F.col("line")).alias("row"), F.col("at").cast("long").alias("col"), "value")


def digest(blocks: DataFrame) -> str:
    """The digest over all blocks' digests, in their order: 32 bytes a block reach one task."""
    found = blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda b: b["sha256"]), ""), 256).alias("d"))
    return found.first()["d"]


def changed(blocks: DataFrame) -> DataFrame:
    """(block): those whose payload does not have its digest."""
    return blocks.where(F.sha2("payload", 256) != F.col("sha256")).select("block")


def write(cells: DataFrame, grid: Grid, root: str, about: dict[str, str] | None = None) -> dict:
    """Write a raster below ``root`` and make it current; returns its header. The audit opens what was written and compares it with
    the given cells before that."""
    spark = cells.sparkSession
    name = publish.stage(pack(cells, grid), root, ["block"])
    written = spark.read.parquet(f"{root}/{name}")
    given = cells.where(F.col("value") != grid.empty).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("long"))
    if publish.checksum(unpack(written, grid)) != publish.checksum(given):
        raise ContractError("the written raster differs from the cells given; the old one stays current")
    header = {"grid": vars(grid), "blocks": written.count(), "sha256": digest(written), "about": about or {}}
    publish.make_current(spark, root, name, header)
    return header


def open_raster(spark: SparkSession, root: str, expected: Grid | None = None) -> tuple[DataFrame, dict]:
    """Cells and header of the current raster. Another grid than the expected one, missing or changed blocks are errors; the
    message names the blocks."""
    said = publish.current_header(spark, root)
    grid = Grid(**said["grid"])
    if expected is not None and grid != expected:
        raise ContractError(f"the raster has the grid {grid}, not {expected}")
    blocks = spark.read.parquet(f"{root}/{said['generation']}")
    bad = [r.block for r in changed(blocks).orderBy("block").limit(20).collect()]
    if bad:
        raise ContractError(f"blocks {bad} were changed after they were written")
    if blocks.count() != said["blocks"] or digest(blocks) != said["sha256"]:
        raise ContractError("blocks are missing, added or exchanged")
    return unpack(blocks, grid), said


def at_cells(places: DataFrame, cells: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """``places`` with the value of the cell that holds (x, y), null where that is empty."""
    keyed = places.withColumns({"__row": F.floor(y / size), "__col": F.floor(x / size)})
    values = cells.select(F.col("row").alias("__row"), F.col("col").alias("__col"), "value")
    return keyed.join(values, ["__row", "__col"], "left").drop("__row", "__col")
