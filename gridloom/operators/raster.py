"""Pixels as rows: depth compositing, triangles, medians, modes, entropy, differences, label placement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C


def nearest_depth(fragments: DataFrame, keys: list[str], color: str, depth: str, order: str) -> DataFrame:
    """Per pixel the colour of the greatest depth; of equal depths the first written wins."""
    best = F.max_by(color, F.struct(F.col(depth), -F.col(order)))
    return fragments.groupBy(*keys).agg(best.alias(color), F.max(depth).alias(depth), F.count(F.lit(1)).alias("fragments"))


def layered(fragments: DataFrame, keys: list[str], color: str, layer: str, depth: str, order: str) -> DataFrame:
    """The top layer wins, then depth, then the first written."""
    return fragments.groupBy(*keys).agg(F.max_by(color, F.struct(F.col(layer), F.col(depth), -F.col(order))).alias(color), F.max(layer).alias(layer))


def triangle_pixels(triangles: DataFrame, a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> DataFrame:
    """Rows repeated for each pixel (px, py) whose centre is inside the triangle or on its border, with weights wa, wb, wc."""
    xs, ys = [F.col(p[0]) for p in (a, b, c)], [F.col(p[1]) for p in (a, b, c)]
    span = lambda v: F.explode(F.sequence(F.floor(F.least(*v)), F.ceil(F.greatest(*v)) - 1))
    area = (xs[1] - xs[0]) * (ys[2] - ys[0]) - (xs[2] - xs[0]) * (ys[1] - ys[0])
    fine = triangles.where((area != 0) & (F.ceil(F.greatest(*xs)) > F.floor(F.least(*xs))) & (F.ceil(F.greatest(*ys)) > F.floor(F.least(*ys))))
    each = fine.withColumn("px", span(xs)).withColumn("py", span(ys))
    x, y = F.col("px") + 0.5, F.col("py") + 0.5
    wa = ((xs[1] - x) * (ys[2] - y) - (xs[2] - x) * (ys[1] - y)) / area
    wb = ((xs[2] - x) * (ys[0] - y) - (xs[0] - x) * (ys[2] - y)) / area
    return each.withColumns({"wa": wa, "wb": wb}).withColumn("wc", 1 - F.col("wa") - F.col("wb")).where("wa >= 0 and wb >= 0 and wc >= 0")


def ranked_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Upper median by counts: a group is only as large as its number of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    run = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    at = counts.withColumns({"__upto": F.sum("__n").over(run), "__all": F.sum("__n").over(whole)})
    hit = (F.col("__upto") > F.floor(F.col("__all") / 2)) & (F.col("__upto") - F.col("__n") <= F.floor(F.col("__all") / 2))
    return at.where(hit).select(*keys, F.col(value).alias(name))


def mode_window(df: DataFrame, keys: list[str], bin_: str, reach: int = 2, share: float = 0.6) -> DataFrame:
    """The bin whose surroundings (``reach`` bins either way) hold most rows, ties to the smaller; ``dominant`` if they
    hold ``share`` of all. Counts are dealt to the bins around them: an equi-join, not a range join."""
    counts = df.groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("__n"))
    own = counts.select(*keys, F.col(bin_).alias("mode"))
    dealt = counts.withColumn("mode", F.explode(F.sequence(F.col(bin_) - reach, F.col(bin_) + reach)))
    around = dealt.join(own, [*keys, "mode"]).groupBy(*keys, "mode").agg(F.sum("__n").alias("within"))
    best = around.groupBy(*keys).agg(F.max_by(F.struct("mode", "within"), F.struct("within", -F.col("mode"))).alias("__b"))
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("total"))
    return best.join(total, keys).select(*keys, "__b.mode", "__b.within", "total", (F.col("__b.within") >= share * F.col("total")).alias("dominant"))


def wall_tone(samples: DataFrame, keys: list[str], channels: tuple[str, str, str]) -> DataFrame:
    """(keys, channels): the upper median of each channel over the samples that are neither dark nor glaring, softened; grey where
    none is left. A group is as large as its number of different values."""
    r, g, b = (F.col(c) for c in channels)
    fine = samples.where((r * 3 + g * 6 + b).between(400, 2_200))
    out = samples.select(*keys).distinct()
    for c in channels:
        out = out.join(ranked_median(fine, keys, c, f"__{c}"), keys, "left")
    soft = C.soften(tuple(F.col(f"__{c}") for c in channels))
    return out.select(*keys, *[F.coalesce(v, F.lit(128)).cast("int").alias(c) for c, v in zip(channels, soft)])


def neighbourhood_mode(counts: DataFrame, reach: int = 3, window: int = 2, share: float = 0.6) -> DataFrame:
    """(row, col, mode, within, total, level) from (row, col, bin, n): for each cell that has any within ``reach`` rows and columns, the bin
    around which, ``window`` bins either way, most of them lie, ties to the smaller; ``level``, the mean bin of those, is null unless
    they are ``share`` of all. Rows are summed first, then columns: a cell is copied twice 2 * reach + 1 times, not its square."""
    spread = counts.select("row", "col", "bin", "n")
    for axis in ("row", "col"):
        spread = spread.withColumn(axis, F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach))).groupBy("row", "col", "bin").agg(F.sum("n").alias("n"))
    dealt = spread.select("row", "col", F.explode(F.sequence(F.col("bin") - window, F.col("bin") + window)).alias("mode"), "n", (F.col("n") * F.col("bin")).alias("weight"), F.col("bin"))
    around = dealt.groupBy("row", "col", "mode").agg(F.sum("n").alias("within"), F.sum("weight").alias("weight"), F.bool_or(F.col("mode") == F.col("bin")).alias("own")).where("own")
    best = around.groupBy("row", "col").agg(F.max_by(F.struct("mode", "within", "weight"), F.struct("within", -F.col("mode"))).alias("b"))
    total = spread.groupBy("row", "col").agg(F.sum("n").alias("total"))
    level = F.when(F.col("b.within") >= share * F.col("total"), F.col("b.weight") / F.col("b.within"))
    return best.join(total, ["row", "col"]).select("row", "col", "b.mode", "b.within", "total", level.alias("level"))


def picture_audit(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percent of neighbours, along rows and down columns, that are equal, and of 2 x 2 squares of one value. Neighbours meet in
    one group per square: a pixel is copied to the four squares it belongs to."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    dealt = pixels.select(*keys, "row", "col", value).withColumn("o", corner).select(*keys, (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), (F.col("o.i") * 2 + F.col("o.j")).alias("at"), value)
    v = [F.max(F.when(F.col("at") == k, F.col(value))).alias(f"v{k}") for k in range(4)]
    square = dealt.groupBy(*keys, "row", "col").agg(*v)
    right, down = F.col("v0").isNotNull() & F.col("v1").isNotNull(), F.col("v0").isNotNull() & F.col("v2").isNotNull()
    whole = right & down & F.col("v3").isNotNull()
    one = whole & (F.col("v0") == F.col("v1")) & (F.col("v0") == F.col("v2")) & (F.col("v0") == F.col("v3"))
    percent = lambda a, b: F.round(100.0 * F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 4)
    n = lambda c: c.cast("long")
    equal = n(right & (F.col("v0") == F.col("v1"))) + n(down & (F.col("v0") == F.col("v2")))
    return square.groupBy(*keys).agg(percent(equal, n(right) + n(down)).alias("equal_percent"), percent(n(one), n(whole)).alias("uniform_percent"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bits of the histogram of ``value`` per group."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("__n") * F.log2("__n")) / total).alias("entropy"), total.alias("pixels"))


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str, mask: str) -> DataFrame:
    """Pixels that differ, inside and outside a mask, and pixels that only one side has."""
    b = before.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__in_b"))
    a = after.select(*keys, F.col(value).alias("__a"), mask, F.lit(1).alias("__in_a"))
    both = F.col("__in_b").isNotNull() & F.col("__in_a").isNotNull()
    changed = both & ~F.col("__b").eqNullSafe(F.col("__a"))
    return b.join(a, keys, "full").agg(
        F.count_if(changed & F.col(mask)).alias("inside"), F.count_if(changed & ~F.col(mask)).alias("outside"), F.count_if(~both).alias("unmatched"), F.count(F.lit(1)).alias("pixels")
    )


def place_labels(labels: DataFrame, group: str, budget: int = 40) -> DataFrame:
    """Greedy placement in one viewport: by rank, no two boxes overlap, one label per name, ``budget`` at most. It depends
    on what was placed before, so a viewport is one group; a viewport's labels are bounded by the map, not by the data."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        placed: list[tuple] = []
        names, rows = set(), []
        for r in pdf.sort_values(["rank", "name"]).itertuples(index=False):
            free = all(r.x1 <= p[0] or p[2] <= r.x0 or r.y1 <= p[1] or p[3] <= r.y0 for p in placed)
            if len(placed) < budget and free and r.name not in names:
                placed.append((r.x0, r.y0, r.x1, r.y1))
                names.add(r.name)
                rows.append((getattr(r, group), r.name, len(placed)))
        return pd.DataFrame(rows, columns=[group, "name", "place"])

    kind = labels.schema[group].dataType.simpleString()
    return labels.groupBy(group).applyInPandas(run, f"{group} {kind}, name string, place long")


def spread_labels(labels: DataFrame, group: str, budget: int, cell: tuple[float, float] = (190.0, 84.0)) -> DataFrame:
    """Placement in two passes over (group, rank, name, x, y and box): first one label at most for each cell of the screen, then whatever
    fits beside those; by rank and name, no two boxes overlap, one label a name, ``budget`` at most. A viewport is one group: its
    labels are bounded by the map, not by the data."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        placed, rows = [], []
        names, cells = set(), set()
        ordered = list(pdf.sort_values(["rank", "name"]).itertuples(index=False))
        for first in (True, False):
            for r in ordered:
                at = (r.x // cell[0], r.y // cell[1])
                if len(placed) >= budget or r.name in names or (first and at in cells):
                    continue
                if all(r.x1 <= p[0] or p[2] <= r.x0 or r.y1 <= p[1] or p[3] <= r.y0 for p in placed):
                    placed.append((r.x0, r.y0, r.x1, r.y1))
                    names.add(r.name)
                    cells.add(at)
                    rows.append((getattr(r, group), r.name, len(placed)))
        return pd.DataFrame(rows, columns=[group, "name", "place"])

    kind = labels.schema[group].dataType.simpleString()
    return labels.groupBy(group).applyInPandas(run, f"{group} {kind}, name string, place long")


def outside_fill(cells: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Cells of each picture that the outside does not reach (covered ones and enclosed holes): keys, row, col. A picture
    has at most ``width * height`` cells, a fixed bound; pictures are spread over tasks."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                full = np.zeros((height + 2, width + 2), dtype=bool)
                full[[p["row"] + 1 for p in r.cells], [p["col"] + 1 for p in r.cells]] = True
                reached = np.zeros_like(full)
                reached[0, 0] = True
                while True:
                    grown = reached.copy()
                    grown[1:] |= reached[:-1]
                    grown[:-1] |= reached[1:]
                    grown[:, 1:] |= reached[:, :-1]
                    grown[:, :-1] |= reached[:, 1:]
                    grown &= ~full
                    if (grown == reached).all():
                        break
                    reached = grown
                rows, cols = np.nonzero(~reached[1:-1, 1:-1])
                out.append(pd.DataFrame({**{k: getattr(r, k) for k in keys}, "row": rows, "col": cols}))
            if out:
                yield pd.concat(out)

    pictures = cells.groupBy(*keys).agg(F.collect_set(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))).alias("cells"))
    schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys) + ", row long, col long"
    return pictures.mapInPandas(run, schema)
