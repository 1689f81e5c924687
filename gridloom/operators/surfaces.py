"""What a screen shows: canopy over the ground, tiles under a turned figure, walls with their normals and materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import geometry as g
from . import polygons as P
from . import spatial as S

# Canopy heights by clearance, in metres; the reach of a wall's probe; wall colours by kind of building.
CANOPY_EDGE, CANOPY_STEP, CANOPY_BANDS = 1.0, 2.25, 4
PROBE = 0.05
ROWHOUSE_FAMILIES = (
    ((143, 78, 58), (156, 88, 65), (169, 101, 72), (132, 73, 59)), ((139, 92, 68), (153, 101, 75), (164, 113, 84), (128, 87, 72)),
    ((178, 151, 113), (188, 164, 128), (163, 140, 109), (194, 174, 143)), ((137, 137, 132), (153, 148, 139), (167, 158, 145), (126, 130, 128)),
)
LOW_RISE = ((151, 96, 72), (167, 112, 82), (143, 145, 139), (188, 169, 141))
INDUSTRIAL = ((169, 161, 145), (151, 153, 148), (181, 171, 150), (139, 147, 148))
HIGH_RISE = ((151, 137, 121), (132, 145, 150), (174, 164, 145), (146, 142, 136))
BLOCK = 400.0


def canopy_surface(pixels: DataFrame, canopy: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """The canopy that each pixel (keys, view, sx, sy) shows: x, y, height, depth and band. Every band's height names one place on the
    ground that would show there; it counts if the raster (row, col, band) has that band there. Of several the nearest to the
    viewer stays, of equal depths the higher. Pixels that show none are left out."""
    each = pixels.select(*keys, "view", "sx", "sy").withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(CANOPY_BANDS - 1))))
    each = each.withColumn("height", F.lit(CANOPY_EDGE) + F.col("band") * CANOPY_STEP)
    x, y = g.isometric_inverse(F.col("view"), F.col("sx"), F.col("sy") + F.col("height"))
    placed = each.withColumns({"x": x, "y": y}).withColumns({"row": F.floor(F.col("y") / size), "col": F.floor(F.col("x") / size)})
    found = placed.join(canopy.select("row", "col", "band"), ["row", "col", "band"])
    depth = g.view_depth(F.col("view"), F.col("x"), F.col("y"), F.col("height"))
    best = F.max(F.struct(depth.alias("depth"), "band", "x", "y", "height")).alias("b")
    return found.groupBy(*keys).agg(best).select(*keys, "b.x", "b.y", "b.height", "b.depth", "b.band")


def figure_cover(df: DataFrame, keys: list[str], corners: Column, x0: float, y0: float, side: float, n: int) -> DataFrame:
    """(keys, tx, ty): tiles of a grid of n x n, with their borders, that a convex figure meets, borders and corners included. Tiles
    of the figure's box are parted from it along the box's axes and the normals of its own edges."""
    boxed = df.select(*keys, corners.alias("ring")).withColumns(g.ring_box(F.col("ring")))
    low = lambda v, o: F.greatest(F.lit(0), F.ceil((F.col(v) - o) / side) - 1).cast("long")
    high = lambda v, o: F.least(F.lit(n - 1), F.floor((F.col(v) - o) / side)).cast("long")
    span = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    each = boxed.withColumn("tx", span(low("min_x", x0), high("max_x", x0))).withColumn("ty", span(low("min_y", y0), high("max_y", y0)))
    left, top = F.col("tx") * side + x0, F.col("ty") * side + y0
    turn = F.when(g.signed_area(F.col("ring")) < 0, -1.0).otherwise(1.0)

    def apart(e: Column) -> Column:
        nx, ny = (e["b"]["y"] - e["a"]["y"]) * turn, (e["a"]["x"] - e["b"]["x"]) * turn  # outwards
        # the tile's corner that reaches farthest inwards
        qx, qy = F.when(nx > 0, left).otherwise(left + side), F.when(ny > 0, top).otherwise(top + side)
        return (qx - e["a"]["x"]) * nx + (qy - e["a"]["y"]) * ny > 1e-9

    return each.where(~F.exists(g.ring_edges(F.col("ring")), apart)).select(*keys, "tx", "ty")


def walls(buildings: DataFrame, key: str, cell: float, ring: str = "ring", reach: float = PROBE) -> DataFrame:
    """(key, edge, nx, ny, free): every edge's outward normal, and whether the probe in front of it lies in no other building. Edges
    without a normal are left out."""
    base = buildings.select(F.col(key).alias("__id"), F.col(ring).alias("__ring"))
    edge = base.select("__id", "__ring", F.posexplode(g.ring_edges(F.col("__ring"))).alias("edge", "e"))
    normal = F.array(g.outward_normal(F.col("__ring"), F.col("e.a"), F.col("e.b"), reach))
    faced = edge.select("*", F.explode(F.array_compact(normal)).alias("n"))  # as a condition it would be computed twice
    probe = lambda c: (F.col(f"e.a.{c}") + F.col(f"e.b.{c}")) / 2 + F.col(f"n.{c}") * reach
    asked = faced.select(F.col("__id").alias(key), "edge", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), probe("x").alias("px"), probe("y").alias("py"))
    others = base.withColumns({f"o_{k}": v for k, v in g.ring_box(F.col("__ring")).items()})
    hit = S.bucket_join(asked, others, S.point_box("px", "py"), ("o_min_x", "o_min_y", "o_max_x", "o_max_y"), cell, refine=(F.col("__id") != F.col(key)) & g.in_ring(F.col("px"), F.col("py"), F.col("__ring")))
    hit = hit.select(key, "edge").distinct().withColumn("party", F.lit(True))
    return asked.join(hit, [key, "edge"], "left").select(key, "edge", "nx", "ny", F.col("party").isNull().alias("free"))


def place_seed(x: Column, y: Column) -> Column:
    """A seed from a place rounded to units; coordinates below zero count as zero, and lie under 2**31."""
    whole = lambda v: F.greatest(F.lit(0), F.round(v).cast("long"))
    a, b = whole(x) * 0x9E3779B9, whole(y)
    return a.bitwiseXOR(F.shiftleft(b, 23).bitwiseOR(F.shiftrightunsigned(b, 41)))


def _unsigned_rest(seed: Column, n: int) -> Column:
    """The rest of a 64-bit number without sign."""
    return ((F.shiftrightunsigned(seed, 1) % n) * 2 + seed.bitwiseAND(F.lit(1).cast("long"))) % n


def _pick(table: tuple, at: Column) -> C.Rgb:
    rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in table])
    return tuple(F.get(F.get(rows, at.cast("int")), F.lit(k)) for k in range(3))


def wall_material(facade: C.Rgb, x: Column, y: Column, seed: Column, group_seed: Column, kind: Column) -> C.Rgb:
    """A wall's colour: the building's own, mixed with one of its kind's. A row of houses shares a family by its group's seed and
    varies in it by each house's; other kinds vary by block."""
    block = _unsigned_rest(place_seed(F.floor(x / BLOCK), F.floor(y / BLOCK)), 4)
    families = tuple(color for family in ROWHOUSE_FAMILIES for color in family)
    row = _pick(families, _unsigned_rest(group_seed, 4) * 4 + _unsigned_rest(seed, 4))
    tone = F.lit(0.94) + seed.bitwiseAND(F.lit(7).cast("long")) * 0.014
    mixed = lambda other, amount: C.scale(C.mix_columns(facade, other, amount), tone)
    of = {"rowhouse": mixed(row, 0.42), "industrial": mixed(_pick(INDUSTRIAL, block), 0.3), "high": mixed(_pick(HIGH_RISE, block), 0.18), "low": mixed(_pick(LOW_RISE, block), 0.24)}
    return tuple(F.when(kind == "rowhouse", of["rowhouse"][k]).when(kind == "industrial", of["industrial"][k]).when(kind.isin("mid_rise", "tower"), of["high"][k]).otherwise(of["low"][k]) for k in range(3))


def shadow_polygons(prisms: DataFrame, keys: list[str], dx: float, dy: float, tile: float = P.TILE) -> DataFrame:
    """(keys, rings, area): what the shadows of the prisms (keys, ring, bottom, top) of the same keys cover together. A prism's shadow
    is its top's, and what each edge passes over from its bottom's place to its top's. Prisms without height cast none."""
    at = lambda h: F.transform("ring", lambda p: g.point(p["x"] + F.col(h) * dx, p["y"] + F.col(h) * dy))
    cast = prisms.where((F.col("top") > F.col("bottom")) & (F.size("ring") >= 3)).withColumns({"low": at("bottom"), "high": at("top")})
    sides = F.zip_with(F.zip_with("low", g.ring_next(F.col("low")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.zip_with("high", g.ring_next(F.col("high")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda l, h: F.array(l["a"], l["b"], h["b"], h["a"]))
    pieces = cast.select(*keys, F.explode(F.concat(F.array("high"), sides)).alias("piece"))
    return P.union(pieces.select(*keys, F.array("piece").alias("rings")), keys, tile=tile, valid=True)
