"""Polygon overlay as joins: noding, windings, boundaries, rings; and on them repair, union, clip and simplification.

A polygon is ``rings``, an array of rings (arrays of x, y, not closed), of which a point is inside an odd number: shells and
holes need no order. Work is on a grid of whole numbers (``GRID`` to a unit), so sides and crossings are exact; only a
crossing itself is rounded to the grid. Every step is a join or a grouping by the caller's keys and by tiles of the plane, so
one large figure is dealt like many small ones:

* ``noded``: edges meet in tiles; where they cross is a node, and an edge is split at each node whose grid square it passes
  (snap rounding, after Hobby, 1999). Equal pieces become one, with the sum of their directions and their number.
* ``windings``: how often the edges wind about either side of each piece. A tile knows the winding at its lower left
  corner, from a running sum along its row of tiles; from there a path inside the tile leads to the piece's middle.
* ``boundary``: the pieces with the wanted inside on one side only, turned so that it is on their left.
* ``rings_of``: at each node a piece is followed by the next one clockwise, so rings that touch in a point stay apart; the rings of
  a large figure are components of these links, and each is put in order by itself.

Directions at a node are told apart by their angle in double precision: edges may be some millions of grid steps long.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.binding import let
from . import graph
from . import spatial as S

#: Steps to a unit of the plane.
GRID = 1000
#: Side of a tile in units of the plane.
TILE = 64.0
#: Edges of a figure whose rings are put in order in one row; larger figures are parted into rings first.
TOGETHER = 1_024
EDGE = ("x0", "y0", "x1", "y1")
POINTS = "array<struct<x:double,y:double>>"


def _sum(columns: list[str]) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in columns]


def _upward(df: DataFrame, keys: list[str], weights: dict[str, Column]) -> DataFrame:
    """Pieces between whole-number points, turned upward (level ones to the right), equal ones summed. A weight that has a
    direction changes its sign where a piece is turned; ``n`` counts pieces and has none. Pieces without length go."""
    x0, y0, x1, y1 = (F.col(c) for c in EDGE)
    turned = (y0 > y1) | ((y0 == y1) & (x0 > x1))
    kept = df.where((x0 != x1) | (y0 != y1))
    swap = {c: F.when(turned, F.col(o)).otherwise(F.col(c)) for c, o in zip(EDGE, ("x1", "y1", "x0", "y0"))}
    values = {n: w if n == "n" else F.when(turned, -w).otherwise(w) for n, w in weights.items()}
    return kept.select(*keys, *[c.alias(n) for n, c in swap.items()], *[c.alias(n) for n, c in values.items()]).groupBy(*keys, *EDGE).agg(*_sum(list(weights)))


def _on_grid(ring: Column, grid: int) -> Column:
    whole = lambda v: F.round(v * grid).cast("long")
    return F.transform(ring, lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y")))


def edges_of(df: DataFrame, keys: list[str], rings: str = "rings", grid: int = GRID) -> DataFrame:
    """(keys, x0, y0, x1, y1): the directed edges of all rings on the grid. Null rings and rings of less than two points have none."""
    ring = df.select(*keys, F.explode(rings).alias("ring")).where(F.size("ring") >= 2)
    on_grid = ring.select(*keys, _on_grid(F.col("ring"), grid).alias("ring"))
    edge = on_grid.select(*keys, F.explode(g.ring_edges(F.col("ring"))).alias("e"))
    return edge.select(*keys, *[F.col(f"e.{p}.{c}").alias(n) for p, c, n in (("a", "x", "x0"), ("a", "y", "y0"), ("b", "x", "x1"), ("b", "y", "y1"))])


def _convex(ring: Column) -> Column:
    """1 if a ring on the grid turns left at every point, 1 in all round, -1 if right, 0 for any other and for one so thin that a point
    lies in reach of an edge it does not end (snap rounding would move it). No point of a convex ring is nearer to an edge
    than the edge's neighbours are."""

    def met(e: Column, f: Column) -> Column:
        ex, ey, fx, fy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"], f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
        up = lambda x, y: (y > 0) | ((y == 0) & (x > 0))
        reach = F.greatest(F.abs(ex) + F.abs(ey), F.abs(fx) + F.abs(fy))
        return F.struct((2 * _cross(ex, ey, fx, fy)).alias("turn"), reach.alias("reach"), (up(ex, ey) & ~up(fx, fy)).alias("falls"))

    def turned(turns: Column) -> Column:
        once = F.size(F.filter(turns, lambda t: t["falls"])) == 1
        return F.when(once & F.forall(turns, lambda t: t["turn"] > t["reach"]), 1).when(once & F.forall(turns, lambda t: -t["turn"] > t["reach"]), -1).otherwise(0)

    return let(let(g.ring_edges(ring), lambda e: F.zip_with(e, g.ring_next(e), met)), turned)


def _passed(df: DataFrame, names: tuple[str, str, str, str], size: int, shift: int = 0, pad: int = 1) -> DataFrame:
    """``df`` repeated for each tile (i, j) that the edge between two points passes within ``pad`` steps: columns of tiles first, then
    in each the stretch of rows that the edge has there, so a long edge is dealt by its length, not by its box."""
    x0, y0, x1, y1 = (F.col(c) - shift for c in names)
    left, right = F.least(x0, x1), F.greatest(x0, x1)
    span = lambda a, b: F.explode(F.sequence(F.floor((a - pad) / size), F.floor((b + pad) / size)))
    columns = df.withColumn("i", span(left, right))
    slope = (y1 - y0) / F.nullif(x1 - x0, F.lit(0))
    at = lambda x: F.coalesce(y0 + slope * (F.greatest(left, F.least(right, x)) - x0), y0)
    a, b = at(F.col("i") * size - pad), at((F.col("i") + 1) * size + pad)
    level = x0 == x1
    return columns.withColumn("j", span(F.when(level, F.least(y0, y1)).otherwise(F.least(a, b) - 1), F.when(level, F.greatest(y0, y1)).otherwise(F.greatest(a, b) + 1)))


def _prefixed(df: DataFrame, prefix: str, columns: tuple | list) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns], *[c for c in ("i", "j") if c in df.columns])


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _same(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(left + k).eqNullSafe(F.col(right + k))
    return out


def _line_edges(line: Column) -> Column:
    return F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def crossings(edges: DataFrame, keys: list[str], tile: float = TILE, grid: int = GRID) -> DataFrame:
    """(keys, x, y): where two edges of the same keys cross inside both, rounded to the grid."""
    dealt = _passed(edges, EDGE, max(1, round(tile * grid)))
    a, b = _prefixed(dealt, "a_", [*keys, *EDGE]), _prefixed(dealt, "b_", [*keys, *EDGE])
    ax, ay, bx, by = F.col("a_x0"), F.col("a_y0"), F.col("b_x0"), F.col("b_y0")
    adx, ady, bdx, bdy = F.col("a_x1") - ax, F.col("a_y1") - ay, F.col("b_x1") - bx, F.col("b_y1") - by
    turn, along, across = _cross(adx, ady, bdx, bdy), _cross(bdx, bdy, ax - bx, ay - by), _cross(adx, ady, ax - bx, ay - by)
    inner = (turn > 0) & (along > 0) & (along < turn) & (across > 0) & (across < turn)  # b turns left from a, so a pair is met once
    met = a.join(graph.by_shuffle(b), ["i", "j"]).where(_same("a_", "b_", keys) & inner)  # a pair may meet in several tiles; its node is one
    t = along / F.nullif(turn, F.lit(0))
    return met.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.round(ax + adx * t).cast("long").alias("x"), F.round(ay + ady * t).cast("long").alias("y"))


def nodes_of(edges: DataFrame, keys: list[str], tile: float = TILE, grid: int = GRID) -> DataFrame:
    """(keys, x, y): the ends of edges, and where they cross. Crossings are written first: planned in one with what reads
    them, their join was some twenty times slower."""
    end = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    ends = edges.select(*keys, F.explode(F.array(end(0), end(1))).alias("p")).select(*keys, "p.x", "p.y")
    return ends.unionByName(graph.checkpoint(crossings(edges, keys, tile, grid))).distinct()


def split(edges: DataFrame, nodes: DataFrame, keys: list[str], weights: list[str], node_keys: list[str], tile: float = TILE, grid: int = GRID) -> DataFrame:
    """Merged edges (``_upward``) cut at every node whose grid square they pass. Nodes bear ``node_keys``, some of the keys."""
    size = max(1, round(tile * grid))
    point = nodes.select(*[F.col(k).alias(f"n_{k}") for k in node_keys], F.col("x").alias("n_x"), F.col("y").alias("n_y"), F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j"))
    boxed = _prefixed(_passed(edges, EDGE, size), "e_", [*keys, *EDGE])
    x, y = F.col("n_x") - F.col("e_x0"), F.col("n_y") - F.col("e_y0")
    dx, dy = F.col("e_x1") - F.col("e_x0"), F.col("e_y1") - F.col("e_y0")
    passes = 2 * F.abs(_cross(dx, dy, x, y)) <= F.abs(dx) + F.abs(dy)
    inner = ((x != 0) | (y != 0)) & ((x != dx) | (y != dy))
    near = F.col("n_x").between(F.least("e_x0", "e_x1"), F.greatest("e_x0", "e_x1")) & F.col("n_y").between(F.least("e_y0", "e_y1"), F.greatest("e_y0", "e_y1"))
    met = point.join(graph.by_shuffle(boxed), ["i", "j"]).where(_same("n_", "e_", node_keys) & near & passes & inner)
    stop = F.struct((x * dx + y * dy).alias("at"), F.col("n_x").alias("x"), F.col("n_y").alias("y"))
    stops = met.select(*[F.col(f"e_{c}").alias(c) for c in (*keys, *EDGE)], *[F.lit(None).cast("long").alias(w) for w in weights], stop.alias("stop"))
    both = edges.select(*keys, *EDGE, *[F.col(w).cast("long").alias(w) for w in weights], F.lit(None).cast(stops.schema["stop"].dataType).alias("stop")).unionByName(stops)
    held = both.groupBy(*keys, *EDGE).agg(*_sum(weights), F.array_sort(F.collect_list("stop")).alias("stops"))  # nodes of one edge
    held = held.withColumn("stops", F.transform("stops", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))))
    first, last = (F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y"))) for a, b in (("x0", "y0"), ("x1", "y1")))
    line = F.concat(first, "stops", last)
    piece = held.select(*keys, *weights, F.explode(_line_edges(line)).alias("e")).select(*keys, *weights, "e.*")
    return graph.checkpoint(_upward(piece, keys, {w: F.col(w) for w in weights}))


def noded(edges: DataFrame, keys: list[str], weights: list[str], tile: float = TILE, grid: int = GRID) -> DataFrame:
    """Pieces of merged edges that meet in end points only."""
    return split(edges, nodes_of(edges, keys, tile, grid), keys, weights, keys, tile, grid)


def windings(pieces: DataFrame, keys: list[str], weights: list[str], tile: float = TILE, grid: int = GRID) -> DataFrame:
    """``pieces`` with ``left_`` and ``right_`` of each weight: its sum about the two sides. Coordinates are doubled here, so that
    middles are whole; borders of tiles are odd and no vertex lies on one."""
    size = 2 * max(1, round(tile * grid))
    index = lambda v: F.floor((v - 1) / size)  # noqa: E731  of the tile that holds a doubled coordinate
    edge = pieces.select(*keys, *[(2 * F.col(c)).alias(f"d_{c}") for c in EDGE], *weights)
    X0, Y0, X1, Y1 = (F.col(f"d_{c}") for c in EDGE)
    dx, dy = X1 - X0, Y1 - Y0
    # what an edge adds to the winding along a row's lower border, dealt to the tile where it crosses it
    rows = edge.where(index(Y0) < index(Y1)).withColumn("j", F.explode(F.sequence(index(Y0) + 1, index(Y1))))
    measured = rows.select(*keys, "j", *weights, dx.alias("dx"), ((X0 - 1) * dy + dx * (F.col("j") * size + 1 - Y0)).alias("along"), (dy * size).alias("across"))
    column = F.expr("(along - pmod(along, across)) div across - if(pmod(along, across) = 0 and dx < 0, 1, 0)")  # just above the border
    low = measured.select(*keys, "j", column.alias("i"), *[(-F.col(w)).alias(w) for w in weights])
    px, py = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    middles = pieces.select(*keys, *EDGE, *weights, px.alias("px"), py.alias("py"), index(px).alias("i"), index(py).alias("j"))
    asked = middles.select(*keys, "i", "j").distinct()
    both = low.groupBy(*keys, "j", "i").agg(*_sum(weights)).withColumn("asked", F.lit(False)).unionByName(asked.select(*keys, "j", "i", *[F.lit(0).cast("long").alias(w) for w in weights], F.lit(True).alias("asked")))
    before = W.partitionBy(*keys, "j").orderBy("i").rangeBetween(W.unboundedPreceding, -1)
    corners = both.select(*keys, "i", "j", "asked", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"corner_{w}") for w in weights]).where("asked").drop("asked")
    # edges in every tile that they pass
    dealt = _passed(edge, tuple(f"d_{c}" for c in EDGE), size, shift=1)
    on = lambda l, r: [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in (*keys, "i", "j")]
    c, low_y = F.col("p.i") * size + 1, F.col("p.j") * size + 1
    qx, qy = F.col("px"), F.col("py")
    at, sign = (c - X0) * dy * F.signum(dx).cast("long"), F.signum(dx).cast("long")
    rises = (F.least(X0, X1) < c) & (c < F.greatest(X0, X1)) & (at <= (qy - Y0) * F.abs(dx)) & (at > (low_y - Y0) * F.abs(dx))
    run = dx * (qy - Y0)
    passes = (Y0 <= qy) & (qy < Y1) & (run < (qx - X0) * dy) & ((run > (c - X0) * dy) | ((run == (c - X0) * dy) & (dx > 0)))
    turn = F.when(rises, sign).otherwise(0) - F.when(passes, 1).otherwise(0)
    held = [*keys, *EDGE, *weights]
    met = middles.alias("p").join(graph.by_shuffle(dealt.alias("e")), on("p", "e")).select(*[f"p.{c}" for c in (*held, "i", "j")], *[(turn * F.col(f"e.{w}")).alias(f"path_{w}") for w in weights])
    path = met.groupBy(*held, "i", "j").agg(*_sum([f"path_{w}" for w in weights]))
    left = lambda w: F.col(f"path_{w}") + F.col(f"corner_{w}")
    sides = path.alias("p").join(graph.by_shuffle(corners.alias("c")), on("p", "c"))
    return sides.select(*[f"p.{c}" for c in held], *[left(w).alias(f"left_{w}") for w in weights], *[(left(w) - F.col(f"p.{w}")).alias(f"right_{w}") for w in weights])


def boundary(sided: DataFrame, keys: list[str], inside) -> DataFrame:
    """(keys, x0, y0, x1, y1): pieces between inside and outside, with the inside on the left. ``inside`` gives a condition for
    the prefix of a side."""
    left, right = inside("left_"), inside("right_")
    turned = {c: F.when(left, F.col(c)).otherwise(F.col(o)) for c, o in zip(EDGE, ("x1", "y1", "x0", "y0"))}
    return sided.where(left != right).select(*keys, *[v.alias(n) for n, v in turned.items()])


def _in_order(links) -> list:
    """The rings of some links (id, next, x, y), each from its lowest, then leftmost point; straight points go."""
    follow = {r["id"]: (r["next"], r["x"], r["y"]) for r in links}
    out = []
    while follow:
        at, points = next(iter(follow)), []
        while at in follow:
            at, x, y = follow.pop(at)
            points.append((x, y))
        bent = [q for p, q, r in zip([points[-1], *points], points, [*points[1:], points[0]]) if (q[0] - p[0]) * (r[1] - q[1]) != (q[1] - p[1]) * (r[0] - q[0])]
        if len(bent) >= 3:
            first = min(range(len(bent)), key=lambda k: (bent[k][1], bent[k][0]))
            out.append([{"x": float(x), "y": float(y)} for x, y in bent[first:] + bent[:first]])
    return out


def _order_udf():
    @F.pandas_udf(f"array<{POINTS}>")
    def ordered(links: pd.Series) -> pd.Series:
        return links.map(_in_order)

    return ordered


def rings_of(edges: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """(keys, ring, area): the rings that directed edges form, in units of the plane; holes have negative area."""
    held = graph.checkpoint(edges.withColumn("id", F.monotonically_increasing_id()))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = held.select(*keys, "id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.atan2(dy.cast("double"), dx.cast("double")).alias("angle"), F.lit(True).alias("leaves"))
    into = held.select(*keys, "id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.atan2(-dy.cast("double"), -dx.cast("double")).alias("angle"), F.lit(False).alias("leaves"))
    around = W.partitionBy(*keys, "x", "y").orderBy(F.col("angle").desc())
    following = F.coalesce(F.lead("id").over(around), F.first("id").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    links = graph.checkpoint(out.unionByName(into).withColumn("next", following).where("not leaves").select("id", "next"))
    # the few edges of a small figure are put in order together; those of a large one by ring
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    many = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER)
    large = graph.checkpoint(held.alias("l").join(graph.by_shuffle(many.alias("r")), on, "left_semi").select("id") if keys else held.select("id"))
    found = graph.connected_components(large, links.join(graph.by_shuffle(large), "id", "left_semi").select(F.col("id").alias("a"), F.col("next").alias("b")), "id")
    rows = held.join(graph.by_shuffle(links), "id").join(graph.by_shuffle(found), "id", "left")
    one = rows.groupBy(*keys, "component").agg(F.collect_list(F.struct("id", "next", F.col("x0").alias("x"), F.col("y0").alias("y"))).alias("links"))  # one ring, or one small figure
    ring = one.select(*keys, F.explode(_order_udf()("links")).alias("ring"))
    scaled = ring.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] / grid).alias("x"), (p["y"] / grid).alias("y"))))
    return graph.checkpoint(scaled.withColumn("area", g.signed_area(F.col("ring"))))


def with_holes(rings: DataFrame, keys: list[str], tile: float = TILE) -> DataFrame:
    """(keys, rings, area): one row for each shell with the holes that lie in it, in no smaller shell."""
    named = rings.withColumn("shell", F.monotonically_increasing_id())
    named = graph.checkpoint(named.withColumns({k: v for k, v in g.ring_box(F.col("ring")).items()}))
    shells, holes = named.where("area > 0"), named.where("area < 0")
    hole = holes.select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("shell").alias("hole"), F.col("ring").alias("hole_ring"), F.col("area").alias("hole_area"))
    hole = hole.withColumns({"hx": (F.col("hole_ring")[0]["x"] + F.col("hole_ring")[1]["x"]) / 2, "hy": (F.col("hole_ring")[0]["y"] + F.col("hole_ring")[1]["y"]) / 2})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"h_{k}").eqNullSafe(F.col(k))
    held = S.bucket_join(hole, graph.by_shuffle(shells), ("hx", "hy", "hx", "hy"), ("min_x", "min_y", "max_x", "max_y"), tile, refine=same & g.in_ring(F.col("hx"), F.col("hy"), F.col("ring")) & (-F.col("hole_area") < F.col("area")))
    best = held.groupBy("hole").agg(F.min(F.struct("area", "shell", "hole_ring", "hole_area")).alias("b")).select("b.shell", "b.hole_ring", "b.hole_area")
    inner = best.groupBy("shell").agg(F.array_sort(F.collect_list("hole_ring")).alias("holes"), F.sum("hole_area").alias("hole_area"))
    joined = shells.join(graph.by_shuffle(inner), "shell", "left")
    return joined.select(*keys, F.concat(F.array("ring"), F.coalesce("holes", F.slice(F.array("ring"), 1, 0))).alias("rings"), (F.col("area") + F.coalesce("hole_area", F.lit(0.0))).alias("area"))


def _fitted(edges: DataFrame, tile: float, grid: int) -> float:
    """Side of tiles in which short edges of crowded figures meet near ones only: twice the mean extent of an edge, ``tile`` at most. On
    average an edge is dealt to two tiles or less, however many share a figure."""
    extent = edges.agg(F.avg(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0")))).first()[0]
    return min(tile, 2 * extent / grid) if extent else tile


def overlay(edges: DataFrame, keys: list[str], weights: list[str], inside, tile: float = TILE, grid: int = GRID, crowded: bool = False) -> DataFrame:
    """(keys, rings, area): the polygons, one a row, of the points that ``inside`` holds for. ``edges``: merged and weighted; they are
    written first, since each step reads them anew. Tiles are fitted to edges if figures are ``crowded`` with short ones."""
    edges = graph.checkpoint(edges)
    fine = _fitted(edges, tile, grid) if crowded else tile
    pieces = noded(edges, keys, weights, fine, grid)
    return with_holes(rings_of(boundary(windings(pieces, keys, weights, fine, grid), keys, inside), keys, grid), keys, tile)


def repair(df: DataFrame, keys: list[str], rings: str = "rings", tile: float = TILE, grid: int = GRID) -> DataFrame:
    """(keys, rings, area): valid polygons, one a row, of the points inside an odd number of times. Edges may cross, repeat or
    touch. Rows of the same keys are one figure; figures without area have no rows."""
    edges = _upward(edges_of(df, keys, rings, grid), keys, {"n": F.lit(1)})
    return overlay(edges, keys, ["n"], lambda side: F.pmod(F.col(f"{side}n"), F.lit(2)) == 1, tile, grid)


def _oriented(df: DataFrame, keys: list[str], rings: str, tile: float, grid: int) -> DataFrame:
    """Directed edges of each row's repaired figure, the inside on their left. A figure that is one convex ring is valid as it is."""
    turn = F.when(F.size(rings) == 1, _convex(_on_grid(F.col(rings)[0], grid)))
    each = graph.checkpoint(df.select(*keys, rings).withColumns({"__turn": F.coalesce(turn, F.lit(0)), "__row": F.monotonically_increasing_id()}))
    ring = F.col(rings)[0]
    plain = edges_of(each.where("__turn <> 0").select(*keys, F.array(F.when(F.col("__turn") > 0, ring).otherwise(F.reverse(ring))).alias(rings)), keys, rings, grid)
    each = each.where("__turn = 0")
    if each.isEmpty():
        return plain
    edges = _upward(edges_of(each, [*keys, "__row"], rings, grid), [*keys, "__row"], {"n": F.lit(1)})
    sided = windings(noded(graph.checkpoint(edges), [*keys, "__row"], ["n"], tile, grid), [*keys, "__row"], ["n"], tile, grid)
    return plain.unionByName(boundary(sided, [*keys, "__row"], lambda side: F.pmod(F.col(f"{side}n"), F.lit(2)) == 1).select(*keys, *EDGE))


def _wound(df: DataFrame, keys: list[str], rings: str, grid: int) -> DataFrame:
    """Directed edges of valid figures: the first ring, the shell, turns left, holes turn right."""
    turn = lambda r, k: F.when((g.signed_area(r) > 0) == (k == 0), r).otherwise(F.reverse(r))
    return edges_of(df.select(*keys, F.transform(rings, turn).alias(rings)), keys, rings, grid)


def union(df: DataFrame, keys: list[str], rings: str = "rings", tile: float = TILE, grid: int = GRID, valid: bool = False) -> DataFrame:
    """(keys, rings, area): what the rows of the same keys cover together. Rows are repaired first, unless they are known to be
    ``valid``, each a shell and its holes; opposite edges of neighbours cancel."""
    edges = _wound(df, keys, rings, grid) if valid else _oriented(df, keys, rings, tile, grid)
    edges = _upward(edges, keys, {"w": F.lit(1)})
    return overlay(edges.where("w <> 0"), keys, ["w"], lambda side: F.col(f"{side}w") > 0, tile, grid, crowded=True)


def clip(left: DataFrame, right: DataFrame, keys: list[str], rings: str = "rings", rule: str = "both", tile: float = TILE, grid: int = GRID) -> DataFrame:
    """(keys, rings, area): of each key, what ``left`` and ``right`` cover ``both``, or the ``left`` one ``only``. Either side may be
    concave, have holes, or be several rows, which count together."""
    one = _oriented(left, keys, rings, tile, grid).withColumns({"a": F.lit(1), "b": F.lit(0)})
    two = _oriented(right, keys, rings, tile, grid).withColumns({"a": F.lit(0), "b": F.lit(1)})
    edges = _upward(one.unionByName(two), keys, {"a": F.col("a"), "b": F.col("b")})
    wanted = {"both": lambda side: (F.col(f"{side}a") > 0) & (F.col(f"{side}b") > 0), "only": lambda side: (F.col(f"{side}a") > 0) & (F.col(f"{side}b") <= 0)}
    return overlay(edges, keys, ["a", "b"], wanted[rule], tile, grid)


def clip_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float, rings: str = "rings", tile: float = TILE, grid: int = GRID) -> DataFrame:
    """(left_id, right_id, rings, area): the intersections of all pairs of rows that share some. Pairs meet by their boxes in
    cells; both tables name their rings alike."""

    def boxed(df: DataFrame, prefix: str, key: str) -> tuple[DataFrame, tuple]:
        box = tuple(prefix + c for c in ("left", "low", "right", "high"))
        return df.select(key, F.col(rings).alias(f"{prefix}rings"), *[v.alias(n) for n, v in zip(box, g.rings_box(F.col(rings)).values())]), box

    (a, abox), (b, bbox) = boxed(left, "a_", left_id), boxed(right, "b_", right_id)
    pairs = graph.checkpoint(S.bucket_join(a, graph.by_shuffle(b), abox, bbox, cell).select(left_id, right_id, "a_rings", "b_rings"))
    keys = [left_id, right_id]
    return clip(pairs.select(*keys, F.col("a_rings").alias(rings)), pairs.select(*keys, F.col("b_rings").alias(rings)), keys, rings, "both", tile, grid)


# simplification --------------------------------------------------------------------------------------------------------


def _farthest(points: list[tuple[int, int]], first: int, last: int) -> tuple[float, int]:
    """Squared distance from the line between two points, and place, of the point farthest from it."""
    (ax, ay), (bx, by) = points[first], points[last]
    dx, dy = bx - ax, by - ay
    length, best, at = dx * dx + dy * dy, -1.0, first
    for k in range(first + 1, last):
        x, y = points[k][0] - ax, points[k][1] - ay
        t = min(1.0, max(0.0, (x * dx + y * dy) / length)) if length else 0.0
        d = (x - t * dx) ** 2 + (y - t * dy) ** 2
        if d > best:
            best, at = d, k
    return best, at


def _thinned(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """Douglas and Peucker's line without recursion; a closed line is halved at the point farthest from its start."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    closed = points[0] == points[-1]
    if closed:
        _, middle = _farthest(points, 0, len(points) - 1)
        keep.add(middle)
        todo = [(0, middle), (middle, len(points) - 1)]
    while todo:
        first, last = todo.pop()
        d, at = _farthest(points, first, last)
        if d > tolerance * tolerance:
            keep.add(at)
            todo += [(first, at), (at, last)]
    return [points[k] for k in sorted(keep)] if not closed or len(keep) >= 4 else points


def _chain(edges) -> list[tuple[int, int]]:
    """The points of an arc in order: from its lesser end, or from its least point towards the lesser neighbour."""
    near: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for e in edges:
        a, b = (e["x0"], e["y0"]), (e["x1"], e["y1"])
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    ends = sorted(p for p, n in near.items() if len(n) == 1)
    at = ends[0] if ends else min(near)
    line, before = [at], None
    for _ in range(len(edges)):
        step = sorted(n for n in near[at] if n != before) or near[at]
        before, at = at, step[0]
        line.append(at)
    return line


def _arc_udf(tolerance: float):
    @F.pandas_udf("struct<whole:array<struct<x:long,y:long>>,thin:array<struct<x:long,y:long>>>")
    def thin(edges: pd.Series) -> pd.DataFrame:
        lines = [_chain(e) for e in edges]
        shown = lambda line: [{"x": x, "y": y} for x, y in line]
        return pd.DataFrame({"whole": [shown(x) for x in lines], "thin": [shown(_thinned(x, tolerance)) for x in lines]})

    return thin


def simplify(df: DataFrame, key: str, tolerance: float, rings: str = "rings", tile: float = TILE, grid: int = GRID, rounds: int = 8) -> DataFrame:
    """(key, rings, area): polygons with fewer points, none moved by more than ``tolerance``. Borders are cut into arcs between
    the nodes where more than two meet; each arc is thinned once, so neighbours that share it keep it alike. Arcs that would
    cross or cover another one after it stay as they were. A polygon may come out as several rows, one a shell."""
    owned = graph.checkpoint(_oriented(df.select(key, rings), [key], rings, tile, grid))
    common = _upward(owned, [], {"n": F.lit(1)})
    nodes = graph.checkpoint(nodes_of(common, [], tile, grid))
    pieces = graph.checkpoint(split(common, nodes, [], ["n"], [], tile, grid).select(*EDGE).withColumn("id", F.monotonically_increasing_id()))
    ends = pieces.select("id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"))
    two = ends.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2 and a <> b").select("a", "b")
    arc_of = graph.connected_components(pieces.select("id"), two, "id")
    arcs = pieces.join(graph.by_shuffle(arc_of), "id").groupBy(F.col("component").alias("arc")).agg(F.collect_list(F.struct(*EDGE)).alias("edges"))  # one border line
    lines = graph.checkpoint(arcs.select("arc", _arc_udf(tolerance * grid)("edges").alias("t")).select("arc", "t.whole", F.col("t.thin").alias("line")))
    for _ in range(rounds):
        bad = _conflicts(lines, tile, grid)
        if bad.isEmpty():
            break
        lines = graph.checkpoint(lines.join(graph.by_shuffle(bad.withColumn("bad", F.lit(True))), "arc", "left").select("arc", "whole", F.when(F.col("bad"), F.col("whole")).otherwise(F.col("line")).alias("line")))
    else:
        raise RuntimeError("arcs did not settle")
    # who uses an arc, and which way: by its first edge, since all edges of an arc lie between the same polygons
    own = split(_upward(owned, [key], {"w": F.lit(1)}), nodes, [key], ["w"], [], tile, grid).where("w <> 0")
    first = lines.select("arc", "line", F.col("whole")[0].alias("p"), F.col("whole")[1].alias("q"))
    up = (F.col("p.y") < F.col("q.y")) | ((F.col("p.y") == F.col("q.y")) & (F.col("p.x") < F.col("q.x")))
    low, high = F.when(up, F.col("p")).otherwise(F.col("q")), F.when(up, F.col("q")).otherwise(F.col("p"))
    first = first.select("arc", "line", up.alias("up"), low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1"))
    used = first.join(graph.by_shuffle(own), list(EDGE)).select(key, F.when((F.col("w") > 0) == F.col("up"), F.col("line")).otherwise(F.reverse("line")).alias("line"))
    directed = used.select(key, F.explode(_line_edges(F.col("line"))).alias("e")).select(key, "e.*")
    return with_holes(rings_of(directed, [key], grid), [key], tile)


def _conflicts(lines: DataFrame, tile: float, grid: int) -> DataFrame:
    """(arc): thinned arcs that meet another arc, or themselves, elsewhere than in an end."""
    edges = lines.select("arc", F.posexplode(_line_edges(F.col("line"))).alias("at", "e")).select("arc", "at", "e.*")
    side = lambda p: edges.select(*[F.col(c).alias(p + c) for c in edges.columns])
    a, b = side("a_"), side("b_")
    box = lambda p: {p + n: f(F.col(f"{p}{c}0"), F.col(f"{p}{c}1")) for n, f, c in (("left", F.least, "x"), ("low", F.least, "y"), ("right", F.greatest, "x"), ("high", F.greatest, "y"))}
    a, b = a.withColumns(box("a_")), b.withColumns(box("b_"))
    names = lambda p: tuple(p + c for c in ("left", "low", "right", "high"))
    ax, ay, bx, by = F.col("a_x0"), F.col("a_y0"), F.col("b_x0"), F.col("b_y0")
    adx, ady, bdx, bdy = F.col("a_x1") - ax, F.col("a_y1") - ay, F.col("b_x1") - bx, F.col("b_y1") - by
    a0, a1 = F.signum(_cross(adx, ady, bx - ax, by - ay)), F.signum(_cross(adx, ady, F.col("b_x1") - ax, F.col("b_y1") - ay))
    b0, b1 = F.signum(_cross(bdx, bdy, ax - bx, ay - by)), F.signum(_cross(bdx, bdy, F.col("a_x1") - bx, F.col("a_y1") - by))
    # an end of one inside the other (it is on its line and between its ends)
    between = lambda p, q, end: ((F.col(f"{q}x{end}") - F.col(f"{p}x0")) * (F.col(f"{q}x{end}") - F.col(f"{p}x1")) + (F.col(f"{q}y{end}") - F.col(f"{p}y0")) * (F.col(f"{q}y{end}") - F.col(f"{p}y1"))) < 0
    touch = ((a0 == 0) & between("a_", "b_", 0)) | ((a1 == 0) & between("a_", "b_", 1)) | ((b0 == 0) & between("b_", "a_", 0)) | ((b1 == 0) & between("b_", "a_", 1))
    same = lambda first, last: (ax == F.col(f"b_x{first}")) & (ay == F.col(f"b_y{first}")) & (F.col("a_x1") == F.col(f"b_x{last}")) & (F.col("a_y1") == F.col(f"b_y{last}"))
    equal = same(0, 1) | same(1, 0)
    other = (F.col("a_arc") < F.col("b_arc")) | ((F.col("a_arc") == F.col("b_arc")) & (F.col("a_at") < F.col("b_at")))
    met = S.bucket_join(a, graph.by_shuffle(b), names("a_"), names("b_"), tile * grid, refine=other & (((a0 * a1 < 0) & (b0 * b1 < 0)) | touch | equal))
    thinned = lines.where(F.size("line") < F.size("whole")).select("arc")
    return graph.checkpoint(met.select(F.explode(F.array("a_arc", "b_arc")).alias("arc")).distinct().join(graph.by_shuffle(thinned), "arc", "left_semi"))
