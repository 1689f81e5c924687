"""Overlay against areas by slabs, odd figures, shared borders, one large figure over many tiles."""

import numpy as np
import pytest

from gridloom.functions import geometry as g
from gridloom.operators import polygons as P
from pyspark.sql import functions as F


def table(spark, rows, keys="k int"):
    shown = [(*k, None if rings is None else [[(float(x), float(y)) for x, y in ring] for ring in rings]) for *k, rings in rows]
    return spark.createDataFrame(shown, f"{keys}, rings array<array<struct<x:double,y:double>>>")


def slabs(figures, inside):
    """Area of the points for which ``inside`` holds of the list of figures they are in (an odd number of rings each)."""
    edges = [(i, a, b) for i, rings in enumerate(figures) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]
    ys = {p[1] for rings in figures for ring in rings for p in ring}
    for n, (_, a, b) in enumerate(edges):
        for _, c, d in edges[:n]:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    ys.add(a[1] + t * (b[1] - a[1]))
    total = 0.0
    for low, high in zip(sorted(ys), sorted(ys)[1:]):
        y = (low + high) / 2
        cuts = sorted((a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]), i) for i, a, b in edges if min(a[1], b[1]) < y < max(a[1], b[1]))
        held = [False] * len(figures)
        for (x, i), (x2, _) in zip(cuts, cuts[1:]):
            held[i] = not held[i]
            if inside(held):
                total += (x2 - x) * (high - low)
    return total


def star(rng, x, y, size, points):
    return [(round(float(x + px), 3), round(float(y + py), 3)) for px, py in rng.uniform(-size, size, (points, 2))]


def test_repair(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [star(rng, 1e6 + k * 7, -2e5, 40, 9), star(rng, 1e6 + k * 7 + 20, -2e5, 30, 5)]) for k in range(12)]
    rows += [(100, None), (101, []), (102, [[]]), (103, [[(0, 0), (5, 5)]]), (104, [[(0, 0)] * 6]), (None, [[(0, 0), (4, 0), (4, 4)]]), (105, [[(0, 0), (4, 0), (4, 4)]] * 2), (106, [[(0, 0), (4, 0), (4, 4)]] * 3)]
    got = P.repair(table(spark, rows), ["k"], tile=16.0).collect()
    area = {}
    for r in got:
        area[r.k] = area.get(r.k, 0) + r.area
        assert r.area > 0 and all(len(ring) >= 3 for ring in r.rings)
    for k, rings in rows[:12]:
        assert area[k] == pytest.approx(slabs([rings], lambda h: h[0]), abs=0.6)  # crossings move by up to a thousandth
    assert {k: v for k, v in area.items() if k is None or k >= 100} == {None: 8.0, 106: 8.0}
    assert not [r for r in P.repair(table(spark, [(r.k, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in got]), ["k"]).groupBy("k").agg(F.sum("area").alias("a")).collect() if abs(r.a - area[r.k]) > 1e-6]


def test_union_and_clip(spark):
    rng = np.random.default_rng(2)
    left = [(k % 3, [star(rng, 0, 0, 50, 4)]) for k in range(9)]
    right = [(k % 3, [star(rng, 10, 0, 40, 6), star(rng, 0, 10, 15, 3)]) for k in range(6)]
    union = {r.k: r.a for r in P.union(table(spark, left), ["k"], tile=24.0).groupBy("k").agg(F.sum("area").alias("a")).collect()}
    both = {rule: {r.k: r.a for r in P.clip(table(spark, left), table(spark, right), ["k"], rule=rule, tile=24.0).groupBy("k").agg(F.sum("area").alias("a")).collect()} for rule in ("both", "only")}
    for k in range(3):
        a, b = ([rings for key, rings in rows if key == k] for rows in (left, right))
        assert union[k] == pytest.approx(slabs(a, any), abs=0.5)
        n = len(a)
        assert both["both"][k] == pytest.approx(slabs(a + b, lambda h: any(h[:n]) and any(h[n:])), abs=0.6)
        assert both["only"][k] == pytest.approx(slabs(a + b, lambda h: any(h[:n]) and not any(h[n:])), abs=0.6)


def test_one_large_figure(spark):
    """A comb of a thousand teeth and a chessboard of holes, each one figure over many tiles."""
    comb = [(0, 0), (4000, 0), (4000, 10)] + [p for k in range(999, -1, -1) for p in ((k * 4 + 3, 10), (k * 4 + 2, 500), (k * 4 + 1, 10))] + [(0, 10)]
    holes = [[(x * 30, y * 30), (x * 30 + 20, y * 30), (x * 30 + 20, y * 30 + 20), (x * 30, y * 30 + 20)] for x in range(1, 19) for y in range(1, 19)]
    got = P.repair(table(spark, [(1, [comb]), (2, [[(0, 0), (600, 0), (600, 600), (0, 600)], *holes])]), ["k"]).collect()
    assert {r.k: (r.area, len(r.rings)) for r in got} == {1: (40_000 + 490_000.0, 1), 2: (360_000 - 324 * 400.0, 325)}


def test_touching_rings_stay_apart(spark):
    boxes = [(1, [[(0, 0), (2, 0), (2, 2), (0, 2)]]), (1, [[(2, 2), (4, 2), (4, 4), (2, 4)]]), (1, [[(2, 0), (4, 0), (4, 2), (2, 2)]])]
    got = P.union(table(spark, boxes), ["k"]).collect()
    assert [(r.area, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in got] == [(12.0, [[(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2)]])]
    two = P.union(table(spark, boxes[:2]), ["k"]).collect()
    assert sorted(len(r.rings[0]) for r in two) == [4, 4]


def test_simplify_keeps_borders(spark):
    rng = np.random.default_rng(3)
    line = lambda x: [(round(float(x + v), 3), y * 3.0) for y, v in enumerate(rng.uniform(-0.5, 0.5, 60))]
    lines = [line(x) for x in range(0, 60, 10)]
    rows = [(k, [[*lines[k], *reversed(lines[k + 1])]]) for k in range(5)]
    got = {r.k: r for r in P.simplify(table(spark, rows), "k", 0.4).collect()}
    assert len(got) == 5
    points = {k: {(p.x, p.y) for p in r.rings[0]} for k, r in got.items()}
    for k in range(5):
        assert len(points[k]) < 0.8 * len(rows[k][1][0]) and points[k] <= set(rows[k][1][0])
    for k in range(4):
        border = set(lines[k + 1])
        assert points[k] & border == points[k + 1] & border and len(points[k] & border) >= 2
    whole = sum(r.area for r in got.values())
    outline = P.union(table(spark, [(0, [[(p.x, p.y) for p in r.rings[0]]]) for r in got.values()]), ["k"]).collect()
    assert len(outline) == 1 and len(outline[0].rings) == 1 and outline[0].area == pytest.approx(whole, abs=1e-6)


def test_arcs_that_would_cross_stay(spark):
    """Thinning the outer figure would draw its border through the island that stands in its bay."""
    outer = [(0, 0), (10, 0), (10, 4), (5.2, 4.9), (10, 6), (10, 10), (0, 10)]
    island = [(9.0, 4.9), (11.0, 4.8), (11.0, 5.0)]
    got = P.simplify(table(spark, [(1, [outer]), (2, [island])]), "k", 6.0).collect()
    by = {r.k: r for r in got}
    assert by[2].area > 0 and by[1].area == pytest.approx(slabs([[outer]], any), abs=1e-6)


def test_figures_with_holes(spark):
    frame = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)]]
    df = table(spark, [(1, frame)]).selectExpr("*", "explode(array(1D, 5D, 9D, 12D)) as x").withColumn("y", F.lit(5.0))
    held = {r.x: (r.held, r.d2) for r in df.select("x", g.in_rings(F.col("x"), F.col("y"), F.col("rings")).alias("held"), g.figures_d2(F.col("rings"), F.array(g.box_ring(F.col("x"), F.col("y"), F.col("x") + 0.5, F.col("y") + 0.5))).alias("d2")).collect()}
    assert held == {1.0: (True, 0.0), 5.0: (False, 6.25), 9.0: (True, 0.0), 12.0: (False, 4.0)}


def test_convex_rings_go_without_noding(spark):
    """A figure with an empty ring besides is noded: both ways give the same directed edges."""
    rng = np.random.default_rng(4)
    shapes = {
        "left": [(0, 0), (4, 0), (4, 3), (0, 3)], "right": [(0, 3), (4, 3), (4, 0), (0, 0)], "point twice": [(0, 0), (4, 0), (4, 0), (0, 3)],
        "twice round": [(0, 0), (10, 7), (0, 7), (10, 0), (5, 12)], "bay": [(0, 0), (6, 0), (6, 6), (3, 1), (0, 6)], "tie": [(0, 0), (4, 4), (4, 0), (0, 4)],
        "straight point": [(0, 0), (2, 0), (4, 0), (4, 3)], "sliver": [(0, 0), (0.01, 0.001), (0.02, 0.001)], "flat": [(0, 0), (4, 0), (2, 0)],
    }
    turns = {r.k: r.t for r in table(spark, [(k, [v]) for k, v in shapes.items()], "k string").select("k", P._convex(P._on_grid(F.col("rings")[0], P.GRID)).alias("t")).collect()}
    assert {k: v for k, v in turns.items() if v} == {"left": 1, "right": -1, "point twice": 1}
    rows = [(k, [ring]) for k, ring in enumerate([*shapes.values(), *[star(rng, 0, 0, 9, n) for n in (3, 3, 3, 4, 4, 5)]])]
    edges = lambda given: sorted(map(tuple, P._oriented(table(spark, given), ["k"], "rings", 16.0, P.GRID).collect()))
    assert edges(rows) == edges([(k, [*rings, []]) for k, rings in rows])
    plain = [(k, rings) for k, rings in rows if k < 2]
    assert "Join" not in P._oriented(table(spark, plain), ["k"], "rings", 16.0, P.GRID)._jdf.queryExecution().executedPlan().toString()


def test_crossings_are_planned_apart_and_tiles_fit_short_edges(spark):
    boxes = [(x % 2, [[(x, y), (x + 3, y), (x + 3, y + 3), (x, y + 3)]]) for x in range(0, 20, 2) for y in range(0, 20, 2)]
    edges = P._upward(P.edges_of(table(spark, boxes), ["k"]), ["k"], {"w": F.lit(1)})
    assert P._fitted(edges, P.TILE, P.GRID) == 6.0 and P._fitted(edges, 2.0, P.GRID) == 2.0 and P._fitted(edges.where("false"), P.TILE, P.GRID) == P.TILE
    assert "Join" not in P.nodes_of(edges, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.area for r in P.union(table(spark, boxes), ["k"]).collect()} == {0: 21 * 21.0}
