"""Geometry as column expressions: rings, boxes, segments and projections, all inside code generation.

A ring is ``array<struct<x:double,y:double>>``, not closed. Boxes are four columns. Rings that an expression needs more than once
are bound (``binding.let``), since a ring may itself be a long expression and steps are nested.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, isfinite, log, pi, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# The GRS 80 ellipsoid and the Lambert conic zone of EPSG:32129, in metres and degrees.
SEMI_MAJOR = 6_378_137.0
INVERSE_FLATTENING = 298.257222101
FALSE_EASTING, FALSE_NORTHING = 600_000.0, 0.0
LATITUDE_ORIGIN, CENTRAL_MERIDIAN = 39 + 20 / 60, -(77 + 45 / 60)
PARALLEL_1, PARALLEL_2 = 39 + 56 / 60, 40 + 58 / 60
# The street grid's north as a unit vector.
NORTH_EAST, NORTH_NORTH = 0.13555646, 0.9907696
US_SURVEY_FOOT = 0.3048006096012192
#: World Geodetic System 1984, for earth-centred coordinates.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def _eccentricity() -> float:
    f = 1 / INVERSE_FLATTENING
    return sqrt(f * (2 - f))


def _cone() -> tuple[float, float, float]:
    """Cone constant, scale and radius at the origin of the conic zone."""
    e = _eccentricity()
    m = lambda lat: cos(radians(lat)) / sqrt(1 - (e * sin(radians(lat))) ** 2)
    t = lambda lat: tan(pi / 4 - radians(lat) / 2) / ((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) ** (e / 2)
    n = (log(m(PARALLEL_1)) - log(m(PARALLEL_2))) / (log(t(PARALLEL_1)) - log(t(PARALLEL_2)))
    f = m(PARALLEL_1) / (n * t(PARALLEL_1) ** n)
    return n, SEMI_MAJOR * f, SEMI_MAJOR * f * t(LATITUDE_ORIGIN) ** n


CONE, RADIUS_SCALE, RADIUS_ORIGIN = _cone()
ECCENTRICITY = _eccentricity()


def lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to metres east and north."""
    phi = F.radians(lat)
    es = F.sin(phi) * ECCENTRICITY
    t = F.tan(F.lit(pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(ECCENTRICITY / 2))
    rho = F.lit(RADIUS_SCALE) * F.pow(t, F.lit(CONE))
    theta = F.radians(lon - CENTRAL_MERIDIAN) * CONE
    return rho * F.sin(theta) + FALSE_EASTING, F.lit(RADIUS_ORIGIN + FALSE_NORTHING) - rho * F.cos(theta)


def lambert_inverse(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """Metres east and north to longitude and latitude in degrees. The latitude solves an equation in itself; each round brings it
    nearer by a factor of some hundreds."""
    east, down = x - FALSE_EASTING, F.lit(RADIUS_ORIGIN + FALSE_NORTHING) - y
    t = F.pow(F.hypot(east, down) / RADIUS_SCALE, F.lit(1 / CONE))
    start = F.lit(pi / 2) - F.atan(t) * 2

    def nearer(phi: Column, _: Column) -> Column:
        es = F.sin(phi) * ECCENTRICITY
        return F.lit(pi / 2) - F.atan(t * F.pow((1 - es) / (1 + es), F.lit(ECCENTRICITY / 2))) * 2

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, nearer)
    return F.degrees(F.atan2(east, down) / CONE) + CENTRAL_MERIDIAN, F.degrees(phi)


VIEWS = ("SE", "SW", "NW", "NE")


def _turn(view: Column, east: Column, north: Column, back: bool = False) -> tuple[Column, Column]:
    """Axes of a view; ``back`` turns the other way."""
    a, b = (-north, east) if back else (north, -east)
    c, d = (north, -east) if back else (-north, east)
    pick = lambda se, sw, nw, ne: F.when(view == "SE", se).when(view == "SW", sw).when(view == "NW", nw).when(view == "NE", ne)
    return pick(east, a, -east, c), pick(north, b, -north, d)


def isometric(view: Column, x: Column, y: Column, height: Column) -> tuple[Column, Column]:
    """Screen position of a point in one of four views of the street grid."""
    east, north = x * NORTH_NORTH - y * NORTH_EAST, x * NORTH_EAST + y * NORTH_NORTH
    e, n = _turn(view, east, north)
    return e + n, (e - n) * 0.5 - height


def isometric_inverse(view: Column, sx: Column, sy: Column) -> tuple[Column, Column]:
    """Ground position of a screen point. The grid's north is a unit vector only to seven digits, as in ``isometric``."""
    e, n = (sx + sy * 2) * 0.5, (sx - sy * 2) * 0.5
    east, north = _turn(view, e, n, back=True)
    return east * NORTH_NORTH + north * NORTH_EAST, north * NORTH_NORTH - east * NORTH_EAST


@dataclass(frozen=True)
class Camera:
    """An angle in degrees and the scales of width, ground and height, each between a half and two."""

    angle: float = 0.0
    x_scale: float = 1.0
    ground_scale: float = 1.0
    height_scale: float = 1.0

    def __post_init__(self):
        if not all(isfinite(s) and 0.5 <= s <= 2 for s in (self.x_scale, self.ground_scale, self.height_scale)) or not isfinite(self.angle):
            raise ValueError("a camera's scales lie between 0.5 and 2, and its angle is finite")

    def project(self, x: Column, y: Column, height: Column) -> tuple[Column, Column]:
        """Screen position of a point, the street grid turned by the angle."""
        c, s = cos(radians(self.angle)), sin(radians(self.angle))
        east, north = x * NORTH_NORTH - y * NORTH_EAST, x * NORTH_EAST + y * NORTH_NORTH
        e, n = east * c + north * s, north * c - east * s
        return (e + n) * self.x_scale, (e - n) * (0.5 * self.ground_scale) - height * self.height_scale

    def ground(self, sx: Column, sy: Column) -> tuple[Column, Column]:
        """The place on the ground (height 0) that a screen position shows. The grid's north is a unit vector only to seven
        digits, so its length is divided out."""
        c, s = cos(radians(self.angle)), sin(radians(self.angle))
        half, down = sx / (2 * self.x_scale), sy / self.ground_scale
        e, n = half + down, half - down
        east, north = e * c - n * s, e * s + n * c
        square = NORTH_EAST**2 + NORTH_NORTH**2
        return (east * NORTH_NORTH + north * NORTH_EAST) / square, (north * NORTH_NORTH - east * NORTH_EAST) / square


def view_depth(view: Column, x: Column, y: Column, height: Column) -> Column:
    return isometric(view, x, y, F.lit(0.0))[1] + height


def earth_centred(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """x, y, z of a place above the ellipsoid, from its parametric (reduced) latitude."""
    polar = WGS84_A * (1 - WGS84_F)
    phi, lam = F.radians(lat), F.radians(lon)
    reduced = F.atan2(polar * F.sin(phi), WGS84_A * F.cos(phi))
    out = WGS84_A * F.cos(reduced) + height * F.cos(phi)
    return out * F.cos(lam), out * F.sin(lam), polar * F.sin(reduced) + height * F.sin(phi)


def from_earth_centred(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height by Bowring's closed form (1976), within a nanodegree near the ground."""
    polar = WGS84_A * (1 - WGS84_F)
    e2, second = WGS84_F * (2 - WGS84_F), (WGS84_A / polar) ** 2 - 1
    out = F.hypot(x, y)
    reduced = F.atan2(z * WGS84_A, out * polar)
    phi = F.atan2(z + second * polar * F.pow(F.sin(reduced), 3), out - e2 * WGS84_A * F.pow(F.cos(reduced), 3))
    height = out * F.cos(phi) + z * F.sin(phi) - WGS84_A * F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), height


def tangent_offset(lon: float, lat: float, east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of offsets in metres on the plane that touches the ellipsoid at a place."""
    e2 = WGS84_F * (2 - WGS84_F)
    w = 1 - e2 * sin(radians(lat)) ** 2
    prime, meridian = WGS84_A / sqrt(w), WGS84_A * (1 - e2) / w**1.5
    return F.lit(lon) + F.degrees(east / (prime * cos(radians(lat)))), F.lit(lat) + F.degrees(north / meridian)


# rings -----------------------------------------------------------------------------------------------------------------


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def ring_next(ring: Column) -> Column:
    """The ring turned by one: each point's successor."""
    return let(ring, lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)))


def _around(ring: Column, use) -> Column:
    """``use`` of each point and its successor."""
    return let(ring, lambda r: F.zip_with(r, ring_next(r), use))


def ring_edges(ring: Column) -> Column:
    """Edges as structs a, b; edges of no length are left out."""
    edges = _around(ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(edges, lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))


def signed_area(ring: Column) -> Column:
    """Shoelace area about the first point, so that large coordinates lose no digits."""

    def terms(r: Column) -> Column:
        return let(r[0], lambda o: _around(r, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])))

    return F.aggregate(let(ring, terms), F.lit(0.0), lambda s, v: s + v) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_box(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def rings_box(rings: Column) -> dict[str, Column]:
    """The box of all rings of a figure."""
    return ring_box(F.flatten(rings))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule, half open: left and lower edges are inside, right and upper are not."""

    def crossed(p: Column) -> Column:
        def crosses(a: Column, b: Column) -> Column:
            over = (a["y"] > p["y"]) != (b["y"] > p["y"])
            at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.when(over, b["y"] - a["y"]) + a["x"]
            return F.when(over & (p["x"] < at), F.lit(1)).otherwise(F.lit(0))

        return _around(ring, crosses)

    return F.aggregate(let(F.struct(x.alias("x"), y.alias("y")), crossed), F.lit(0), lambda s, v: s + v) % 2 == 1


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Inside an odd number of a figure's rings: in its shell and in none of its holes."""
    return F.aggregate(F.transform(rings, lambda ring: F.when(in_ring(x, y, ring), 1).otherwise(0)), F.lit(0), lambda s, v: s + v) % 2 == 1


def point_segment_d2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length != 0, length))))
    ex, ey = px - (ax + dx * t), py - (ay + dy * t)
    return ex * ex + ey * ey


def _near_d2(p: Column, a: Column, b: Column) -> Column:
    """``point_segment_d2`` of points inside a lambda, where nothing is computed once unless it is bound."""

    def placed(d: Column) -> Column:
        length = d["x"] * d["x"] + d["y"] * d["y"]
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * d["x"] + (p["y"] - a["y"]) * d["y"]) / F.when(length != 0, length))))
        away = let(t, lambda t: F.struct((p["x"] - (a["x"] + d["x"] * t)).alias("x"), (p["y"] - (a["y"] + d["y"] * t)).alias("y")))
        return let(away, lambda e: e["x"] * e["x"] + e["y"] * e["y"])

    return let(F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")), placed)


def ring_d2(x: Column, y: Column, ring: Column) -> Column:
    """Squared distance from a point to the nearest edge of a ring."""
    return let(point(x, y), lambda p: F.array_min(F.transform(ring_edges(ring), lambda e: _near_d2(p, e["a"], e["b"]))))


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def segments_d2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Squared distance between segments ab and cd: 0 where they cross properly, else the nearest end."""
    cross = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
    ends = [(a, c, d), (b, c, d), (c, a, b), (d, a, b)]
    near = F.least(*[_near_d2(p, q, r) for p, q, r in ends])
    return F.when(cross, F.lit(0.0)).otherwise(near)


def rings_d2(left: Column, right: Column) -> Column:
    """Squared distance between two rings: 0 if they meet or one holds the other."""

    def apart(l: Column, r: Column) -> Column:
        inside = in_ring(l[0]["x"], l[0]["y"], r) | in_ring(r[0]["x"], r[0]["y"], l)
        return F.when(inside, F.lit(0.0)).otherwise(_edges_d2(ring_edges(l), ring_edges(r)))

    return let(left, lambda l: let(right, lambda r: apart(l, r)))


def _edges_d2(left: Column, right: Column) -> Column:
    return let(right, lambda re: F.array_min(F.transform(left, lambda e: F.array_min(F.transform(re, lambda f: segments_d2(e["a"], e["b"], f["a"], f["b"]))))))


def outward_normal(ring: Column, a: Column, b: Column, reach: float) -> Column:
    """Unit normal (x, y) of the ring's edge from a to b that points outwards, by a probe on either side of its middle; null where
    the edge has no length or both probes lie on the same side of the ring."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    mx, my = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2

    def facing(n: Column) -> Column:
        sides = F.struct(in_ring(mx + n["x"] * reach, my + n["y"] * reach, ring).alias("left"), in_ring(mx - n["x"] * reach, my - n["y"] * reach, ring).alias("right"))
        return let(sides, lambda s: F.when(s["left"] & ~s["right"], point(-n["x"], -n["y"])).when(s["right"] & ~s["left"], point(n["x"], n["y"])))

    return let(let(F.nullif(F.hypot(dx, dy), F.lit(0.0)), lambda length: point(-dy / length, dx / length)), facing)


def rectangle_sides(ring: Column) -> Column:
    """The four sides' lengths of a ring that is nearly a rectangle, else null: corners within 0.16 of square (as a cosine), opposite
    sides within 0.985 of parallel and within 0.12 of equal length."""

    def sides(edges: Column, length: Column) -> Column:
        dot = lambda k, m: F.abs(edges[k]["x"] * edges[m]["x"] + edges[k]["y"] * edges[m]["y"]) / F.nullif(length[k] * length[m], F.lit(0.0))
        alike = lambda k, m: F.abs(length[k] - length[m]) <= F.greatest(length[k], length[m]) * 0.12
        square = (dot(0, 1) <= 0.16) & (dot(1, 2) <= 0.16) & (dot(2, 3) <= 0.16) & (dot(3, 0) <= 0.16)
        fine = square & (dot(0, 2) >= 0.985) & (dot(1, 3) >= 0.985) & alike(0, 2) & alike(1, 3)
        return F.when(F.size(edges) == 4, F.when(fine, length))

    edges = _around(ring, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    return let(edges, lambda edges: let(F.transform(edges, lambda e: F.hypot(e["x"], e["y"])), lambda length: sides(edges, length)))


def figures_d2(left: Column, right: Column) -> Column:
    """Squared distance between two figures, arrays of rings: 0 if they meet or one holds the other outside its holes."""
    edges = lambda rings: F.flatten(F.transform(rings, ring_edges))
    corner = lambda rings: rings[0][0]

    def apart(l: Column, r: Column) -> Column:
        inside = in_rings(corner(l)["x"], corner(l)["y"], r) | in_rings(corner(r)["x"], corner(r)["y"], l)
        return F.when(inside, F.lit(0.0)).otherwise(_edges_d2(edges(l), edges(r)))

    return let(left, lambda l: let(right, lambda r: apart(l, r)))


def clip_half(ring: Column, inside, cut) -> Column:
    """One step of Sutherland and Hodgman's clip: the part of a ring on one side of a line."""
    pairs = _around(ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.transform(
        pairs,
        lambda e: F.when(inside(e["a"]) & inside(e["b"]), F.array(e["b"]))
        .when(inside(e["a"]), F.array(cut(e["a"], e["b"])))
        .when(inside(e["b"]), F.array(cut(e["a"], e["b"]), e["b"]))
        .otherwise(F.slice(F.array(e["a"]), 1, 0)),
    )
    return F.flatten(kept)


def clip_to_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a convex ring inside a box (empty if none)."""

    def at_x(x: Column):
        return lambda a, b: point(x, a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)))

    def at_y(y: Column):
        return lambda a, b: point(a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)), y)

    out = clip_half(ring, lambda p: p["x"] >= x0, at_x(x0))
    out = clip_half(out, lambda p: p["x"] <= x1, at_x(x1))
    out = clip_half(out, lambda p: p["y"] >= y0, at_y(y0))
    return clip_half(out, lambda p: p["y"] <= y1, at_y(y1))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Undirected angle of two directions, 0 to 90 degrees."""
    turn = F.pmod(F.degrees(F.atan2(ay, ax) - F.atan2(by, bx)), F.lit(180.0))
    return F.least(turn, F.lit(180.0) - turn)


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Z-order code: the bits of x and y in turn, x first from below."""
    parts = []
    for k in range(bits):
        parts += [F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 2 * k), F.shiftleft(F.shiftright(y.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 2 * k + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


