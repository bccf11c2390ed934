"""Geodesy as Column expressions: UTM zones and projection (Krueger series), great-circle distance, planar predicates."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
# WGS84 and UTM.
A, FLAT, K0, EAST0, NORTH0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
N = FLAT / (2 - FLAT)
RECT = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def utm_zone(lon: Column) -> Column:
    """int((lon + 180) / 6) + 1, without exceptions for Norway and Svalbard."""
    return ((lon + 180) / 6).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)).cast("int") + utm_zone(lon)).cast("string"))


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(easting, northing) in the given zone."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * sqrt(N) / (1 + N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi0, eta0 = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta0, xi0
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        y = y + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
    return EAST0 + K0 * RECT * x, F.when(south, F.lit(NORTH0)).otherwise(F.lit(0.0)) + K0 * RECT * y


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lon, lat)."""
    xi = (y - F.when(south, F.lit(NORTH0)).otherwise(F.lit(0.0))) / (K0 * RECT)
    eta = (x - EAST0) / (K0 * RECT)
    xi0, eta0 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + (zone * 6 - 183), F.degrees(phi)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(a))


def bbox_area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Width times height through the centre."""
    lat, lon = (min_lat + max_lat) / 2, (min_lon + max_lon) / 2
    return haversine(lat, min_lon, lat, max_lon) * haversine(min_lat, lon, max_lat, lon) / 1e6


def drawn_area_m2(ring: Column) -> Column:
    """The area that a drawn ring (array of structs lon and lat) is shown with: each side counts as a strip up to the pole whose height is the mean of its ends' sines. On the equatorial radius; a side goes the shorter way around."""
    return F.abs(_over_sides(ring, lambda a, b, turn: turn * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))))) * (A * A / 2)


def spherical_area_m2(ring: Column) -> Column:
    """The area within a ring whose sides are great circles, on a sphere of the mean radius: the signed excess of the triangles of each side and the north pole. Of the two parts of the sphere the smaller."""

    def excess(a: Column, b: Column, turn: Column) -> Column:
        p, q = F.tan(F.radians(90 - a["lat"]) / 2), F.tan(F.radians(90 - b["lat"]) / 2)
        return 2 * F.atan2(p * q * F.sin(turn), 1 + p * q * F.cos(turn))

    total = F.abs(_over_sides(ring, excess))
    return F.least(total, F.abs(4 * pi - total)) * (RADIUS_M * RADIUS_M)


def _over_sides(ring: Column, f) -> Column:
    """The sum of f(a, b, turn) over the sides of a ring; turn: from a to b in radians, the shorter way around. 0 for fewer than three vertices."""
    turn = lambda a, b: F.radians(F.pmod(b["lon"] - a["lon"] + 540, F.lit(360.0)) - 180)
    total = F.aggregate(F.transform(_edges(ring), lambda e: f(e["a"], e["b"], turn(e["a"], e["b"]))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(ring) >= 3, total).otherwise(0.0)


def _edges(ring: Column) -> Column:
    """Consecutive vertices (a, b) of a ring, closed if it is open. A vertex is a struct of x and y."""
    n = F.size(ring)
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: a point on the edge is outside. Even-odd rule, so a self-crossing ring is cut by parity."""
    cross = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    on = F.exists(_edges(ring), lambda e: (cross(e["a"], e["b"]) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
    hits = F.size(F.filter(_edges(ring), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])))
    return ~on & (hits % 2 == 1)


def in_selection(x: Column, y: Column, ring: Column, turn: Column | None = None) -> Column:
    """Strictly inside a drawn ring, which may cross itself: where the ring winds around in the direction in which it passes its highest corner. So of a bow-tie the lobe with the highest corner counts, and what is wound around twice counts once.

    The same as `in_ring` for rings whose sides don't cross. Points on a side are outside. turn: that of `turn_at_top`, if it is known.
    """
    cross = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    sides = _edges(ring)
    on = F.exists(sides, lambda e: (cross(e["a"], e["b"]) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
    up = F.size(F.filter(sides, lambda e: (e["a"]["y"] <= y) & (e["b"]["y"] > y) & (cross(e["a"], e["b"]) > 0)))
    down = F.size(F.filter(sides, lambda e: (e["b"]["y"] <= y) & (e["a"]["y"] > y) & (cross(e["a"], e["b"]) < 0)))
    return ~on & (F.signum((up - down).cast("double")) == F.signum(turn_at_top(ring) if turn is None else turn))


def _distinct(ring: Column) -> Column:
    """A ring without vertices that repeat the one before; open."""
    return F.transform(F.filter(_edges(ring), lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"])), lambda e: e["a"])


def _one_way(ring: Column) -> Column:
    """The sides of a ring that are not passed the other way as well."""
    sides = F.filter(_edges(ring), lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))
    return F.array_except(sides, F.transform(sides, lambda e: F.struct(e["b"].alias("a"), e["a"].alias("b"))))


def turn_at_top(ring: Column) -> Column:
    """Over 0 if the ring turns left at its highest corner (of several the one with the greatest x), under 0 if right. Spikes don't count; where one hides the turn, the sign of the area between all sides does."""
    sides = _one_way(ring)
    top = F.array_max(F.transform(sides, lambda e: F.struct(e["a"]["y"].alias("y"), e["a"]["x"].alias("x"))))
    at = lambda v: (v["x"] == top["x"]) & (v["y"] == top["y"])
    before, after = F.get(F.filter(sides, lambda e: at(e["b"])), F.lit(0))["a"], F.get(F.filter(sides, lambda e: at(e["a"])), F.lit(0))["b"]
    turn = (top["x"] - before["x"]) * (after["y"] - top["y"]) - (top["y"] - before["y"]) * (after["x"] - top["x"])
    area = F.aggregate(F.transform(sides, lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]), F.lit(0.0), lambda s, x: s + x)
    return F.when(turn != 0, turn).otherwise(area)


def no_area(ring: Column) -> Column:
    """Whether a ring encloses nothing: fewer than three places, all on one line, or each side passed in both directions."""
    v = F.array_distinct(_distinct(ring))
    a, b = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    flat = F.forall(v, lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) == 0)
    return F.coalesce((F.size(v) < 3) | flat | (F.size(_one_way(ring)) == 0), F.lit(True))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment, which may be a point."""
    dx, dy = bx - ax, by - ay
    d2 = dx * dx + dy * dy
    t = F.when(d2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / d2)))
    return F.sqrt(F.pow(x - ax - t * dx, 2) + F.pow(y - ay - t * dy, 2))


def path_distance(x: Column, y: Column, path: Column) -> Column:
    """Distance of a point to a line of vertices (array of structs of x and y), of two or more."""
    n = F.size(path)
    pairs = F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), lambda a, b: segment_distance(x, y, a["x"], a["y"], b["x"], b["y"]))
    return F.array_min(pairs)


def simple_ring(ring: Column) -> Column:
    """No two sides of a ring cross; sides that only share a corner do not count. The first and last vertex may be the same."""
    cross = lambda o, a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])
    sides = F.filter(_edges(ring), lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))
    opposite = lambda u, v: (F.signum(u) * F.signum(v)) < 0
    hit = lambda s, t: opposite(cross(s["a"], s["b"], t["a"]), cross(s["a"], s["b"], t["b"])) & opposite(cross(t["a"], t["b"], s["a"]), cross(t["a"], t["b"], s["b"]))
    return ~F.exists(sides, lambda s: F.exists(sides, lambda t: hit(s, t)))
