"""Distances, polylines and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: Metres a degree of the planes in use.
PLANE_X = 111320.0
PLANE_Y = 110540.0
COS_CAMPUS = 0.7735
COS_PLANE = math.cos(math.radians(39.329))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a, b = F.sin((p2 - p1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    h = a * a + F.cos(p1) * F.cos(p2) * b * b
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def plane_fixed(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dx, dy = (lng2 - lng1) * PLANE_X * COS_CAMPUS, (lat2 - lat1) * PLANE_Y
    return F.sqrt(dx * dx + dy * dy)


def plane_campus(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dx, dy = (lng2 - lng1) * (PLANE_X * COS_PLANE), (lat2 - lat1) * PLANE_Y
    return F.sqrt(dx * dx + dy * dy)


def plane_local(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The plane at the first point, as many metres a degree on both axes."""
    dx, dy = (lng2 - lng1) * PLANE_X * F.cos(F.radians(lat1)), (lat2 - lat1) * PLANE_X
    return F.sqrt(dx * dx + dy * dy)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def turn(before: Column, after: Column) -> Column:
    """Signed difference of two bearings, from -180 up to 180."""
    d = after - before
    return F.when(d > 180, d - 360.0).when(d <= -180, d + 360.0).otherwise(d)


# Points below are structs (x, y), lines and rings arrays of them.


def _sides(line: Column) -> Column:
    """Array of (a, b) of adjacent points."""
    n = F.size(line)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
    )


def line_length(line: Column) -> Column:
    step = lambda s: F.sqrt(
        ((s["b"]["x"] - s["a"]["x"]) * (PLANE_X * COS_PLANE)) * ((s["b"]["x"] - s["a"]["x"]) * (PLANE_X * COS_PLANE))
        + ((s["b"]["y"] - s["a"]["y"]) * PLANE_Y) * ((s["b"]["y"] - s["a"]["y"]) * PLANE_Y)
    )
    return F.aggregate(F.coalesce(_sides(line), F.array()), F.lit(0.0), lambda t, s: t + step(s))


def centroid(ring: Column) -> Column:
    """Mean of the vertices; a closing vertex counts twice."""
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[c]) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def signed_area(ring: Column) -> Column:
    twice = F.aggregate(
        F.coalesce(_sides(ring), F.array()), F.lit(0.0), lambda t, s: t + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    )
    return twice / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; the ring closes itself."""
    closed = F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
    crosses = lambda s: (
        ((s["a"]["y"] > y) != (s["b"]["y"] > y))
        & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"])
    )
    return F.aggregate(_sides(closed), F.lit(False), lambda odd, s: F.when(F.coalesce(crosses(s), F.lit(False)), ~odd).otherwise(odd))


def _to_side(x: Column, y: Column, s: Column, mx: float, my: float) -> Column:
    """Nearest point of a side: distance in metres and its place."""
    dx, dy = (s["b"]["x"] - s["a"]["x"]) * mx, (s["b"]["y"] - s["a"]["y"]) * my
    px, py = (x - s["a"]["x"]) * mx, (y - s["a"]["y"]) * my
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.nullif(square, F.lit(0.0)))))
    ex, ey = px - t * dx, py - t * dy
    return F.struct(
        F.sqrt(ex * ex + ey * ey).alias("d"),
        (s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"),
        (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"),
    )


def nearest_on_line(x: Column, y: Column, line: Column) -> Column:
    """(d, k, x, y): distance to a line, the side that is nearest (the first of equals), and the point."""
    best = lambda s, k: F.struct(
        _to_side(x, y, s, PLANE_X * COS_PLANE, PLANE_Y)["d"].alias("d"),
        k.alias("k"),
        _to_side(x, y, s, PLANE_X * COS_PLANE, PLANE_Y)["x"].alias("x"),
        _to_side(x, y, s, PLANE_X * COS_PLANE, PLANE_Y)["y"].alias("y"),
    )
    return F.array_min(F.transform(_sides(line), best))


def lambert_inverse(x_ft: Column, y_ft: Column) -> Column:
    """State-plane feet to (lng, lat): inverse Lambert conformal conic on GRS 80, twelve fixed-point steps."""
    # The Maryland zone of NAD 83 and the survey foot.
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    phi1, phi2, phi0, lam0 = (math.radians(v) for v in (38.3, 39.45, 37 + 2 / 3, -77.0))
    false_e, foot = 400000.0, 1200 / 3937
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(phi1)) - math.log(m(phi2))) / (math.log(t(phi1)) - math.log(t(phi2)))
    scale = m(phi1) / (n * t(phi1) ** n)
    rho0 = a * scale * t(phi0) ** n
    dx, dy = x_ft * foot - false_e, F.lit(rho0) - y_ft * foot
    rho = F.sqrt(dx * dx + dy * dy)
    tt = F.pow(rho / (a * scale), F.lit(1 / n))
    phi = F.lit(math.pi / 2) - 2 * F.atan(tt)
    steps = F.sequence(F.lit(1), F.lit(12))
    phi = F.aggregate(
        steps,
        phi,
        lambda p, _: F.lit(math.pi / 2) - 2 * F.atan(tt * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))),
    )
    lam = F.atan2(dx, dy) / n + lam0
    return F.struct(F.degrees(lam).alias("lng"), F.degrees(phi).alias("lat"))


def edge_line(geometry: Column, back: Column, a_lng: Column, a_lat: Column, b_lng: Column, b_lat: Column) -> Column:
    """An edge's drawn line as [lng, lat] points in travel order; without two points, its ends.

    ``geometry``: JSON text of pairs; pairs written latitude first, as the region's values show, are turned.  Beyond the region a
    pair is turned if, read latitude first, it lies nearer to the edge's start.
    """
    given = F.filter(F.coalesce(F.from_json(geometry, "array<array<double>>"), F.array()), lambda p: F.size(p) == 2)
    in_region = lambda p: (p[0] > 38) & (p[0] < 41) & (p[1] > -78) & (p[1] < -75)
    off = lambda p, x, y: F.abs(p[0] - x) + F.abs(p[1] - y)
    turned = F.transform(given, lambda p: F.when(in_region(p) | (off(p, a_lat, a_lng) < off(p, a_lng, a_lat)), F.array(p[1], p[0])).otherwise(p))
    line = F.when(back, F.reverse(turned)).otherwise(turned)
    return F.when(F.size(given) >= 2, line).otherwise(F.array(F.array(a_lng, a_lat), F.array(b_lng, b_lat)))


def joined_to_doors(line: Column, start: Column, end: Column, metres: float = 8.0) -> Column:
    """A drawn line of (x, y) points, drawn on to a door from which it ends more than ``metres`` away."""
    far = lambda p, q: haversine(p["y"], p["x"], q["y"], q["x"]) > metres
    none = F.slice(line, F.lit(1), F.lit(0))
    first, last = F.get(line, F.lit(0)), F.element_at(line, -1)
    return F.concat(F.when(far(first, start), F.array(start)).otherwise(none), line, F.when(far(last, end), F.array(end)).otherwise(none))
