"""Geometry as Column expressions: no UDFs, so everything stays inside code generation.

A point is two double columns (degrees); a line is ARRAY<STRUCT<lng,lat[,z]>>; a ring
is the same, closed or not. Distances are metres on a sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii and the metres within which a kind of place counts as reached.
EARTH_M = 6_371_000.0
EARTH_MEAN_M = 6_371_008.8
DEGREE_M = 111_320.0
REACH_M = {"summit": 30, "trailhead": 100, "waterfall": 200, "viewpoint": 200, "campsite": 100}
REACH_DEFAULT_M = 50
MAX_REACH_M = 200


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def haversine_m(lat1, lng1, lat2, lng2, radius: float = EARTH_M) -> Column:
    """Great-circle distance, asin form."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_atan2_m(lat1, lng1, lat2, lng2, radius: float = EARTH_M) -> Column:
    """Great-circle distance, atan2 form."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def wrap_lng(delta) -> Column:
    """A difference of longitudes brought into -180 (inclusive) to 180."""
    return F.pmod(_c(delta) + 180, F.lit(360.0)) - 180


def haversine_wrapped_m(lat1, lng1, lat2, lng2) -> Column:
    return haversine_m(lat1, F.lit(0.0), lat2, wrap_lng(_c(lng2) - _c(lng1)))


def equirectangular_m(lat1, lng1, lat2, lng2) -> Column:
    """Planar metres at the mean latitude; for short distances."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    dx = (lng2 - lng1) * DEGREE_M * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * DEGREE_M
    return F.sqrt(dx * dx + dy * dy)


def reach_radius_m(features) -> Column:
    """Metres within which a place counts as reached, by its features; earlier kinds win."""
    out = F.lit(REACH_DEFAULT_M)
    for k, v in reversed(REACH_M.items()):
        out = F.when(F.array_contains(features, k), v).otherwise(out)
    return out.cast("double")


def horizon_m(eye, elevation) -> Column:
    """How far a height can be seen from an eye height."""
    return 4123 * (F.sqrt(F.greatest(_c(eye), F.lit(0.0))) + F.sqrt(F.greatest(_c(elevation), F.lit(0.0))))


def apparent_rank(prominence, distance) -> Column:
    return F.coalesce(_c(prominence), F.lit(100.0)) / F.greatest(_c(distance), F.lit(500.0))


def in_box(lat, lng, south, west, north, east) -> Column:
    """Four range predicates, so Parquet statistics prune; a box over the dateline has west > east."""
    across = _c(lng).between(west, east) if west <= east else (_c(lng) >= west) | (_c(lng) <= east)
    return _c(lat).between(south, north) & across


def boxes_overlap(a: dict, b: dict) -> Column:
    """Two boxes of columns (south, west, north, east) share a point."""
    return (_c(a["west"]) <= _c(b["east"])) & (_c(a["east"]) >= _c(b["west"])) & (_c(a["south"]) <= _c(b["north"])) & (_c(a["north"]) >= _c(b["south"]))


def clamp_viewport(south, west, north, east, most: float = 20.0) -> list[Column]:
    """A viewport no larger than `most` degrees a side, around its centre."""
    south, west, north, east = map(_c, (south, west, north, east))
    h, w = F.least(north - south, F.lit(most)) / 2, F.least(east - west, F.lit(most)) / 2
    y, x = (south + north) / 2, (west + east) / 2
    return [(y - h).alias("south"), (x - w).alias("west"), (y + h).alias("north"), (x + w).alias("east")]


def cell(lat, lng, size_m: float, max_lat: float = 80.0) -> tuple[Column, Column]:
    """Grid row and column of a point; cells are at least size_m wide up to max_lat."""
    dy = size_m / 111_000.0
    dx = dy / max(math.cos(math.radians(max_lat)), 0.02)
    return F.floor(_c(lat) / dy).cast("long"), F.floor(_c(lng) / dx).cast("long")


def snap_cell(lat, lng, step: float = 0.03) -> Column:
    """Key row:column of the nearest grid node; halves go up, as in a browser's rounding."""
    r = F.floor(_c(lat) / step + 0.5).cast("long")
    c = F.floor(_c(lng) / step + 0.5).cast("long")
    return F.concat_ws(":", r.cast("string"), c.cast("string"))


def tile(lat, lng, zoom: int) -> Column:
    """Web-mercator tile and pixel (256 a side) of a point."""
    n = float(1 << zoom)
    x = (_c(lng) + 180) / 360 * n
    y = (1 - F.log(F.tan(F.radians(_c(lat))) + 1 / F.cos(F.radians(_c(lat)))) / math.pi) / 2 * n
    px = F.least(F.floor((x - F.floor(x)) * 256), F.lit(255)).cast("int")
    py = F.least(F.floor((y - F.floor(y)) * 256), F.lit(255)).cast("int")
    return F.struct(F.lit(zoom).alias("z"), F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y"), px.alias("px"), py.alias("py"))


def terrain_m(r, g, b) -> Column:
    """Metres of an RGB terrain pixel."""
    return _c(r) * 256 + _c(g) + _c(b) / 256 - 32768


def edges(line) -> Column:
    """Array of (a, b) for each pair of neighbouring vertices."""
    line = F.col(line) if isinstance(line, str) else line
    rest = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, rest), F.slice(line, 2, rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segment_position(lat, lng, a: Column, b: Column) -> tuple[Column, Column]:
    """(fraction along a-b of the nearest point, metres to it), planar around the point."""
    kx = DEGREE_M * F.cos(F.radians(_c(lat)))
    ax, ay = (a["lng"] - _c(lng)) * kx, (a["lat"] - _c(lat)) * DEGREE_M
    bx, by = (b["lng"] - _c(lng)) * kx, (b["lat"] - _c(lat)) * DEGREE_M
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / sq))).otherwise(F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return t, F.sqrt(x * x + y * y)


def line_distance_m(lat, lng, line) -> Column:
    """Metres from a point to a line; a single vertex is a point."""
    per_edge = F.transform(edges(line), lambda e: segment_position(lat, lng, e["a"], e["b"])[1])
    one = F.element_at(F.col(line) if isinstance(line, str) else line, 1)
    return F.coalesce(F.array_min(per_edge), equirectangular_m(lat, lng, one["lat"], one["lng"]))


def line_length_m(line) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda s, e: s + haversine_m(e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"]))


def locate_fraction(lat, lng, line) -> Column:
    """Share of the line's length before the point nearest to (lat, lng); the first of equals."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"))

    def step(s, e):
        t, d = segment_position(lat, lng, e["a"], e["b"])
        n = equirectangular_m(e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"])
        return F.struct((s["done"] + n).alias("done"), F.least(s["best"], d).alias("best"), F.when(d < s["best"], s["done"] + t * n).otherwise(s["at"]).alias("at"))

    return F.aggregate(edges(line), start, step, lambda s: F.when(s["done"] > 0, s["at"] / s["done"]).otherwise(0.0))


def in_ring(lat, lng, ring) -> Column:
    """Even-odd ray cast; the ring may be open or closed."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    closed = F.concat(ring, F.slice(ring, 1, 1))
    crosses = F.aggregate(
        edges(closed),
        F.lit(0),
        lambda s, e: s + F.when(((e["a"]["lat"] > _c(lat)) != (e["b"]["lat"] > _c(lat))) & (_c(lng) < (e["b"]["lng"] - e["a"]["lng"]) * (_c(lat) - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lng"]), 1).otherwise(0),
    )
    return crosses % 2 == 1


def in_polygon(lat, lng, rings) -> Column:
    """Inside the first ring and in none of the others, which are holes."""
    rings = F.col(rings) if isinstance(rings, str) else rings
    holes = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: in_ring(lat, lng, r))
    return in_ring(lat, lng, F.element_at(rings, 1)) & ~holes


def polygon_distance_m(lat, lng, rings) -> Column:
    """0 inside, else metres to the nearest edge of any ring."""
    rings = F.col(rings) if isinstance(rings, str) else rings
    edge = F.array_min(F.transform(rings, lambda r: line_distance_m(lat, lng, F.concat(r, F.slice(r, 1, 1)))))
    return F.when(in_polygon(lat, lng, rings), 0.0).otherwise(edge)


def ring_area_m2(ring) -> Column:
    """Signed area by the shoelace rule in local metres; counter-clockwise is positive."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    first = F.element_at(ring, 1)
    k = F.cos(F.radians(first["lat"]))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.aggregate(
        edges(closed),
        F.lit(0.0),
        lambda s, e: s + ((e["a"]["lng"] - first["lng"]) * (e["b"]["lat"] - first["lat"]) - (e["b"]["lng"] - first["lng"]) * (e["a"]["lat"] - first["lat"])) * k * DEGREE_M * DEGREE_M / 2,
    )
