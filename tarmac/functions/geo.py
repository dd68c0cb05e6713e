"""Geometry on longitude and latitude: a sphere of radius 6371.0 km, web tiles, bearings.

Distances differ from a spheroid's by up to about half a percent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Metres of one degree of latitude, rounded down so that a pad never falls short.
_DEGREE_M = 110_000.0
_STEEPEST_LATITUDE = 60.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_KM * 1000) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: Metres of one degree of latitude on the sphere.
METRES_PER_DEGREE = math.radians(1.0) * EARTH_KM * 1000


def point_piece_m(lon: Column, lat: Column, a: Column, b: Column) -> Column:
    """Metres from a point to the straight piece between two points (``lon``, ``lat``), on the plane that touches at the point."""
    wide = F.cos(F.radians(lat)) * METRES_PER_DEGREE
    ax, ay, bx, by = (a["lon"] - lon) * wide, (a["lat"] - lat) * METRES_PER_DEGREE, (b["lon"] - lon) * wide, (b["lat"] - lat) * METRES_PER_DEGREE
    dx, dy = bx - ax, by - ay
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def pieces_m(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Metres between two straight pieces; 0 where they cross."""
    side = lambda p, q, r: F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))
    crossed = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    ends = F.least(*[point_piece_m(p["lon"], p["lat"], q, r) for p, q, r in ((a, c, d), (b, c, d), (c, a, b), (d, a, b))])
    return F.when(crossed, 0.0).otherwise(ends)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from the first to the second point, 0 to 360."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def folded_angle_deg(a: Column, b: Column) -> Column:
    """The angle between two bearings, 0 to 180."""
    gap = F.pmod(a - b, F.lit(360.0))
    return F.least(gap, 360 - gap)


def turn_deg(before: Column, after: Column) -> Column:
    """The signed turn between two bearings: right positive, over -180 up to 180."""
    gap = F.pmod(after - before, F.lit(360.0))
    return F.when(gap > 180, gap - 360).otherwise(gap)


def compass_sector(bearing: Column, sectors: int = 16) -> Column:
    """The sector of a bearing, halves rounded up; sector 0 is centred on north."""
    return F.pmod(F.floor(bearing / (360 / sectors) + 0.5), F.lit(sectors)).cast("int")


def pad_degrees(radius_m: float) -> tuple[float, float]:
    """Degrees of longitude and latitude that cover a radius anywhere up to 60 degrees of latitude."""
    lat = radius_m / _DEGREE_M
    return lat / math.cos(math.radians(_STEEPEST_LATITUDE)), lat


def boxes_overlap(min_a: tuple[Column, Column], max_a: tuple[Column, Column], min_b: tuple[Column, Column], max_b: tuple[Column, Column]) -> Column:
    """Whether two boxes, given by (x, y) corners, share a point; their edges count."""
    return (min_a[0] <= max_b[0]) & (min_b[0] <= max_a[0]) & (min_a[1] <= max_b[1]) & (min_b[1] <= max_a[1])


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * (1 << zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    sine = F.radians(lat)
    return F.floor((1 - F.log(F.tan(sine) + 1 / F.cos(sine)) / math.pi) / 2 * (1 << zoom)).cast("int")


def pixel(lon: Column, lat: Column, zoom: int, size: int = 256) -> tuple[Column, Column]:
    """Pixel column and row within the tile that holds the point."""
    fx = (lon + 180) / 360 * (1 << zoom)
    fy = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * (1 << zoom)
    return tuple(F.least(F.floor((f - F.floor(f)) * size), F.lit(size - 1)).cast("int") for f in (fx, fy))


def tile_west(x: Column, zoom: int) -> Column:
    return x / (1 << zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / (1 << zoom)))))


def covering_tiles(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """The tiles of a box as an array of (x, y)."""
    xs, ys = F.sequence(tile_x(west, zoom), tile_x(east, zoom)), F.sequence(tile_y(north, zoom), tile_y(south, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def ring_contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule for an array of (lon, lat) points, closed or not."""
    after = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    crossed = lambda p, q: ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"])
    hits = F.filter(ring, lambda p, i: F.coalesce(crossed(p, after(i)), F.lit(False)))
    return F.size(hits) % 2 == 1


def effective_gradient(gradient: Column, road_bearing: Column, travel_bearing: Column, perpendicular: float = 15.0) -> Column:
    """Gradient along a travel bearing; null where the road runs across it (within ``perpendicular`` degrees of a right angle)."""
    angle = folded_angle_deg(road_bearing, travel_bearing)
    return F.when(F.abs(angle - 90) <= perpendicular, None).when(angle < 90, gradient).otherwise(-gradient)


def span_m() -> Column:
    """Aggregate: metres across the box of a group's points (``lon``, ``lat``)."""
    return haversine_m(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat"))


def line_of(order: str, lon: str = "lon", lat: str = "lat") -> Column:
    """Aggregate: a group's points as a line, by ``order``; a group's line must fit one row."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")).alias("p"))))
    return F.transform(rows, lambda r: r["p"])


def along(points: Column, share: float) -> Column:
    """The point at a share of a line's length, between its points in proportion."""
    n = F.size(points)
    step = lambda i: haversine_m(F.get(points, i)["lon"], F.get(points, i)["lat"], F.get(points, i + 1)["lon"], F.get(points, i + 1)["lat"])
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), step)).otherwise(F.array().cast("array<double>"))
    wanted = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) * share
    zero = F.struct(F.lit(0).alias("i"), wanted.alias("left"), F.lit(False).alias("found"))

    def walk(s: Column, x: Column) -> Column:
        here = s["found"] | (s["left"] <= x)
        return F.struct(F.when(here, s["i"]).otherwise(s["i"] + 1).alias("i"), F.when(here, s["left"]).otherwise(s["left"] - x).alias("left"), here.alias("found"))

    at = F.aggregate(steps, zero, walk)
    a, b = F.get(points, at["i"]), F.coalesce(F.get(points, at["i"] + 1), F.get(points, at["i"]))
    part = F.coalesce(F.try_divide(at["left"], F.get(steps, at["i"])), F.lit(0.0))
    return F.when(n > 0, F.struct((a["lon"] + (b["lon"] - a["lon"]) * part).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * part).alias("lat")))
