"""Spatial joins by grid cells: nearest, within a distance, clusters, containment, rasters.

Points meet in cells at least as wide as the distance asked for, so a join is an equi-join on cells (of nine cells on
one side) with an exact filter; nothing is compared across the whole plane.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import METRES_PER_DEGREE, haversine_m, pad_degrees, pixel, ring_contains, tile_x, tile_y
from tarmac.operators.components import connected
from tarmac.storage import measured, stored


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _around() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def _near_spots(left: DataFrame, right: DataFrame, radius_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pairs of different places of either side (``lon``, ``lat`` and ``_lon``, ``_lat``) at most ``radius_m`` apart, with ``dist_m``.

    Rows that share a place are compared once.  The side that is copied to nine cells is never broadcast: what Spark knows of
    its size is that of its input.
    """
    wide, high = pad_degrees(radius_m)
    a = left.select(lon, lat).distinct().withColumn("_cx", _cell(F.col(lon), wide)).withColumn("_cy", _cell(F.col(lat), high))
    b = right.select(F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).distinct().withColumn("_c", _around())
    b = b.withColumn("_cx", _cell(F.col("_lon"), wide) + F.col("_c.i")).withColumn("_cy", _cell(F.col("_lat"), high) + F.col("_c.j")).drop("_c")
    pairs = a.join(b.hint("merge"), ["_cx", "_cy"]).withColumn("dist_m", haversine_m(F.col(lon), F.col(lat), F.col("_lon"), F.col("_lat")))
    return pairs.where(F.col("dist_m") <= radius_m).drop("_cx", "_cy")


def within(left: DataFrame, right: DataFrame, radius_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pairs of rows at most ``radius_m`` apart, with ``dist_m``; both sides have ``lon`` and ``lat`` and else different names."""
    pairs = left.join(_near_spots(left, right, radius_m, lon, lat), [lon, lat])
    return pairs.join(right.withColumnsRenamed({lon: "_lon", lat: "_lat"}), ["_lon", "_lat"]).drop("_lon", "_lat")


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius_m: float) -> DataFrame:
    """The nearest right row of each left row within the radius; the smaller key on ties."""
    rest = [c for c in right.columns if c not in ("lon", "lat")]
    first = right.groupBy(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).agg(F.min_by(F.struct(*rest), right_key).alias("_r"))
    best = lambda pairs, *keys: pairs.groupBy(*keys).agg(F.min_by(F.struct("_r", "dist_m"), F.struct("dist_m", f"_r.{right_key}")).alias("_b")).select(*keys, "_b.*")
    spots = best(_near_spots(left, right, radius_m).join(first, ["_lon", "_lat"]), "lon", "lat")
    return best(left.select(left_key, "lon", "lat").join(spots, ["lon", "lat"]), left_key).select(left_key, "_r.*", "dist_m")


def near_any(left: DataFrame, right: DataFrame, left_key: str, radius_m: float) -> DataFrame:
    """Left rows with any right row within the radius."""
    spots = _near_spots(left, right, radius_m).select("lon", "lat").distinct()
    return left.join(left.select(left_key, "lon", "lat").join(spots, ["lon", "lat"], "left_semi").select(left_key).distinct(), left_key, "left_semi")


def clusters(points: DataFrame, key: str, radius_m: float, by: Sequence[str] = (), pairs: int = 4096) -> DataFrame:
    """``(key, cluster)``: points linked by steps of at most the radius, by kind on demand; a cluster is named by its smallest key.

    A cell's diagonal is the radius, so all points of a cell are one cluster and only cells are linked.  Two cells with up
    to ``pairs`` pairs of different places compare these; larger ones compare the boxes they split into, again and again:
    boxes that are near enough whatever their points link their cells, boxes too far apart go.  Points without a place
    are clusters of their own.
    """
    kind = F.to_json(F.struct(*by)) if by else F.lit("")
    cell = radius_m / math.sqrt(2) / METRES_PER_DEGREE * (1 - 1e-9)
    at = lambda c, level=0: F.floor(F.col(c) / cell * (1 << level)).cast("long")
    own = stored(points.select(F.col(key).alias("k"), kind.alias("g"), "lon", "lat", at("lon").alias("x"), at("lat").alias("y")))
    placed = own.where("x is not null and y is not null")
    spots = stored(placed.select("g", "x", "y", "lon", "lat").distinct())
    cells = stored(placed.groupBy("g", "x", "y").agg(F.min("k").alias("low")).join(spots.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("n")), ["g", "x", "y"]))
    # up to 60 degrees of latitude a cell is at least half as wide as it is high
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(3) for i in range(-3, 4) if j or i > 0]))
    other = cells.select("g", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("low").alias("b"), F.col("n").alias("m"))
    near = cells.withColumn("_s", around).withColumn("_x", F.col("x") + F.col("_s.i")).withColumn("_y", F.col("y") + F.col("_s.j")).join(other, ["g", "_x", "_y"])
    waiting = near.select("g", F.col("low").alias("a"), "b", "x", "y", F.col("_x").alias("u"), F.col("_y").alias("v"), "n", "m")
    links, level, side = [], 0, cell
    while True:
        waiting, seen = measured(waiting, n=F.count(F.lit(1)), large=F.count_if(F.col("n") * F.col("m") > pairs))
        if not seen["n"]:
            break
        few = F.col("n") * F.col("m") <= pairs if level < 40 else F.lit(True)
        box = spots.withColumns({"_x": at("lon", level), "_y": at("lat", level)})
        left, right = (box.select("g", F.col("_x").alias(x), F.col("_y").alias(y), F.col("lon").alias(f"{x}_lon"), F.col("lat").alias(f"{x}_lat")) for x, y in (("x", "y"), ("u", "v")))
        met = waiting.where(few).join(left, ["g", "x", "y"]).join(right, ["g", "u", "v"])
        links.append(stored(met.where(haversine_m(F.col("x_lon"), F.col("x_lat"), F.col("u_lon"), F.col("u_lat")) <= radius_m).select("a", "b").distinct()))
        if not seen["large"] or level == 40:
            break
        level, side = level + 1, side / 2
        parts = stored(spots.groupBy("g", at("lon", level).alias("_x"), at("lat", level).alias("_y")).agg(F.count(F.lit(1)).alias("n")))
        of = lambda x, y, n: parts.select("g", F.floor(F.col("_x") / 2).cast("long").alias(x), F.floor(F.col("_y") / 2).cast("long").alias(y), F.col("_x").alias(f"{x}2"), F.col("_y").alias(f"{y}2"), F.col("n").alias(n))
        open_ = waiting.where(~few).drop("n", "m").join(links[-1], ["a", "b"], "left_anti")
        split = open_.join(of("x", "y", "n"), ["g", "x", "y"]).join(of("u", "v", "m"), ["g", "u", "v"])
        middle = lambda c: (F.col(c) + 0.5) * side
        apart, half = haversine_m(middle("x2"), middle("y2"), middle("u2"), middle("v2")), side * math.sqrt(2) * METRES_PER_DEGREE / 2 + 1e-6
        split, _ = measured(split.withColumn("d", apart).where(F.col("d") - 2 * half <= radius_m), n=F.count(F.lit(1)))
        links.append(stored(split.where(F.col("d") + 2 * half <= radius_m).select("a", "b").distinct()))
        waiting = split.join(links[-1], ["a", "b"], "left_anti").select("g", "a", "b", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("u2").alias("u"), F.col("v2").alias("v"), "n", "m")
    roots = connected(reduce(DataFrame.unionByName, links)) if links else None
    named = cells.select("g", "x", "y", "low")
    if roots is not None:
        named = named.join(roots.withColumnRenamed("node", "low"), "low", "left").withColumn("low", F.coalesce("root", "low"))
    return own.join(named.select("g", "x", "y", "low"), ["g", "x", "y"], "left").select(F.col("k").alias(key), F.coalesce("low", "k").alias("cluster"))


def containing(points: DataFrame, areas: DataFrame, point_key: str, area_key: str, ring: str = "ring", cell: float = 0.05) -> DataFrame:
    """For each point the smallest key among the areas whose ring contains it."""
    edge = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    box = areas.select(area_key, ring, *[edge(f, c).alias(n) for n, f, c in (("w", F.array_min, "lon"), ("e", F.array_max, "lon"), ("s", F.array_min, "lat"), ("n", F.array_max, "lat"))])
    cells = box.withColumn("_cx", F.explode(F.sequence(_cell(F.col("w"), cell), _cell(F.col("e"), cell)))).withColumn("_cy", F.explode(F.sequence(_cell(F.col("s"), cell), _cell(F.col("n"), cell))))
    placed = points.select(point_key, "lon", "lat", _cell(F.col("lon"), cell).alias("_cx"), _cell(F.col("lat"), cell).alias("_cy"))
    met = placed.join(cells, ["_cx", "_cy"]).where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    held = met.where(ring_contains(F.col(ring), F.col("lon"), F.col("lat")))
    return held.groupBy(point_key).agg(F.min(area_key).alias(area_key))


def raster_values(points: DataFrame, tiles: DataFrame, zoom: int, priority: str | None = None, key: str = "id", size: int = 256) -> DataFrame:
    """``points`` with ``value``, the pixel under each; of several products the first by ``priority`` that has one.

    ``tiles`` have ``x``, ``y`` and ``pixels`` (row by row, null where missing), and the priority's column.
    """
    px, py = pixel(F.col("lon"), F.col("lat"), zoom, size)
    placed = points.withColumn("x", tile_x(F.col("lon"), zoom)).withColumn("y", tile_y(F.col("lat"), zoom)).withColumn("_i", py * size + px)
    found = placed.select(key, "x", "y", "_i").join(tiles, ["x", "y"]).withColumn("value", F.get("pixels", F.col("_i"))).where("value is not null")
    best = found.groupBy(key).agg(F.min_by("value", priority).alias("value") if priority else F.first("value").alias("value"))
    return points.join(best, key, "left")


def zonal_counts(zones: DataFrame, cells: DataFrame, zone_key: str, radius_m: float) -> DataFrame:
    """Raster cells by class within a distance of a zone's points, each cell once for each zone.

    Cells of one place are counted there first, so a zone meets places and not cells; only cells with several places meet
    zones one by one.
    """
    given = cells.select("cell", "class", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    place = F.struct("_lon", "_lat")
    own = given.groupBy("cell", "class").agg(F.min(place).alias("_p"), F.max(place).alias("_q"))
    counts = own.where("_p = _q").groupBy("_p._lon", "_p._lat", "class").agg(F.count(F.lit(1)).alias("_n"))
    spread = given.join(own.where("_p <> _q").select("cell", "class"), ["cell", "class"], "left_semi")
    met = zones.select(zone_key, "lon", "lat").join(_near_spots(zones, cells, radius_m), ["lon", "lat"]).select(zone_key, "_lon", "_lat").distinct()
    whole = met.join(counts, ["_lon", "_lat"]).select(zone_key, "class", "_n")
    single = met.join(spread, ["_lon", "_lat"]).select(zone_key, "cell", "class").distinct().select(zone_key, "class", F.lit(1).alias("_n"))
    return whole.unionByName(single).groupBy(zone_key, "class").agg(F.sum("_n").alias("count"))


def mosaic(cells: DataFrame, keys: Sequence[str] = ("tile", "px", "py")) -> DataFrame:
    """Of overlapping rasters the first source with a class; 0 is none, and a tile of none is left out."""
    best = cells.where(F.col("class") != 0).groupBy(*keys).agg(F.min_by("class", "priority").alias("class"))
    return best


def decoded_elevation(red: Column, green: Column, blue: Column, scale: float = 0.01) -> Column:
    """Metres of a 24-bit two's complement pixel; 2**23 is missing."""
    raw = F.shiftleft(red.cast("int"), 16) + F.shiftleft(green.cast("int"), 8) + blue.cast("int")
    return F.when(raw < 1 << 23, raw * scale).when(raw > 1 << 23, (raw - (1 << 24)) * scale)


def terrain_rgb(elevation: Column) -> tuple[Column, Column, Column]:
    """The colour whose value is ``(elevation + 10000) / 0.1``."""
    code = F.rint((elevation + 10_000) * 10).cast("int")
    return F.shiftright(code, 16).bitwiseAND(255), F.shiftright(code, 8).bitwiseAND(255), code.bitwiseAND(255)


def child_pixels(parent: DataFrame, quadrant_x: int, quadrant_y: int, size: int = 256) -> DataFrame:
    """One quadrant of a raster tile at twice the scale, each pixel four times."""
    half = size // 2
    own = parent.where(F.col("px").between(quadrant_x * half, quadrant_x * half + half - 1) & F.col("py").between(quadrant_y * half, quadrant_y * half + half - 1))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    grown = own.withColumn("_s", step)
    return grown.withColumn("px", (F.col("px") - quadrant_x * half) * 2 + F.col("_s.i")).withColumn("py", (F.col("py") - quadrant_y * half) * 2 + F.col("_s.j")).drop("_s")


def mean_point(by: Sequence[str]) -> tuple[Column, Column]:
    """Window aggregates: the middle of the points of a group."""
    w = Window.partitionBy(*by)
    return F.avg("lon").over(w), F.avg("lat").over(w)


def lattice(west: float, south: float, east: float, north: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Longitudes and latitudes of a regular grid that covers a box, as arrays; the number of points is fixed by the call."""
    span = lambda a, b, d: F.transform(F.sequence(F.lit(math.floor(a / d)), F.lit(math.ceil(b / d))), lambda i: i * d)
    return span(west, east, dx), span(south, north, dy)
