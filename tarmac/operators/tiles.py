"""Tiles: features of a map tile, clustered points, pixels by class, presence, and quadrants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.geo import boxes_overlap, tile_north, tile_west, tile_x, tile_y
from tarmac.operators.spatial import clusters

EXTENT = 4096


def covered(spark_frame: DataFrame, runs: DataFrame, min_lat: str, min_lon: str, max_lat: str, max_lon: str) -> DataFrame:
    """``spark_frame`` (tiles with ``west``, ``south``, ``east``, ``north``) with ``covered``: whether the ingested box meets the tile.

    ``runs`` is the latest run's box, one row or none.
    """
    box = runs.agg(*[F.first(c).alias(f"_{c}") for c in (min_lat, min_lon, max_lat, max_lon)])
    hit = boxes_overlap((F.col("west"), F.col("south")), (F.col("east"), F.col("north")), (F.col(f"_{min_lon}"), F.col(f"_{min_lat}")), (F.col(f"_{max_lon}"), F.col(f"_{max_lat}")))
    out = spark_frame.crossJoin(F.broadcast(box)).withColumn("covered", F.coalesce(hit, F.lit(False)))
    return out.drop(*[f"_{c}" for c in (min_lat, min_lon, max_lat, max_lon)])


def ingested_box(runs: DataFrame, profile: str = "profile") -> DataFrame:
    """The box that a run's profile (JSON) declares, in the order south, west, north, east."""
    part = lambda i: F.get_json_object(profile, f"$.target.bbox[{i}]").try_cast("double")
    return runs.select(*[part(i).alias(n) for i, n in enumerate(("min_lat", "min_lon", "max_lat", "max_lon"))])


def tile_box(zoom: int, x: str = "x", y: str = "y") -> dict[str, Column]:
    """The corners of tiles in degrees."""
    return {"west": tile_west(F.col(x), zoom), "north": tile_north(F.col(y), zoom), "east": tile_west(F.col(x) + 1, zoom), "south": tile_north(F.col(y) + 1, zoom)}


def quantised(lon: Column, lat: Column, zoom: int, x: Column, y: Column, extent: int = EXTENT) -> tuple[Column, Column]:
    """Whole tile coordinates of a point, from the tile's north-west corner."""
    fx = (lon + 180) / 360 * (1 << zoom) - x
    fy = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.lit(3.141592653589793)) / 2 * (1 << zoom) - y
    return F.rint(fx * extent).cast("int"), F.rint(fy * extent).cast("int")


def feature_rows(features: DataFrame, key: str, zoom: int, columns: Sequence[str], points: str = "points") -> DataFrame:
    """``(x, y, key, columns..., line)``: each feature in every tile that it has a point in, its line in the tile's coordinates."""
    tiles = F.array_distinct(F.transform(points, lambda p: F.struct(tile_x(p["lon"], zoom).alias("x"), tile_y(p["lat"], zoom).alias("y"))))
    placed = features.select(key, *columns, points, F.explode(tiles).alias("_t"))

    def local(p: Column) -> Column:
        a, b = quantised(p["lon"], p["lat"], zoom, F.col("_t.x"), F.col("_t.y"))
        return F.struct(a.alias("x"), b.alias("y"))

    return placed.select("_t.x", "_t.y", key, *columns, F.transform(points, local).alias("line"))


def midpoint(points: Column) -> Column:
    """The middle point of a line by number."""
    return F.get(points, F.floor(F.size(points) / 2).cast("int"))


def way_rollup(segments: DataFrame, way: str, distance: str, means: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """One feature a way: means weighted by length over segments with a value, sums, and its segments in order."""
    from tarmac.operators.aggregates import weighted_mean

    return segments.groupBy(way).agg(*[weighted_mean(F.col(c), F.col(distance)).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], F.sum(distance).alias(distance), F.array_sort(F.collect_list("segment")).alias("segments"))


def clustered_points(points: DataFrame, key: str, group: str, eps_m: float, merged: Sequence[str]) -> DataFrame:
    """``(group, lon, lat, n, first)``: points of the ``merged`` groups drawn together within ``eps_m``, all others by themselves."""
    near = clusters(points.where(F.col(group).isin(*merged)), key, eps_m, [group])
    own = points.join(near, key, "left").withColumn("_c", F.coalesce("cluster", key))
    return own.groupBy(group, "_c").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n"), F.min(key).alias("first")).drop("_c")


def recoloured(pixels: DataFrame, palette: Mapping[str, str], colour: str = "colour") -> DataFrame:
    """``pixels`` with colours read through a palette, and ``known``; a colour that it has not stays."""
    table = F.create_map(*[F.lit(x) for pair in palette.items() for x in pair])
    new = F.try_element_at(table, F.col(colour))
    return pixels.withColumn("known", new.isNotNull()).withColumn(colour, F.coalesce(new, F.col(colour)))


def class_colours(pixels: DataFrame, palette: Mapping[int, tuple[int, int, int, int]], kind: str = "class") -> DataFrame:
    """``pixels`` with ``rgba``; a class without a colour is clear."""
    table = F.create_map(*[x for k, v in palette.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return pixels.withColumn("rgba", F.coalesce(F.try_element_at(table, F.col(kind)), F.array(*[F.lit(0)] * 4)))


def not_empty(alphas: Column) -> Column:
    """Whether a tile shows anything; one that cannot be read counts as showing."""
    return F.coalesce(F.exists(alphas, lambda a: a > 0), F.lit(True))


def presence(tiles: DataFrame, layer: str = "layer") -> DataFrame:
    """``(layer, z, tiles)``: the tiles of each layer and zoom that show something, in order."""
    return tiles.where("shown").groupBy(layer, "z").agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("tiles"))


def clipped_points(points: DataFrame, quadrant_x: int, quadrant_y: int, extent: int = EXTENT, margin: int = 64) -> DataFrame:
    """Points of a tile (``px``, ``py``) in one quadrant and a margin of ``extent / margin`` around it, at twice the scale."""
    half, pad = extent // 2, extent // margin
    inside = F.col("px").between(quadrant_x * half - pad, quadrant_x * half + half + pad) & F.col("py").between(quadrant_y * half - pad, quadrant_y * half + half + pad)
    return points.where(inside).withColumn("px", (F.col("px") - quadrant_x * half) * 2).withColumn("py", (F.col("py") - quadrant_y * half) * 2)


def quadrant_box(quadrant_x: int, quadrant_y: int, extent: int = EXTENT, margin: int = 64) -> tuple[float, float, float, float]:
    """West, top, east and bottom of a quadrant in its parent's units, ``margin`` units of the child around it (y grows southward)."""
    half = extent // 2
    return quadrant_x * half - margin, quadrant_y * half - margin, quadrant_x * half + half + margin, quadrant_y * half + half + margin


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def clip_line(points: Column, box: tuple[float, float, float, float]) -> Column:
    """The parts of a line (an array of ``x``, ``y``) inside a box, as an array of lines.

    Each step keeps the span of it between its entry and its exit; steps that go on where the one before ended are one
    part.  Where a line only touches the box nothing is left.
    """
    west, top, east, bottom = map(float, box)
    n = F.size(points)

    # a fold for each step of the work, so that what the next one uses several times is a value and not an expression
    def ends(i: Column) -> Column:
        return F.struct(F.get(points, i).alias("a"), F.get(points, i + 1).alias("b"))

    def way(s: Column) -> Column:
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy"))

    def met(s: Column) -> Column:
        a, dx, dy = s["a"], s["dx"], s["dy"]
        sides = [(-dx, a["x"] - west), (dx, east - a["x"]), (-dy, a["y"] - top), (dy, bottom - a["y"])]
        enter = F.greatest(F.lit(0.0), *[F.coalesce(F.when(p < 0, q / p), F.lit(0.0)) for p, q in sides])
        leave = F.least(F.lit(1.0), *[F.coalesce(F.when(p > 0, q / p), F.lit(1.0)) for p, q in sides])
        beside = reduce(lambda u, v: u | v, [(p == 0) & (q < 0) for p, q in sides])
        return F.struct(a.alias("a"), s["b"].alias("b"), dx.alias("dx"), dy.alias("dy"), enter.alias("enter"), leave.alias("leave"), beside.alias("beside"), ((dx == 0) & (dy == 0)).alias("still"))

    def span(s: Column) -> Column:
        a, b, dx, dy, enter, leave = (s[c] for c in ("a", "b", "dx", "dy", "enter", "leave"))
        at = lambda t: F.when(t == 0, _point(a["x"], a["y"])).when(t == 1, _point(b["x"], b["y"])).otherwise(_point(a["x"] + dx * t, a["y"] + dy * t))
        inside = ~s["beside"] & (enter < leave) & ~s["still"]
        return F.struct(inside.alias("inside"), (enter > 0).alias("entered"), F.when(inside, at(enter)).alias("a"), F.when(inside, at(leave)).alias("b"), (leave < 1).alias("left"), s["still"].alias("still"))

    none = F.array().cast("array<struct<x:double,y:double>>")
    start = F.struct(F.array().cast("array<array<struct<x:double,y:double>>>").alias("parts"), none.alias("open"))
    closed = lambda s: F.when(F.size(s["open"]) > 1, F.concat(s["parts"], F.array(s["open"]))).otherwise(s["parts"])

    def follow(s: Column, step: Column) -> Column:
        fresh = step["entered"] | (F.size(s["open"]) == 0)
        line = F.when(fresh, F.array(step["a"], step["b"])).otherwise(F.concat(s["open"], F.array(step["b"])))
        before = F.when(fresh, closed(s)).otherwise(s["parts"])
        going = F.struct(F.when(step["left"], F.concat(before, F.array(line))).otherwise(before).alias("parts"), F.when(step["left"], none).otherwise(line).alias("open"))
        return F.when(step["still"], s).when(step["inside"], going).otherwise(F.struct(closed(s).alias("parts"), none.alias("open")))

    steps = F.when(n > 1, reduce(F.transform, (way, met, span), F.transform(F.sequence(F.lit(0), n - 2), ends))).otherwise(F.array().cast("array<struct<inside:boolean,entered:boolean,a:struct<x:double,y:double>,b:struct<x:double,y:double>,left:boolean,still:boolean>>"))
    return F.aggregate(steps, start, follow, closed)


def clip_ring(points: Column, box: tuple[float, float, float, float]) -> Column:
    """A ring (an array of ``x``, ``y``, not closed) cut to a box, side by side; empty if nothing of it is inside.

    A ring that leaves the box several times stays one ring, whose parts are joined along the box.
    """
    west, top, east, bottom = map(float, box)
    none = F.array().cast("array<struct<x:double,y:double>>")
    sides = F.array(*[F.struct(F.lit(upright).alias("upright"), F.lit(edge).alias("edge"), F.lit(sign).alias("sign")) for upright, edge, sign in ((True, west, 1.0), (True, east, -1.0), (False, top, 1.0), (False, bottom, -1.0))])

    def cut(ring: Column, side: Column) -> Column:
        """One fold a side, so that the ring so far is a value and not an expression again."""
        depth = lambda q: (F.when(side["upright"], q["x"]).otherwise(q["y"]) - side["edge"]) * side["sign"]
        pair = lambda p, i: F.struct(p.alias("p"), F.get(ring, F.pmod(i - 1, F.size(ring))).alias("q"))
        deep = lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q"), depth(s["p"]).alias("d"), depth(s["q"]).alias("e"))

        def corner(s: Column) -> Column:
            p, before, here, there = s["p"], s["q"], s["d"] >= 0, s["e"] >= 0
            share = F.try_divide(s["e"], s["e"] - s["d"])
            met = F.when(side["upright"], _point(side["edge"], before["y"] + (p["y"] - before["y"]) * share)).otherwise(_point(before["x"] + (p["x"] - before["x"]) * share, side["edge"]))
            return F.when(here & there, F.array(p)).when(here, F.array(met, p)).when(there, F.array(met)).otherwise(none)

        return F.flatten(F.transform(F.transform(F.transform(ring, pair), deep), corner))

    return F.aggregate(sides, F.transform(points, lambda p: _point(p["x"], p["y"])), cut, lambda ring: F.when(F.size(ring) > 2, ring).otherwise(none))


def to_child(points: Column, quadrant_x: int, quadrant_y: int, extent: int = EXTENT) -> Column:
    """Points of a parent tile in the units of one of its quadrants."""
    half = extent // 2
    return F.transform(points, lambda p: _point((p["x"] - quadrant_x * half) * 2, (p["y"] - quadrant_y * half) * 2))


def line_span(points: Column) -> Column:
    """Length of a line on the plane."""
    n = F.size(points)
    step = lambda i: F.hypot(F.get(points, i + 1)["x"] - F.get(points, i)["x"], F.get(points, i + 1)["y"] - F.get(points, i)["y"])
    return F.aggregate(F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), step)).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)


def ring_area(points: Column) -> Column:
    """Area of a ring on the plane."""
    after = lambda i: F.get(points, F.pmod(i + 1, F.size(points)))
    return F.abs(F.aggregate(F.transform(points, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)) / 2
