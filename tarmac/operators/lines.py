"""Lines: pieces of bounded length, rings around them over rasters, and roads whose directions are divided.

A line is an array of points (``lon``, ``lat``).  Joins cut lines into pieces no longer than a cell and meet in cells, so a
long line costs by its length and not by the box around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.geo import METRES_PER_DEGREE, along, bearing_deg, haversine_m, pad_degrees, pieces_m, point_piece_m
from tarmac.storage import dealt, stored

#: What a tag says of a road of divided directions, gaps in metres, tolerance in degrees, places of samples.
DIVIDED_TAGS = ("dual", "triple", "2")
NAMED_GAP_M, SIDE_GAP_M, TOLERANCE_DEG = 40.0, 15.0, 45.0
SAMPLES = (0.05, 0.25, 0.5, 0.75, 0.95)


def pieces(lines: DataFrame, points: str = "points", longest_m: float = 100.0) -> DataFrame:
    """``lines`` with a row for each straight piece (``a``, ``b``), cut to at most ``longest_m``; a line of one point is one piece."""
    n = F.size(points)
    at = lambda i: F.get(points, i)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(at(i).alias("p"), F.coalesce(at(i + 1), at(i)).alias("q")))
    out = lines.where(n > 0).withColumn("_pair", F.explode(pairs))
    p, q = F.col("_pair.p"), F.col("_pair.q")
    count = F.greatest(F.ceil(haversine_m(p["lon"], p["lat"], q["lon"], q["lat"]) / longest_m), F.lit(1)).cast("int")
    out = out.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    mix = lambda t: F.struct(*[(p[c] + (q[c] - p[c]) * t).alias(c) for c in ("lon", "lat")])
    return out.withColumn("a", mix(F.col("_i") / F.col("_n"))).withColumn("b", mix((F.col("_i") + 1) / F.col("_n"))).drop(points, "_pair", "_n", "_i")


def _cells(a: Column, b: Column, radius_m: float, cell_m: float) -> tuple[Column, Column]:
    """Columns and rows of cells within the radius of a piece's box, as arrays."""
    wide, high = pad_degrees(radius_m)
    size = pad_degrees(cell_m)
    span = lambda c, pad, s: F.sequence(F.floor((F.least(a[c], b[c]) - pad) / s).cast("long"), F.floor((F.greatest(a[c], b[c]) + pad) / s).cast("long"))
    return span("lon", wide, size[0]), span("lat", high, size[1])


def _in_cells(df: DataFrame, a: Column, b: Column, radius_m: float, cell_m: float) -> DataFrame:
    xs, ys = _cells(a, b, radius_m, cell_m)
    return df.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))


def near_lines(points: DataFrame, lines: DataFrame, radius_m: float, longest_m: float = 100.0) -> DataFrame:
    """Pairs of points (``lon``, ``lat``) and lines (``points``) at most ``radius_m`` apart, once each, with ``dist_m``; columns else differ.

    Pieces and cells are no shorter than the radius, so a piece lies in a dozen cells or so.  Their copies are never broadcast:
    what Spark knows of their size is that of the lines.
    """
    longest = max(longest_m, radius_m)
    cut = pieces(lines, longest_m=longest)
    theirs = _in_cells(cut, F.col("a"), F.col("b"), radius_m, longest)
    spot = F.struct("lon", "lat")
    met = _in_cells(points, spot, spot, 0.0, longest).join(theirs.hint("merge"), ["_x", "_y"]).withColumn("dist_m", point_piece_m(F.col("lon"), F.col("lat"), F.col("a"), F.col("b")))
    rest = [c for c in met.columns if c not in ("_x", "_y", "a", "b", "dist_m")]
    return met.where(F.col("dist_m") <= radius_m).groupBy(*rest).agg(F.min("dist_m").alias("dist_m"))


def nearest_line(points: DataFrame, lines: DataFrame, point_key: str, line_key: str, radius_m: float) -> DataFrame:
    """``(point_key, line_key, dist_m)``: the nearest line of each point within the radius; the smaller key on ties.

    Points of one place, and lines of one shape, are compared once.
    """
    own = points.select(point_key, "lon", "lat")
    best = lambda met, *keys: met.groupBy(*keys).agg(F.min(F.struct("dist_m", line_key)).alias("_b")).select(*keys, "_b.*")
    shapes = lines.groupBy("points").agg(F.min(line_key).alias(line_key))
    spots = best(near_lines(own.select("lon", "lat").distinct(), shapes, radius_m), "lon", "lat")
    return best(own.join(spots, ["lon", "lat"]), point_key).select(point_key, line_key, "dist_m")


def ring_counts(lines: DataFrame, tiles: DataFrame, key: str, inner_m: float, outer_m: float, pixel_deg: float, size: int, nodata: Sequence[int] = (0,)) -> DataFrame:
    """``(key, class, n)``: raster pixels whose middle is over ``inner_m`` and at most ``outer_m`` from a line, by class.

    ``tiles`` (``tx``, ``ty``, ``pixels`` row by row from the south-west) cover ``size`` pixels a side.  A piece spans, in every row
    of pixels that its buffer meets, the pixels between the ends of the part that is near the row, so a slanted line costs
    its buffer and not its box.  A pixel near several pieces has the distance of the nearest.  Pixels of no tile, null
    ones and ``nodata`` are left out.  Keys with the same lines are counted once, and
    pixels are never broadcast, as Spark takes their size for that of the lines.
    """
    own = lines.groupBy(key).agg(F.array_sort(F.collect_set("points")).alias("_lines"))
    shapes = stored(own.select("_lines").distinct().withColumn("_shape", F.monotonically_increasing_id()))
    cut = pieces(dealt(shapes, "_shape", rows=128).select("_shape", F.explode("_lines").alias("points")), longest_m=max(4 * outer_m, 100.0))
    a, b = F.col("a"), F.col("b")
    high = outer_m / METRES_PER_DEGREE * (1 + 1e-9)
    steepest = F.greatest(F.abs(a["lat"]), F.abs(b["lat"])) + high
    wide = high / F.cos(F.radians(steepest))
    low, top = F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])
    rows = cut.withColumn("py", F.explode(F.sequence(F.floor((low - high) / pixel_deg - 0.5).cast("long"), F.ceil((top + high) / pixel_deg - 0.5).cast("long"))))
    y = (F.col("py") + 0.5) * pixel_deg
    part = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - a["lat"]) / (b["lat"] - a["lat"])))
    ends = [F.when(a["lat"] == b["lat"], F.lit(t)).otherwise(part(v)) for t, v in ((0.0, y - high), (1.0, y + high))]
    xs = [a["lon"] + (b["lon"] - a["lon"]) * t for t in ends]
    first, last = (F.least(*xs) - wide) / pixel_deg - 0.5, (F.greatest(*xs) + wide) / pixel_deg - 0.5
    spots = rows.withColumn("px", F.explode(F.sequence(F.floor(first).cast("long"), F.ceil(last).cast("long"))))
    away = point_piece_m((F.col("px") + 0.5) * pixel_deg, (F.col("py") + 0.5) * pixel_deg, a, b)
    near = spots.withColumn("d", away).where(F.col("d") <= outer_m).groupBy("_shape", "px", "py").agg(F.min("d").alias("d")).where(F.col("d") > inner_m)
    placed = near.withColumn("tx", F.floor(F.col("px") / size).cast("long")).withColumn("ty", F.floor(F.col("py") / size).cast("long"))
    seen = placed.hint("merge").join(tiles.select(F.col("tx").cast("long"), F.col("ty").cast("long"), "pixels"), ["tx", "ty"])
    value = F.get("pixels", (F.pmod("py", F.lit(size)) * size + F.pmod("px", F.lit(size))).cast("int"))
    counts = seen.withColumn("class", value).where(F.col("class").isNotNull() & ~F.col("class").isin(*nodata)).groupBy("_shape", "class").agg(F.count(F.lit(1)).alias("n"))
    return own.join(shapes, "_lines").join(counts, "_shape").select(key, "class", "n")


def divided(ways: DataFrame) -> DataFrame:
    """``(way, divided)``: whether a one-way road is one side of a road whose directions are apart.

    ``ways`` have ``way``, ``points``, ``direction``, ``highway``, ``carriageway``, ``ref`` and ``name``.  A road that may be ridden both
    ways, or that ends where it began, is never divided.  Others are if the tag says so; or if another one-way road of
    the same number or name runs the other way within 40 metres; or if at all five samples of its length some other
    one-way road of its kind, whose name does not contradict, runs the other way within 15 metres of it, not
    necessarily the same at each.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    heading = F.when((first["lon"] != last["lon"]) | (first["lat"] != last["lat"]), bearing_deg(first["lon"], first["lat"], last["lon"], last["lat"]) + F.when(F.col("direction") == "backward", 180.0).otherwise(0.0))
    one_way = ways.where(F.col("direction").isin("forward", "backward") & (F.size("points") > 1)).select("way", "points", "highway", F.coalesce(text("ref"), text("name")).alias("ident"), F.lower(F.trim("carriageway")).isin(*DIVIDED_TAGS).alias("tagged"), heading.alias("deg")).where("deg is not null")
    opposite = F.abs(F.pmod(F.col("deg2") - F.col("deg"), F.lit(360.0)) - 180) < TOLERANCE_DEG
    # lines meet in cells once each, then kinds of ways (all that tells them apart but the way) on lines that are near
    shapes = stored(one_way.groupBy("points", "highway", "ident", "deg").agg(F.min("way").alias("low"), F.max("way").alias("high")).withColumn("shape", F.monotonically_increasing_id()))
    own = shapes.select("shape", "points", "highway", "ident", "deg")
    geometries = stored(shapes.select("points").distinct().withColumn("line", F.monotonically_increasing_id()))
    kinds = shapes.join(geometries, "points").select("line", "shape", "highway", "ident", "deg", "low", "high")
    mine = kinds.select("line", "shape", "highway", "ident", "deg")
    other = kinds.select(*[F.col(c).alias(f"{c}2") for c in ("line", "highway", "ident", "deg", "low", "high")])
    ends = [F.min("low2").alias("low"), F.max("high2").alias("high")]
    cut = pieces(geometries)
    theirs = cut.withColumnRenamed("line", "line2")
    ours = _in_cells(cut, F.col("a"), F.col("b"), 0.0, 100.0)
    reached = _in_cells(theirs.withColumnsRenamed({"a": "c", "b": "d"}), F.col("c"), F.col("d"), NAMED_GAP_M, 100.0)
    gaps = ours.join(reached.hint("merge"), ["_x", "_y"]).where(pieces_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= NAMED_GAP_M).select("line", "line2").distinct()
    beside = gaps.join(mine, "line").withColumn("ident2", F.col("ident")).join(other, ["line2", "ident2"]).where(opposite)
    beside = beside.groupBy("shape").agg(*ends)
    samples = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), along(F.col("points"), f).alias("p")) for f in SAMPLES]))
    spots = geometries.select("line", samples.alias("s")).select("line", "s.f", "s.p.lon", "s.p.lat")
    spots = _in_cells(spots, F.struct("lon", "lat"), F.struct("lon", "lat"), 0.0, 100.0)
    sides = _in_cells(theirs, F.col("a"), F.col("b"), SIDE_GAP_M, 100.0)
    near = spots.join(sides.hint("merge"), ["_x", "_y"]).where(point_piece_m(F.col("lon"), F.col("lat"), F.col("a"), F.col("b")) <= SIDE_GAP_M).groupBy("line", "line2").agg(F.collect_set("f").alias("fs"))
    met = near.join(mine, "line").withColumn("highway2", F.col("highway")).join(other, ["line2", "highway2"]).where(opposite & F.coalesce(F.col("ident") == F.col("ident2"), F.lit(True)))
    met = met.withColumn("f", F.explode("fs")).groupBy("shape", "f").agg(*ends)
    every = met.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("low") == F.col("high"), F.col("low"))).alias("alone")).where(F.col("n") == len(SAMPLES))
    a, b = one_way.alias("a"), own.alias("b")
    of = a.join(b, (F.col("a.points") == F.col("b.points")) & F.col("a.highway").eqNullSafe(F.col("b.highway")) & F.col("a.ident").eqNullSafe(F.col("b.ident")) & (F.col("a.deg") == F.col("b.deg"))).select("a.way", "b.shape")
    named = of.join(beside, "shape").where((F.col("low") != F.col("way")) | (F.col("high") != F.col("way")))
    sided = of.join(every, "shape").where(~F.array_contains("alone", F.col("way")))  # another way than itself at each sample
    found = one_way.where("tagged").select("way").unionByName(named.select("way")).unionByName(sided.select("way")).distinct().withColumn("divided", F.lit(True))
    return ways.select("way").join(found, "way", "left").select("way", F.coalesce("divided", F.lit(False)).alias("divided"))
