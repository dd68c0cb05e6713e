"""Weather bulletins, forecast frames, station values along roads, and day and night."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import effective_gradient, haversine_m

# Weather codes of rain and snow by strength (mm an hour), sky, and the parts of the guide on heat.
RAIN_CODES, SNOW_CODES, MODERATE_MM, HEAVY_MM = (61, 63, 65), (71, 73, 75), 2.5, 7.6


def area_kinds(bulletins: DataFrame, fine: str, coarse: str) -> DataFrame:
    """The rows of a place in each bulletin: its fine area's if the bulletin has that area at all, else its coarse area's."""
    own = bulletins.where(((F.col("level") == "fine") & (F.col("area") == fine)) | ((F.col("level") == "coarse") & (F.col("area") == coarse)))
    best = own.groupBy("bulletin").agg(F.max("level").alias("level"))  # 'fine' is the greater word
    return own.join(best, ["bulletin", "level"])


def active_warnings(bulletins: DataFrame, fine: str, coarse: str, irrelevant: Sequence[str] = ()) -> DataFrame:
    """``(code, name, position)``: active warnings of a place, the last bulletin's word for each code, at its first place.

    ``bulletins`` have ``bulletin`` (its number), ``level``, ``area``, ``item`` (order within), ``code``, ``name`` and ``active``.
    """
    rows = area_kinds(bulletins, fine, coarse).where(F.col("active") & ~F.col("name").isin(*irrelevant) if irrelevant else F.col("active"))
    order = F.struct("bulletin", "item")
    return rows.groupBy("code").agg(F.max_by("name", order).alias("name"), F.min(order).alias("_p")).select("code", "name", F.col("_p.bulletin").alias("first_bulletin"), F.col("_p.item").alias("first_item"))


def active_floods(bulletins: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Flood bulletins with a level that name the place's fine or coarse area."""
    return bulletins.where(F.col("level").isNotNull() & (F.array_contains("fine_codes", fine) | F.array_contains("coarse_codes", coarse)))


def nowcast_frames(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frames from the latest observed one (valid when issued) on; all where none is observed."""
    last = frames.groupBy(*by).agg(F.max(F.when(F.col("validtime") == F.col("basetime"), F.col("validtime"))).alias("_last"))
    out = frames.join(last, list(by)) if by else frames.crossJoin(F.broadcast(last))
    return out.where(F.col("_last").isNull() | (F.col("validtime") >= F.col("_last"))).drop("_last")


def full_run_frames(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each member's frames of its newest run with more than one valid time; of equal valid times the newer run's, then the smaller member's."""
    runs = frames.groupBy(*by, "member", "basetime").agg(F.count_distinct("validtime").alias("_n")).where("_n > 1")
    latest = runs.groupBy(*by, "member").agg(F.max("basetime").alias("basetime"))
    rest = [c for c in frames.columns if c not in (*by, "validtime")]
    own = frames.join(latest, [*by, "member", "basetime"], "left_semi")
    best = own.groupBy(*by, "validtime").agg(F.min_by(F.struct(*rest), F.struct((-F.unix_timestamp("basetime")).alias("b"), "member")).alias("_f"))
    return best.select(*by, "validtime", "_f.*")


def latest_frame(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """The frame issued last."""
    rest = [c for c in frames.columns if c not in by]
    return frames.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("basetime", "validtime")).alias("_f")).select(*by, "_f.*")


def heat_forecast(forecasts: DataFrame, point: str, now: Column) -> DataFrame:
    """Of each point's latest issue the forecast nearest to ``now`` (the earlier on ties); issues without any time give none."""
    latest = F.max("issued").over(Window.partitionBy(point))
    own = forecasts.withColumn("_latest", latest).where((F.col("issued") == F.col("_latest")) & F.col("at").isNotNull())
    gap = F.abs(F.unix_timestamp("at") - F.unix_timestamp(now))
    return own.groupBy(point).agg(F.min_by(F.struct("issued", "at", "wbgt"), F.struct(gap.alias("gap"), F.col("at").alias("at"))).alias("_f")).select(point, "_f.*")


def observed_weather_code(rain_10min: Column, sky: Column, celsius: Column, least_mm: float = 0.5, snow_below: float = 1.0) -> Column:
    """The code of what a station measures: rain or snow by strength, else clear or cloudy by the sky, else none."""
    hourly = rain_10min * 6
    snow = F.coalesce(celsius <= snow_below, F.lit(False))
    pick = lambda i: F.when(snow, SNOW_CODES[i]).otherwise(RAIN_CODES[i])
    falling = F.when(hourly < MODERATE_MM, pick(0)).when(hourly < HEAVY_MM, pick(1)).otherwise(pick(2))
    return F.when(F.coalesce(hourly >= least_mm, F.lit(False)), falling).when(sky == "clear", 0).when(sky.isNotNull(), 3)


def at_night(times: DataFrame, key: str, at: str, events: DataFrame) -> DataFrame:
    """``times`` with ``night``: whether the last of the place's dawns and dusks up to a time was a dusk.

    ``events`` have ``key``, ``at`` and ``dawn``.  A time before the first or after the last event is no night.
    """
    marks = times.select(key, at, F.lit(True).alias("_asked"), F.lit(None).cast("boolean").alias("_dawn"))
    both = marks.distinct().unionByName(events.select(key, F.col("at").alias(at), F.lit(False).alias("_asked"), F.col("dawn").alias("_dawn")))
    by = Window.partitionBy(key).orderBy(at, "_asked")  # an event comes before a question at the same time
    before = F.last("_dawn", ignorenulls=True).over(by)
    after = F.max(F.when(~F.col("_asked"), F.col(at))).over(Window.partitionBy(key))
    night = F.coalesce(~before & (F.col(at) < after), F.lit(False))
    return times.join(both.withColumn("night", night).where("_asked").select(key, at, "night"), [key, at], "left").withColumn("night", F.coalesce("night", F.lit(False)))


def nearest_station(points: DataFrame, stations: DataFrame, key: str, station: str, radius_m: float = 30_000.0, limit: int = 100_000) -> DataFrame:
    """``(key, station, dist_m)``: the nearest station of every point, however far (the smaller id on ties).

    Points meet the stations of cells within a radius first; those without one ask again with a radius four times as
    wide, until a radius spans the globe.  The few points left then meet all
    stations, in arrays of about ``limit`` a row.
    """
    from tarmac.operators.spatial import nearest
    from tarmac.storage import stored

    rest, found, radius = points.select(key, "lon", "lat"), None, radius_m
    while True:
        if radius > 2_000_000:  # few points are this far from everything
            parts = -(-stations.count() // limit) or 1
            each = stations.groupBy(F.pmod(F.xxhash64(station), F.lit(parts)).alias("_p")).agg(F.collect_list(F.struct(station, "lon", "lat")).alias("_all"))
            far = F.transform("_all", lambda s: F.struct(haversine_m(F.col("lon"), F.col("lat"), s["lon"], s["lat"]).alias("d"), s[station].alias("s")))
            last = rest.crossJoin(each).select(key, F.array_min(far).alias("_n")).groupBy(key).agg(F.min("_n").alias("_n")).select(key, F.col("_n.s").alias(station), F.col("_n.d").alias("dist_m")).where(F.col(station).isNotNull())
            return last if found is None else found.unionByName(last)
        near = stored(nearest(rest, stations.select(station, "lon", "lat"), key, station, radius).select(key, station, "dist_m"))
        found = near if found is None else found.unionByName(near)
        rest = stored(rest.join(near, key, "left_anti"))
        if rest.isEmpty():
            return found
        radius *= 4


def gradient_values(features: DataFrame, key: str, bearing: float, digits: int = 1) -> DataFrame:
    """``(key, value)``: gradient along a bearing; a road across it has a row without a value, one without a gradient has no row."""
    value = F.round(effective_gradient(F.col("gradient"), F.col("road_bearing"), F.lit(bearing)), digits)
    return features.where("gradient is not null and road_bearing is not null").select(key, value.alias("value"))


def station_values(features: DataFrame, located: DataFrame, values: DataFrame, key: str, station: str, digits: int = 1) -> DataFrame:
    """``(key, value)`` of each feature's station; features whose station has none are left out."""
    found = features.select(key).join(located.select(key, station), key).join(values.where("value is not null").select(station, "value"), station)
    return found.select(key, F.round("value", digits).alias("value"))


def lattice_values(features: DataFrame, series: DataFrame, key: str, at: Column, dx: float, dy: float, digits: int = 3) -> DataFrame:
    """``(key, value)`` of the nearest lattice point and hour; nothing for a time outside the series."""
    ends = series.agg(F.min("hour").alias("_a"), F.max("hour").alias("_b"))
    placed = features.crossJoin(F.broadcast(ends)).where((at >= F.col("_a")) & (at <= F.col("_b")))
    hour = F.timestamp_seconds(F.floor(F.unix_timestamp(at) / 3600 + 0.5) * 3600)
    placed = placed.select(key, F.rint(F.col("lon") / dx).cast("int").alias("i"), F.rint(F.col("lat") / dy).cast("int").alias("j"), F.least(hour, F.col("_b")).alias("hour"))
    return placed.join(series, ["i", "j", "hour"]).select(key, F.round("value", digits).alias("value"))


def painted(features: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``features`` with ``value`` and ``state``: known, undetermined (a row without a value) or missing (no row)."""
    own = values.select(key, "value", F.lit(True).alias("_row"))
    state = F.when(F.col("value").isNotNull(), "known").when(F.col("_row"), "undetermined").otherwise("missing")
    return features.join(own, key, "left").withColumn("state", state).drop("_row")
