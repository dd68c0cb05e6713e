"""Wind, speed and weather readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_from_deg(u: Column, v: Column) -> Column:
    """The bearing that a wind of eastward ``u`` and northward ``v`` blows from."""
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def head_wind(speed: Column, from_deg: Column, bearing: Column) -> Column:
    """The component against a traveller; tail winds are negative."""
    return speed * F.cos(F.radians(from_deg - bearing))


def cross_wind(speed: Column, from_deg: Column, bearing: Column) -> Column:
    return speed * F.sin(F.radians(from_deg - bearing))


def drag_ratio(speed: Column, from_deg: Column, bearing: Column, cruise_ms: float) -> Column:
    """Air drag along the way relative to that in still air at cruising speed; a strong tail wind pushes (below zero)."""
    along = F.lit(cruise_ms) + head_wind(speed, from_deg, bearing)
    across = cross_wind(speed, from_deg, bearing)
    return along * F.sqrt(along * along + across * across) / (cruise_ms * cruise_ms)


def balanced_speed(
    grade: Column, rolling: Column, power_w: float, mass_kg: float = 80.0, cda: float = 0.32, density: float = 1.2, lowest: float = 1.25, highest: float = 12.5, steps: int = 12
) -> Column:
    """The speed (m/s) at which the power is used up by slope, rolling and air, by bisection between two speeds."""
    slope = F.atan(grade / 100)
    force = mass_kg * 9.80665 * (F.sin(slope) + rolling * F.cos(slope))
    low, high = F.lit(lowest), F.lit(highest)
    state = F.struct(low.alias("low"), high.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        enough = (force + 0.5 * density * cda * middle * middle) * middle <= power_w
        return F.struct(F.when(enough, middle).otherwise(s["low"]).alias("low"), F.when(enough, s["high"]).otherwise(middle).alias("high"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, halve)
    return F.when(grade.isNotNull() & rolling.isNotNull(), (end["low"] + end["high"]) / 2)


def travel_seconds(distance_m: Column, speed_ms: Column, stops: Sequence[tuple[Column, float]]) -> Column:
    """Riding time and waits; unknown stop counts wait for nothing."""
    out = distance_m / speed_ms
    for count, seconds in stops:
        out = out + F.coalesce(count, F.lit(0.0)) * seconds
    return out


def apparent_temperature(celsius: Column, humidity: Column, wind_ms: Column) -> Column:
    """Steadman's apparent temperature in shade."""
    vapour = humidity / 100 * 6.105 * F.exp(17.27 * celsius / (237.7 + celsius))
    return celsius + 0.33 * vapour - 0.70 * wind_ms - 4.0


def heat_level(wbgt: Column) -> Column:
    """Levels of wet-bulb globe temperature: from 21, 25, 28 and 31 degrees."""
    return F.when(wbgt >= 31, "danger").when(wbgt >= 28, "severe").when(wbgt >= 25, "warning").when(wbgt >= 21, "caution").when(wbgt.isNotNull(), "safe")


def nearest_hour(at: Column, first: Column, last: Column) -> Column:
    """The hour nearest to a time (halves up), within the series' first and last hour."""
    hour = F.timestamp_seconds(F.floor(F.unix_timestamp(at) / 3600 + 0.5) * 3600)
    return F.greatest(F.least(hour, last), first)


def passage_hour(start: Column, distance_km: Column, speed_kmh: float, detour: float = 1.3) -> Column:
    """The hour in which a point at a straight distance is likely to be passed."""
    return F.date_trunc("hour", F.timestamp_seconds(F.unix_timestamp(start) + distance_km * detour / speed_kmh * 3600))


def warning_severity(name: Column) -> Column:
    """Rank of a warning by its name, the heaviest first."""
    return F.when(name.contains("特別警報") | name.contains("emergency"), 0).when(name.contains("警報") | name.contains("warning"), 1).otherwise(2)
