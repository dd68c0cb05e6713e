"""The standard materials of a road network: names, types, units, and the columns that compute them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import tags as T
from tarmac.plans.axes import Material
from tarmac.plans.materials import Catalog, ValueTable

# What materials are built from, in the order of their sources.
RAIN_HOURS = (1, 3, 4, 6, 12, 24, 48, 72)
LAND_COVER = ("water", "trees", "flooded_veg", "crops", "built", "bare", "snow_ice", "rangeland")
STOP_KINDS = ("signal", "crossing", "stop", "level_crossing", "barrier")

#: Value tables by name, and the columns of each that a material may read.
TABLES: dict[str, tuple[str, ...]] = {
    "elevation": ("grade",),
    "wind": ("drag_ratio",),
    "rain": (*(f"rain_{h}h_mm" for h in RAIN_HOURS), "hours_since_rain"),
    "landcover": tuple(f"lc_{c}" for c in LAND_COVER),
    "counts": ("intersection_count", "accident_count", "accident_years", *(f"{k}_count" for k in STOP_KINDS)),
    "directions": ("direction", "divided"),
}


def _tag(name: str) -> Column:
    return T.normalized(F.try_element_at("tags", F.lit(name)))


def _is(name: str, *values: str) -> Column:
    return T.absent_is_false(F.col("tags").isNotNull(), _tag(name).isin(*values))


_CYCLEWAYS = ("cycleway", "cycleway:left", "cycleway:right", "cycleway:both")


def _cycleway(*values: str) -> Column:
    ways = [_tag(t) for t in _CYCLEWAYS]
    return T.absent_is_false(F.col("tags").isNotNull(), T.any_of(ways, values))


def _shared_path() -> Column:
    return T.absent_is_false(F.col("tags").isNotNull(), _tag("highway").isin("footway", "path") & _tag("bicycle").isin("yes", "designated"))


def _listed() -> list[tuple[Material, str | None, Column]]:
    number = lambda name, unit, table, column, **more: (Material(name, "numeric", unit, **more), table, column)
    flag = lambda name, column, table=None: (Material(name, "boolean"), table, column)
    kind = lambda name, column: (Material(name, "categorical"), None, column)
    km = lambda c: T.per_km(F.col(f"counts.{c}"), F.col("distance_m"))
    row = F.col("tags").isNotNull()
    return [
        number("gradient_percent", "%", "elevation", F.col("elevation.grade")),
        number("wind_drag_ratio", "", "wind", F.col("wind.drag_ratio"), dynamic=True),
        *(number(f"rain_{h}h_mm", "mm", "rain", F.col(f"rain.rain_{h}h_mm")) for h in RAIN_HOURS),
        number("hours_since_rain", "h", "rain", F.col("rain.hours_since_rain")),
        *(number(f"{c}_percent", "%", "landcover", F.col(f"landcover.lc_{c}")) for c in LAND_COVER),
        number("intersection_count_per_km", "1/km", "counts", km("intersection_count"), additive=True),
        number("accident_count_per_km_year", "1/(km a)", "counts", T.per_km_year(F.col("counts.accident_count"), F.col("distance_m"), F.col("counts.accident_years")), additive=True),
        flag("lit", _is("lit", "yes")),
        flag("has_tunnel", T.is_tunnel(row, _tag("tunnel"))),
        flag("bridge", T.is_bridge(row, _tag("bridge"))),
        flag("motor_vehicle_no", _is("motor_vehicle", "no")),
        flag("oneway", T.one_way(F.col("directions.direction")) & ~F.coalesce("directions.divided", F.lit(False)), "directions"),
        number("maxspeed_kmh", "km/h", None, T.positive_int(_tag("maxspeed")).cast("double")),
        number("lanes_count", "", None, T.positive_int(_tag("lanes")).cast("double")),
        kind("highway", _tag("highway")),
        kind("surface", _tag("surface")),
        kind("surface_class", T.surface_class(_tag("surface"))),
        kind("surface_estimate", T.surface_estimate(_tag("surface"), _tag("tracktype"), _tag("highway"))),
        flag("highway_is_cycleway", _is("highway", "cycleway")),
        flag("cycleway_has_track", _cycleway("track")),
        flag("cycleway_has_lane", _cycleway("lane")),
        flag("cycleway_has_shared", _cycleway("share_busway", "shared_lane")),
        flag("shared_pedestrian_path", _shared_path()),
        kind("cycleway_class", T.cycleway_class([_tag(t) for t in _CYCLEWAYS], _tag("highway"), _tag("bicycle"))),
        kind("smoothness", _tag("smoothness")),
        kind("tracktype", _tag("tracktype")),
        *(number(f"{k}_count_per_km", "1/km", "counts", km(f"{k}_count"), additive=True) for k in STOP_KINDS),
    ]


def materials() -> list[Material]:
    """All entries in order, without their columns; the metric language checks its axes against them."""
    return [material for material, _, _ in _listed()]


def standard(tables: Mapping[str, tuple[DataFrame, tuple[str, ...]]]) -> Catalog:
    """The catalogue over a base with ``tags`` (a map) and ``distance_m``; ``tables`` give each value table and its keys.

    A material whose table is not given is left out, and asking for it is an error.
    """
    catalog = Catalog({name: ValueTable(frame, keys) for name, (frame, keys) in tables.items()})
    for material, table, column in _listed():
        if table is None or table in tables:
            catalog.add(material.name, column, table)
    return catalog
