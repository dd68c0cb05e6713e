"""Typed views over the feature table, and the relational part of small sources: vertices, registries, areas, tiles, forecasts."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numbers import bilinear
from tarmac.functions.tags import party_type
from tarmac.sources.ingest import dms_degrees, in_box

register_pickle_by_value(sys.modules[__name__])  # workers need not have this package on their path


@dataclass(frozen=True)
class View:
    """A source and its typed columns: name -> (JSON path in ``attrs``, type)."""

    source: str
    columns: Mapping[str, tuple[str, str]]


VIEWS: dict[str, View] = {
    "ways": View("way", {"highway": ("$.highway", "string"), "name": ("$.name", "string"), "maxspeed": ("$.maxspeed", "string")}),
    "nodes": View("node", {"highway": ("$.highway", "string"), "crossing": ("$.crossing", "string")}),
    "accidents": View("accident", {"deaths": ("$.deaths", "int"), "party_a": ("$.party_a", "string"), "party_b": ("$.party_b", "string"), "year": ("$.year", "int")}),
    "places": View("place", {"name": ("$.names.primary", "string"), "brand": ("$.brand.names.primary", "string"), "confidence": ("$.confidence", "double"), "hierarchy": ("$.taxonomy.hierarchy", "array<string>"), "websites": ("$.websites", "array<string>"), "phones": ("$.phones", "array<string>")}),
    "heritage": View("heritage", {"name": ("$.name", "string"), "designation": ("$.designation", "string"), "owner": ("$.owner", "string")}),
    "prefectures": View("prefecture", {"code": ("$.lg_code", "string"), "name": ("$.pref", "string"), "abolished": ("$.ablt_date", "string")}),
    "cities": View("city", {"code": ("$.lg_code", "string"), "city": ("$.city", "string"), "ward": ("$.ward", "string"), "abolished": ("$.ablt_date", "string")}),
    "towns": View("town", {"code": ("$.lg_code", "string"), "town": ("$.machiaza_id", "string"), "oaza": ("$.oaza_cho", "string"), "chome": ("$.chome", "string"), "koaza": ("$.koaza", "string")}),
    "blocks": View("block", {"code": ("$.lg_code", "string"), "town": ("$.machiaza_id", "string"), "block": ("$.blk_id", "string"), "number": ("$.blk_num", "string")}),
    "areas": View("area", {"code": ("$.key_code", "string"), "city": ("$.city_name", "string"), "name": ("$.name", "string")}),
    "parcels": View("parcel", {"city": ("$.city", "string"), "oaza": ("$.oaza", "string"), "number": ("$.number", "string"), "residential": ("$.residential", "boolean")}),
}


def view(features: DataFrame, name: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows of a source with its typed columns; what does not parse is null.  The source filter reaches the partitions."""
    own = VIEWS[name]

    def typed(path: str, kind: str) -> Column:
        raw = F.get_json_object("attrs", path)
        return F.from_json(raw, kind) if kind.startswith("array") else raw.try_cast(kind)

    columns = [typed(path, kind).alias(column) for column, (path, kind) in own.columns.items()]
    places = [c for c in ("lon", "lat") if c in features.columns]
    return features.where(F.col("source") == own.source).select("natural_key", *places, *columns, *[c.alias(n) for n, c in (extra or {}).items()])


def accidents_view(features: DataFrame) -> DataFrame:
    """Accidents with their parties by kind instead of by code."""
    rows = view(features, "accidents")
    return rows.withColumns({c: party_type(F.col(c)) for c in ("party_a", "party_b")})


def accident_rows(raw: DataFrame, box: tuple[float, float, float, float], country: tuple[float, float, float, float] = (120.0, 20.0, 155.0, 47.0)) -> DataFrame:
    """``raw`` with ``lon``, ``lat`` and ``state``: ``kept``, ``outside`` the box, or ``skipped`` (no position in the country)."""
    rows = raw.withColumn("lon", dms_degrees(F.col("longitude"))).withColumn("lat", dms_degrees(F.col("latitude")))
    good = F.coalesce(in_box(F.col("lon"), F.col("lat"), country), F.lit(False))
    return rows.withColumn("state", F.when(~good, "skipped").when(in_box(F.col("lon"), F.col("lat"), box), "kept").otherwise("outside"))


def tallies(rows: DataFrame, by: Sequence[str] = (), state: str = "state") -> DataFrame:
    """How many rows there are of each state: what was kept, and what was left out and why."""
    return rows.groupBy(*by, state).count()


def network_nodes(ways: DataFrame, nodes: DataFrame, supply: Column) -> DataFrame:
    """Nodes that a way passes, and nodes that are places of supply by themselves, each once.

    ``ways`` have ``way``, ``node_ids`` and ``area`` (a closed way that is a place); such a way also gives its middle
    point, keyed by the negative way id.  ``nodes`` have ``node``, ``lon``, ``lat`` and what ``supply`` reads.
    """
    passed = ways.where("not area").select(F.explode("node_ids").alias("node")).distinct()
    vertices = nodes.join(passed, "node", "left_semi").select("node", "lon", "lat", F.lit("vertex").alias("kind"))
    places = nodes.where(supply).join(passed, "node", "left_anti").select("node", "lon", "lat", F.lit("supply").alias("kind"))
    corners = ways.where("area").select("way", F.explode(F.array_distinct("node_ids")).alias("node")).join(nodes.select("node", "lon", "lat"), "node")
    middles = corners.groupBy("way").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).select((-F.col("way")).alias("node"), "lon", "lat", F.lit("area").alias("kind"))
    return vertices.unionByName(places).unionByName(middles).dropDuplicates(["node"])


def prefectures_in_range(cities: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Prefectures of which a city's point lies in the box."""
    return cities.where(in_box(F.col("lon"), F.col("lat"), box)).select("prefecture").distinct()


def area_parts(parts: DataFrame, key: str, kind: str, ordinary: Sequence[str], size: str, ring: str = "ring") -> DataFrame:
    """One row an area: all its ordinary parts' rings, and the attributes of the largest part (the first by ring on ties)."""
    rest = [c for c in parts.columns if c not in (key, kind, size, ring)]
    own = parts.where(F.col(kind).isin(*ordinary))
    return own.groupBy(key).agg(F.array_sort(F.collect_list(ring)).alias("rings"), F.min_by(F.struct(*rest), F.struct((-F.col(size)).alias("n"), F.col(ring).cast("string").alias("r"))).alias("_a")).select(key, "rings", "_a.*")


def block_points(rows: DataFrame, keys: Sequence[str], box: tuple[float, float, float, float], ordinal: str) -> DataFrame:
    """Representative, undeleted points in the box, the first by file order for each key."""
    own = rows.where("representative = 1 and not deleted").where(in_box(F.col("lon"), F.col("lat"), box))
    rest = [c for c in rows.columns if c not in (*keys, ordinal, "representative", "deleted")]
    return own.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_r")).select(*keys, "_r.*")


def tile_states(wanted: DataFrame, stored_tiles: DataFrame, absent: DataFrame, by: Sequence[str] = ("product", "z", "x", "y")) -> DataFrame:
    """``wanted`` tiles with ``state`` (``stored``, ``absent`` at the source, ``not_fetched``) and their missing pixels."""
    own = stored_tiles.select(*by, F.size(F.filter("pixels", lambda p: p.isNull())).alias("missing_pixels"), F.lit(True).alias("_stored"))
    gone = absent.select(*by).distinct().withColumn("_absent", F.lit(True))
    state = F.when(F.col("_stored"), "stored").when(F.col("_absent"), "absent").otherwise("not_fetched")
    return wanted.join(own, list(by), "left").join(gone, list(by), "left").withColumn("state", state).drop("_stored", "_absent")


def forecast_series(chunks: DataFrame, points: DataFrame, key: str, start: Column, hours: int, west: float, south: float, dx: float, dy: float) -> DataFrame:
    """``(key, variable, hour, value)`` for whole hours from ``start`` on, between the four grid points around each point.

    ``chunks`` have ``variable``, ``hour``, ``i``, ``j`` and ``value``; the hours asked for are a range filter on the
    scan, and what the data do not reach is left out.
    """
    first = F.date_trunc("hour", start)
    held = chunks.where((F.col("hour") >= first) & (F.col("hour") < first + F.make_dt_interval(hours=F.lit(hours))))
    fx, fy = (F.col("lon") - west) / dx, (F.col("lat") - south) / dy
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    placed = points.select(key, (fx - F.floor(fx)).alias("_fx"), (fy - F.floor(fy)).alias("_fy"), F.floor(fx).cast("int").alias("_i"), F.floor(fy).cast("int").alias("_j"), corners.alias("_c"))
    met = placed.select("*", (F.col("_i") + F.col("_c.a")).alias("i"), (F.col("_j") + F.col("_c.b")).alias("j")).join(held, ["i", "j"])
    at = lambda a, b: F.max(F.when((F.col("_c.a") == a) & (F.col("_c.b") == b), F.col("value")))
    own = met.groupBy(key, "variable", "hour", "_fx", "_fy").agg(*[at(a, b).alias(f"q{a}{b}") for a in (0, 1) for b in (0, 1)])
    return own.select(key, "variable", "hour", bilinear(*map(F.col, ("q00", "q10", "q01", "q11")), F.col("_fx"), F.col("_fy")).alias("value"))


def int64s(packed: Column) -> Column:
    """The little-endian 64-bit integers of a binary value (node ids as stored by a source); bytes left over are dropped."""

    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.frombuffer(v, "<i8", len(v) // 8), na_action="ignore")

    return F.pandas_udf(read, "array<bigint>")(packed)
