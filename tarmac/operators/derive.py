"""Derivation of a road network: segments between junctions, nodes, counts, directions, land cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import bearing_deg, haversine_m
from tarmac.functions.tags import accident_weight, highway_rank, travel_direction
from tarmac.operators.aggregates import place_share
from tarmac.operators.lines import nearest_line
from tarmac.operators.spatial import clusters, near_any


def line_length(points: Column) -> Column:
    """Metres along an array of (lon, lat) points."""
    pairs = F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, p: total + haversine_m(p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"]))


def segments(ways: DataFrame) -> DataFrame:
    """Ways (``way``, ``node_ids``, ``points``) cut where any way passes a node twice over all, and at their ends.

    A span that ends where it began is cut once more in its middle, so no segment is a loop.  Segments of fewer than
    two different nodes are dropped; numbers run along the way from 0.
    """
    vertices = ways.select("way", F.posexplode("node_ids").alias("pos", "node"), F.size("node_ids").alias("n"))
    shared = vertices.groupBy("node").agg((F.count("*") > 1).alias("shared"))
    cuts = vertices.join(shared, "node").where(F.col("shared") | (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1))
    by = Window.partitionBy("way").orderBy("pos")
    spans = cuts.select("way", F.col("pos").alias("start"), F.col("node").alias("a"), F.lead("pos").over(by).alias("stop"), F.lead("node").over(by).alias("b")).where("stop is not null")
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    halves = F.when(
        (F.col("a") == F.col("b")) & (F.col("stop") - F.col("start") > 1),
        F.array(F.struct(F.col("start").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("stop").alias("e"))),
    ).otherwise(F.array(F.struct(F.col("start").alias("s"), F.col("stop").alias("e"))))
    pieces = spans.select("way", F.explode(halves).alias("p")).select("way", "p.s", "p.e").join(ways, "way")
    part = lambda c: F.slice(c, F.col("s") + 1, F.col("e") - F.col("s") + 1)
    own = pieces.select("way", "s", part("node_ids").alias("node_ids"), part("points").alias("points"))
    own = own.withColumn("from_node", F.element_at("node_ids", 1)).withColumn("to_node", F.element_at("node_ids", -1)).where("from_node <> to_node")
    first, second, last, before = (F.element_at("points", i) for i in (1, 2, -1, -2))
    there = bearing_deg(first["lon"], first["lat"], last["lon"], last["lat"])
    back = bearing_deg(last["lon"], last["lat"], first["lon"], first["lat"])
    number = (F.row_number().over(Window.partitionBy("way").orderBy("s")) - 1).cast("int")
    return own.select(
        "way", number.alias("segment"), "from_node", "to_node", "node_ids", "points", line_length(F.col("points")).alias("distance_m"), there.alias("bearing_deg"), back.alias("reverse_bearing_deg"),
        bearing_deg(first["lon"], first["lat"], second["lon"], second["lat"]).alias("bearing_in"), bearing_deg(before["lon"], before["lat"], last["lon"], last["lat"]).alias("bearing_out"),
    )


def branch_counts(edges: DataFrame) -> DataFrame:
    """``(node, branches)``: segment ends at each node."""
    ends = edges.select(F.explode(F.array("from_node", "to_node")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("branches"))


def classify_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``(node, kind)`` of the first rule (``tag``, ``value``, ``kind``, ``priority``) that a node's tags match.

    The rules are a dictionary of some dozens of rows; values of several parts are split on semicolons.
    """
    tags = nodes.select("node", F.explode("tags").alias("tag", "raw")).select("node", "tag", F.explode(F.split("raw", ";")).alias("value"))
    tags = tags.select("node", "tag", F.lower(F.trim("value")).alias("value"))
    matched = tags.join(rules, ["tag", "value"])
    return matched.groupBy("node").agg(F.min_by("kind", F.struct("priority", "kind")).alias("kind"))


def node_turns(edges: DataFrame, ways: DataFrame, nodes: DataFrame, signals: DataFrame, radius_m: float = 25.0) -> DataFrame:
    """``(node, signal, rank)``: whether a signal is near, and the highest rank of road that meets there."""
    ranked = edges.join(ways.select("way", highway_rank(F.col("highway")).alias("rank")), "way")
    ends = ranked.select("rank", F.explode(F.array("from_node", "to_node")).alias("node")).groupBy("node").agg(F.max("rank").alias("rank"))
    near = near_any(nodes.select("node", "lon", "lat"), signals.select("lon", "lat"), "node", radius_m).select("node").withColumn("signal", F.lit(True))
    return ends.join(near, "node", "left").select("node", F.coalesce("signal", F.lit(False)).alias("signal"), "rank")


def place_counts(edges: DataFrame, stops: DataFrame, eps_m: float = 40.0) -> DataFrame:
    """``(way, segment, kind, n)``: places of stops that a segment passes (1) or enters (one half).

    Stops (``node``, ``kind``, ``lon``, ``lat``) of a kind within ``eps_m`` of one another make one place; a segment
    touches the place whose stop lies on its nodes, and an end inside belongs to a place by its node.
    """
    placed = stops.join(clusters(stops.withColumnRenamed("node", "key"), "key", eps_m, ["kind"]).withColumnRenamed("key", "node"), "node")
    on = edges.select("way", "segment", "from_node", "to_node", F.explode("node_ids").alias("node")).join(placed.select("node", "kind", "cluster"), "node")
    inside = F.when(F.col("node") == F.col("from_node"), 1).otherwise(0) + F.when(F.col("node") == F.col("to_node"), 1).otherwise(0)
    each = on.groupBy("way", "segment", "kind", "cluster").agg(F.sum(inside).alias("ends"))
    return each.groupBy("way", "segment", "kind").agg(F.sum(place_share(F.col("ends"))).alias("n"))


def intersection_counts(edges: DataFrame) -> DataFrame:
    """``(way, segment, n)``: half an intersection for each end at a node of three or more branches."""
    branches = branch_counts(edges)
    ends = edges.select("way", "segment", F.explode(F.array("from_node", "to_node")).alias("node"))
    return ends.join(branches, "node").groupBy("way", "segment").agg((F.count_if(F.col("branches") >= 3) * 0.5).alias("n"))


def accident_counts(edges: DataFrame, accidents: DataFrame, radius_m: float = 30.0) -> DataFrame:
    """``(edge, n)``: accidents with a bicycle, weighted, at the nearest segment (``edge``, ``points``) within the radius of its line; ties go to the smaller key."""
    bicycle = F.col("party_a").isin("bicycle", "power_assisted_bicycle") | F.col("party_b").isin("bicycle", "power_assisted_bicycle")
    own = accidents.where(F.coalesce(bicycle, F.lit(False))).select("accident", "lon", "lat", accident_weight(F.col("deaths")).alias("weight"))
    matched = nearest_line(own, edges, "accident", "edge", radius_m)
    return matched.join(own, "accident").groupBy("edge").agg(F.sum("weight").alias("n"))


def way_totals(values: DataFrame, columns: list[str]) -> DataFrame:
    """Segment counts added up for each way."""
    return values.groupBy("way").agg(*[F.sum(c).alias(c) for c in columns])


def way_directions(ways: DataFrame) -> DataFrame:
    """``(way, direction)`` from the tags."""
    tag = lambda name: F.lower(F.trim(F.try_element_at("tags", F.lit(name))))
    return ways.select("way", travel_direction(tag("oneway:bicycle"), tag("oneway"), tag("junction")).alias("direction"))


def unchanged(old: DataFrame, new: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """Rows of ``old`` whose key and shape are in ``new`` as they were: their derived values can be used again."""
    same = new.select(*keys, F.xxhash64(shape).alias("_h"))
    return old.withColumn("_h", F.xxhash64(shape)).join(same, [*keys, "_h"], "left_semi").drop("_h")
