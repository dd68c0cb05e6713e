"""Places: clean-up and merging of points of interest, and search over an address tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import haversine_m
from tarmac.functions.text import like_prefix, name_key, phone, website
from tarmac.operators.components import connected
from tarmac.operators.spatial import clusters
from tarmac.storage import dealt, stored


def grouped(places: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """``places`` with ``group`` by the first group that has any of their categories; others go."""
    found = F.lit(None).cast("string")
    for name, words in reversed(list(groups.items())):
        found = F.when(F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, words))), F.lit(False)), name).otherwise(found)
    return places.withColumn("group", found).where("group is not null")


def merge_by_contact(places: DataFrame, span_m: float = 200.0) -> DataFrame:
    """Places of a group that share a phone number or web address go, but for the most confident, if they lie close together.

    A contact that spans more than ``span_m`` belongs to a chain and merges nothing.
    """
    contacts = places.select("id", "group", "lon", "lat", F.explode(F.concat(F.transform("phones", phone), F.transform("websites", website))).alias("contact")).where("contact is not null")
    near = contacts.groupBy("group", "contact").agg(
        F.count_distinct("id").alias("n"), haversine_m(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("span")
    ).where((F.col("n") > 1) & (F.col("span") <= span_m))
    shared = contacts.join(near.select("group", "contact"), ["group", "contact"])
    first = shared.groupBy("group", "contact").agg(F.min("id").alias("first"))
    links = shared.join(first, ["group", "contact"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    return _best_of(places, connected(links))


def merge_by_name(places: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """Places of a group with the same name key go, but for the most confident of each cluster."""
    keyed = places.withColumn("_name", name_key(F.col("name")))
    found = clusters(keyed.where("_name <> ''"), "id", radius_m, ["group", "_name"])
    return _best_of(places, found.withColumnRenamed("id", "node").withColumnRenamed("cluster", "root"))


def _best_of(places: DataFrame, roots: DataFrame) -> DataFrame:
    named = places.select("id", "confidence").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    best = named.groupBy("root").agg(F.min_by("id", F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("id"))).alias("id"))
    return places.join(best, "id", "left_semi")


def chain_of(name, words: Mapping[str, str]):
    """The chain of the first word that a name contains."""
    out = F.lit(None).cast("string")
    for word, chain in reversed(list(words.items())):
        out = F.when(F.contains(name, F.lit(word)), chain).otherwise(out)
    return out


def ancestors(areas: DataFrame, rounds: int = 12) -> DataFrame:
    """``(area, ancestor, up)`` for every area and each area above it, itself at 0.  Trees of addresses are some levels deep."""
    step = areas.select(F.col("area").alias("ancestor"), F.col("parent").alias("_next"))
    out = level = areas.select("area", F.col("area").alias("ancestor"), F.lit(0).alias("up"))
    for up in range(1, rounds):
        level = stored(level.join(step, "ancestor").where("_next is not null").select("area", F.col("_next").alias("ancestor"), F.lit(up).alias("up")))
        out = out.unionByName(level)
        if level.isEmpty():
            return out
    raise RuntimeError("the tree is deeper than expected, or no tree")


def full_names(areas: DataFrame) -> DataFrame:
    """``(area, names)``: the names from the root down to each area."""
    names = areas.select(F.col("area").alias("ancestor"), "name")
    up = ancestors(areas).join(names, "ancestor")
    return up.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), "name"))), lambda x: x["name"]).alias("names"))


def search(keys: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Areas under the longest prefix of ``text`` that is a key, or whose keys start with ``text``; shorter keys first."""
    asked = F.lit(text)
    exact = keys.where(F.startswith(asked, F.col("key"))).withColumn("_length", F.length("key"))
    longest = exact.agg(F.max("_length").alias("_length"))  # one row
    best = exact.join(F.broadcast(longest), "_length").select("area", "key", F.lit(0).alias("kind"))
    longer = keys.where(F.col("key").like(text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")).select("area", "key", F.lit(1).alias("kind"))
    hits = best.unionByName(longer).groupBy("area").agg(F.min(F.struct("kind", F.length("key").alias("n"), "key")).alias("h"))
    return hits.select("area", "h.kind", "h.key").orderBy("kind", F.length("key"), "key", "area").limit(limit)


def link_names(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """``(left_id, right_id, rank)``: each left name's right name that equals it (0), else the longest that starts it (1), else that ends it (2)."""
    parts = F.sequence(F.lit(1), F.length(key))
    candidates = dealt(left.select("left_id", key), "left_id", rows=1 << 15).select("left_id", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col(key).alias("part"))),
        F.transform(parts, lambda i: F.struct(F.lit(1).alias("rank"), F.substring(F.col(key), F.lit(1), i).alias("part"))),
        F.transform(parts, lambda i: F.struct(F.lit(2).alias("rank"), F.substring(F.col(key), i, F.length(key)).alias("part"))),
    )).alias("c")).select("left_id", "c.rank", "c.part")
    met = candidates.join(right.groupBy(F.col(key).alias("part")).agg(F.min(F.struct("right_id")).alias("r")).select("part", "r.right_id"), "part")
    best = met.groupBy("left_id").agg(F.min(F.struct("rank", (-F.length("part")).alias("n"), "right_id")).alias("b"))
    return best.select("left_id", "b.right_id", "b.rank")


def with_missing_parents(areas: DataFrame, parent_of: DataFrame) -> DataFrame:
    """``areas`` (``area``, ``parent``, ``name``, ``lon``, ``lat``) with a row for each parent that has children but no row.

    Such a parent stands in the middle of its children; its own parent and name come from ``parent_of`` (``area``,
    ``parent``, ``name``), without which it is left out.
    """
    missing = areas.where("parent is not null").select(F.col("parent").alias("_p"), "lon", "lat").join(areas.select(F.col("area").alias("_p")), "_p", "left_anti")
    middle = missing.groupBy(F.col("_p").alias("area")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    made = middle.join(parent_of.select("area", "parent", "name"), "area").select(*areas.columns)
    return areas.unionByName(made)


def in_range(areas: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Areas whose point lies in the box, and all areas above them."""
    inside = areas.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])).select("area")
    kept = ancestors(areas).join(inside, "area", "left_semi").select(F.col("ancestor").alias("area")).distinct()
    return areas.join(kept, "area", "left_semi")


def ranked_hits(hits: DataFrame, levels: Sequence[str], lon: float, lat: float, limit: int) -> DataFrame:
    """``hits`` (several a place: ``area``, ``level``, ``numbered``, ``continued``, ``lon``, ``lat``) as one row a place with ``position``.

    A place's best hit counts; then its level in the given order, whether the query goes on in it, distance and id.
    """
    best = hits.groupBy("area", "level", "lon", "lat").agg(F.min("numbered").alias("numbered"), F.min("continued").alias("continued"))
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    away = haversine_m(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    order = [F.col("numbered"), rank, F.col("continued"), away, F.col("area")]
    few = best.orderBy(*order).limit(limit)
    return few.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # of the few


def nearest_places(places_: DataFrame, key: str, lon: float, lat: float, limit: int) -> DataFrame:
    """The ``limit`` nearest places by exact distance; one ordering, which Spark takes as the best of each partition's best."""
    away = haversine_m(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return places_.withColumn("dist_m", away).orderBy("dist_m", key).limit(limit)


def in_order(*results: DataFrame) -> DataFrame:
    """Results one after another: ``source`` numbers them, and each keeps its own ``position``."""
    numbered = [r.withColumn("source", F.lit(i)) for i, r in enumerate(results)]
    out = numbered[0]
    for more in numbered[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.orderBy("source", "position")


def group_of(word: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """The group that a query word names; a text that only contains such a word is a name and has none."""
    from tarmac.functions.text import query_word

    asked, out = query_word(word), F.lit(None).cast("string")
    for name, words in reversed(list(groups.items())):
        out = F.when(F.array_contains(F.array(*[query_word(F.lit(w)) for w in words]), asked), name).otherwise(out)
    return out


__all__ = ["ancestors", "chain_of", "full_names", "grouped", "group_of", "in_order", "in_range", "like_prefix", "link_names", "merge_by_contact", "merge_by_name", "nearest_places", "ranked_hits", "search", "with_missing_parents"]
