"""Weighted statistics, shares and route-level aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.numbers import round_significant, round_tenth
from tarmac.operators.prefix import running
from tarmac.storage import measured, stored


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: values without a weight or weights without a value do not count; null without any."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.nullif(F.sum(F.when(both, weight)), F.lit(0.0)))


def cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """One row for each key and different value, with its weight, the weight up to it, and the key's total."""
    sums = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    steps = running(sums, keys, value, "w").withColumnRenamed("running", "upto")
    total = steps.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("upto").alias("total"))  # a row a key
    if not keys:
        return steps.crossJoin(F.broadcast(total))
    steps, total = stored(steps), _few(total)
    return steps.join(total, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])).drop(*[f"_k_{k}" for k in keys])


def _few(by_key: DataFrame, most: int = 100_000) -> DataFrame:
    """A row a key, stored, and broadcast if they are few: rows of a key would meet in one task, and few keys have large ones."""
    out, seen = measured(by_key, n=F.count(F.lit(1)))
    return F.broadcast(out) if seen["n"] <= most else out


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, targets: Sequence[float]) -> DataFrame:
    """The inverted weighted distribution: for each target the first value whose cumulative weight reaches it."""
    steps = cumulative(df, keys, value, weight)
    picks = [F.min(F.when(F.col("upto") >= F.col("total") * q - F.col("total") * 1e-12, F.col(value))).alias(f"q{round(q * 1000):03d}") for q in targets]
    return steps.groupBy(*keys).agg(*picks)


def weighted_histogram(df: DataFrame, keys: Sequence[str], value: str, weight: str, bins: int = 60, stretch: float = 1.2) -> DataFrame:
    """Weight by bin over [min(0, least), stretch * 99th percentile]; values beyond fold into the edge bins; empty bins count 0."""
    edges = weighted_quantiles(df, keys, value, weight, [0.99])
    low = df.where(F.col(weight) > 0).groupBy(*keys).agg(F.least(F.lit(0.0), F.min(value)).alias("low"))
    edges = edges.join(low, list(keys)).withColumn("width", F.greatest(F.col("q990") * stretch - F.col("low"), F.lit(1e-9)) / bins)
    place = F.least(F.greatest(F.floor((F.col(value) - F.col("low")) / F.col("width")), F.lit(0)), F.lit(bins - 1)).cast("int")
    edges = _few(edges)
    filled = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).join(edges, list(keys))
    counts = filled.groupBy(*keys, place.alias("bin")).agg(F.sum(weight).alias("w"))
    spine = edges.select(*keys, "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counts, [*keys, "bin"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def spread(df: DataFrame, keys: Sequence[str], value: str, weight: str, targets: Sequence[float]) -> DataFrame:
    """Quantiles and the share of weight that lies exactly at zero."""
    zero = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys).agg((F.sum(F.when(F.col(value) == 0, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("zero_share"))
    return weighted_quantiles(df, keys, value, weight, targets).join(zero, list(keys))


def preview(df: DataFrame, keys: Sequence[str], value: str, weight: str, share: float, limit: int | None, targets: Sequence[float], seed: int = 7) -> DataFrame:
    """Quantiles and the share at zero of a seeded sample of at most ``limit`` rows (None: all of the sample), for a quick look at a material."""
    sample = df.select(*keys, value, weight)
    sample = sample.sample(share, seed=seed) if share < 1 else sample
    return spread(sample if limit is None else sample.limit(limit), keys, value, weight, targets)


def category_shares(df: DataFrame, keys: Sequence[str], category: str, weight: str, digits: int = 4) -> DataFrame:
    """The share of each category by weight, ranked by share, then name."""
    sums = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.sum(weight).alias("w"))
    share = F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy(*keys)), F.lit(0.0))
    by = Window.partitionBy(*keys).orderBy(F.desc("share"), category)
    return sums.withColumn("share", share).withColumn("place", F.row_number().over(by)).withColumn("share", F.round("share", digits)).drop("w")


def percent_shares(df: DataFrame, key: str, kind: str, count: str, kinds: Sequence, invalid: Sequence, least: float) -> DataFrame:
    """The percentage of each kind among valid ones; keys with fewer than ``least`` valid counts are left out."""
    valid = ~F.col(kind).isin(*invalid) if invalid else F.lit(True)
    sums = [F.sum(F.when(F.col(kind) == k, F.col(count)).otherwise(0)).alias(f"_{k}") for k in kinds]
    out = df.where(valid).groupBy(key).agg(F.sum(count).alias("_valid"), *sums).where(F.col("_valid") >= least)
    return out.select(key, *[(F.col(f"_{k}") * 100.0 / F.col("_valid")).alias(f"{k}_percent") for k in kinds])


def place_share(ends_inside: Column) -> Column:
    """How often a segment counts a place: once if it passes, half if one end lies inside, not at all if both do."""
    return F.when(ends_inside == 0, 1.0).when(ends_inside == 1, 0.5).otherwise(0.0)


def distance_bins(df: DataFrame, keys: Sequence[str], order: str, distance_km: str, step: float = 0.5) -> DataFrame:
    """``df`` with ``bin``: segments gather in order until their length reaches ``step``, then a new bin starts.

    Where a bin ends depends on all before it, so each key's ordered segments are folded (a route has some hundred).
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(distance_km).alias("d"))))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("bins"))

    def fold(state: Column, row: Column) -> Column:
        total = state["sum"] + row["d"]
        full = total >= step
        return F.struct(F.when(full, 0.0).otherwise(total).alias("sum"), (state["bin"] + full.cast("int")).alias("bin"), F.concat(state["bins"], F.array(state["bin"])).alias("bins"))

    folded = df.groupBy(*keys).agg(rows.alias("rows")).select(*keys, "rows", F.aggregate("rows", zero, fold)["bins"].alias("bins"))
    placed = folded.select(*keys, F.explode(F.arrays_zip("rows", "bins")).alias("z")).select(*keys, F.col("z.rows.o").alias(order), F.col("z.bins").alias("bin"))
    return df.join(placed, [*keys, order])


def overall(df: DataFrame, keys: Sequence[str], difficulty: str, distance_km: str) -> DataFrame:
    """Average difficulty, rounded to a tenth, and load: the average times the length."""
    out = df.groupBy(*keys).agg(weighted_mean(F.col(difficulty), F.col(distance_km)).alias("_mean"), F.sum(distance_km).alias("length_km"))
    return out.select(*keys, "length_km", round_tenth(F.col("_mean")).alias("average"), round_tenth(F.col("_mean") * F.col("length_km")).alias("load"))


def merge_maps(df: DataFrame, keys: Sequence[str], values: str, weight: str, digits: int | None = None) -> DataFrame:
    """Weighted mean by map key; a row without a key does not count for it."""
    rows = df.select(*keys, weight, F.explode(values).alias("_k", "_v"))
    mean = rows.groupBy(*keys, "_k").agg(weighted_mean(F.col("_v"), F.col(weight)).alias("_m")).where("_m is not null")
    value = F.col("_m") if digits is None else round_significant(F.col("_m"), digits)
    return mean.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", value.alias("_v"))))).alias(values))


def overlap_ratio(candidates: DataFrame, chosen: DataFrame, route: str, a: str, b: str, length: str) -> DataFrame:
    """For each candidate route the share of its length on segments that a chosen route has too, either way."""
    ends = lambda df: df.withColumn("_s", F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")))
    once = ends(candidates).groupBy(route, "_s").agg(F.max(length).alias("l"))
    known = ends(chosen).select("_s").distinct().withColumn("_hit", F.lit(True))
    return once.join(known, "_s", "left").groupBy(route).agg((F.sum(F.when(F.col("_hit"), F.col("l")).otherwise(0.0)) / F.nullif(F.sum("l"), F.lit(0.0))).alias("overlap"))


def retraced_share(df: DataFrame, route: str, a: str, b: str, length: str) -> DataFrame:
    """The share of a route's length that is not the first passage of its segment."""
    each = df.groupBy(route, F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.max(length).alias("once"), F.sum(length).alias("all"))
    return each.groupBy(route).agg((1 - F.sum("once") / F.nullif(F.sum("all"), F.lit(0.0))).alias("retraced"))


def saturation(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Shares at or beyond two scores, and of the most frequent value."""
    by = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return by.agg(
        (F.sum(F.when(F.col(column) <= low, F.col("count")).otherwise(0)) / F.sum("count")).alias("low_share"),
        (F.sum(F.when(F.col(column) >= high, F.col("count")).otherwise(0)) / F.sum("count")).alias("high_share"),
        (F.max("count") / F.sum("count")).alias("mode_share"),
    )
