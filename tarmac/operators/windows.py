"""Ordered computations: elevation, trailing sums, Pareto fronts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import haversine_m
from tarmac.operators.prefix import running


def elevation_values(vertices: DataFrame, keys: Sequence[str], order: str = "ord", max_grade: float = 40.0) -> DataFrame:
    """Start, end, gain, loss and grade of each segment.

    Only vertices next to one another by number count as a step, so a gap gives no climb; on a structure only its ends
    count; a step steeper than ``max_grade`` percent is no plausible step.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    known = vertices.where(F.col("elev").isNotNull())
    ends = known.groupBy(*keys).agg(
        F.min_by("elev", order).alias("start_elev"), F.max_by("elev", order).alias("end_elev"), F.bool_or("on_structure").alias("structure"),
        F.min_by(F.struct("lon", "lat"), order).alias("_a"), F.max_by(F.struct("lon", "lat"), order).alias("_b"),
    )
    step = known.select(*keys, F.col(order), "elev", "lon", "lat", *[F.lag(c).over(by).alias(f"_{c}") for c in (order, "elev", "lon", "lat")])
    length = haversine_m(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))
    climb = F.col("elev") - F.col("_elev")
    fine = (F.col(order) == F.col(f"_{order}") + 1) & (length > 0) & (F.abs(climb) <= length * (max_grade / 100))
    sums = step.groupBy(*keys).agg(F.sum(F.when(fine & (climb > 0), climb)).alias("up"), F.sum(F.when(fine & (climb < 0), -climb)).alias("down"), F.count_if(fine).alias("steps"))
    total = F.col("end_elev") - F.col("start_elev")
    out = ends.join(sums, list(keys))
    gain = F.when(F.col("structure"), F.greatest(total, F.lit(0.0))).when(F.col("steps") > 0, F.coalesce("up", F.lit(0.0)))
    loss = F.when(F.col("structure"), F.greatest(-total, F.lit(0.0))).when(F.col("steps") > 0, F.coalesce("down", F.lit(0.0)))
    run = haversine_m(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))
    return out.select(*keys, "start_elev", "end_elev", gain.alias("gain"), loss.alias("loss"), F.when(run > 0, total / run * 100).alias("grade"))


def reversed_elevation(df: DataFrame) -> DataFrame:
    """The same segments the other way: ends and gain and loss swap, the grade turns its sign."""
    swap = {"start_elev": F.col("end_elev"), "end_elev": F.col("start_elev"), "gain": F.col("loss"), "loss": F.col("gain"), "grade": -F.col("grade")}
    return df.select(*[swap.get(c, F.col(c)).alias(c) for c in df.columns])


def trailing_sums(df: DataFrame, key: str, hour: str, value: str, hours: Sequence[int]) -> DataFrame:
    """Sums of the last k hours on a dense hourly series; any missing hour among them leaves none."""
    by = Window.partitionBy(key).orderBy(hour)
    frame = lambda k: by.rowsBetween(-(k - 1), 0)
    return df.select(key, hour, value, *[F.when(F.count(value).over(frame(k)) == k, F.sum(value).over(frame(k))).alias(f"{value}_{k}h") for k in hours])


def hours_since(df: DataFrame, key: str, hour: str, value: str, threshold: float, cap: int = 72) -> DataFrame:
    """Hours since the value last reached the threshold; a missing hour after that leaves none; ``cap`` if it never did."""
    by = Window.partitionBy(key).orderBy(hour)
    placed = df.withColumn("_n", F.row_number().over(by))
    last = F.last(F.when(F.col(value) >= threshold, F.col("_n")), ignorenulls=True).over(by)
    gap = F.last(F.when(F.col(value).isNull(), F.col("_n")), ignorenulls=True).over(by)
    since = F.when(gap.isNotNull() & (gap > F.coalesce(last, F.lit(0))), None).when(last.isNull(), cap).otherwise(F.least(F.col("_n") - last, F.lit(cap)))
    return placed.select(key, hour, value, since.cast("int").alias("hours_since"))


def pareto_front(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows that no other beats in both ``a`` and ``b`` (lower is better); equal rows stay together.

    The best ``b`` before each ``a`` is a running minimum over ranges of ``a``, so no task gets a whole front.
    """
    groups = df.groupBy(*keys, a).agg(F.min(b).alias(b))
    front = running(groups, keys, a, b, "min", inclusive=False).where(F.col("running").isNull() | (F.col(b) < F.col("running"))).drop("running")
    return df.join(front, [*keys, a, b], "left_semi")


def pareto_layers(df: DataFrame, a: str, b: str, layers: int) -> DataFrame:
    """``df`` with ``layer`` 0.. for the first ``layers`` fronts, each taken after those before it; later rows have none.

    In a layer-by-layer sweep a group's layer is at most its rank by ``b`` among equal ``a``, which bounds the candidates.
    """
    rank = F.dense_rank().over(Window.partitionBy(a).orderBy(b))
    groups = df.select(a, b).distinct().withColumn("_r", rank).where(F.col("_r") <= layers).select(a, b)
    rest, found = groups, None
    for layer in range(layers):
        front = pareto_front(rest, a, b).select(a, b, F.lit(layer).alias("layer"))
        found = front if found is None else found.unionByName(front)
        rest = rest.join(front, [a, b], "left_anti")
    return df.join(found, [a, b], "left")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
