"""Routes: bands of turning points, ranked candidates, legs in hourly bins, passages, return legs, merged values.

Tables of candidates, legs and route rows are ordinary DataFrames with a row each; a route's own rows are ordered by
``step`` and folded inside one row only where each step depends on the one before (a route has some hundred).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import folded_angle_deg, haversine_m
from tarmac.functions.numbers import round_tenth
from tarmac.operators.aggregates import weighted_mean
from tarmac.operators.prefix import running
from tarmac.operators.windows import pareto_layers
from tarmac.storage import measured, stored


def ring(target_km: float, tolerance_km: float, shortest: float, longest: float) -> tuple[float, float]:
    """Metres out to a turning point: a loop of ``shortest`` to ``longest`` times that must meet the target; else half the target."""
    low, high = max(0.0, (target_km - tolerance_km) * 1000 / shortest), (target_km + tolerance_km) * 1000 / longest
    return (low, high) if low <= high else (max(0.0, (target_km - tolerance_km) * 500), (target_km + tolerance_km) * 500)


def relay_band(head_m: Column, back_m: Column, target_km: float, tolerance_km: float, shortest: float, longest: float) -> tuple[Column, Column]:
    """Whether a route over a relay point can meet the target, and by how much its expected length misses it.

    ``head_m`` leads to the point and ``back_m`` is the shortest way home, ridden at ``shortest`` to ``longest`` times
    that.  Where this span is wider than the tolerance allows, only its lower end counts.
    """
    target, tolerance = target_km * 1000, tolerance_km * 1000
    low = head_m + back_m * shortest
    high = F.when(back_m * (longest - shortest) > 2 * tolerance, low).otherwise(head_m + back_m * longest)
    middle = head_m + back_m * ((shortest + longest) / 2)
    return F.coalesce((low >= target - tolerance) & (high <= target + tolerance), F.lit(False)), F.abs(middle - target)


def ranked_candidates(df: DataFrame, key: str, distance: str, cost: str, seconds: str, penalty: float, layers: int = 3, distance_step: float = 100.0) -> DataFrame:
    """``df`` with ``difficulty``, ``layer`` and ``position``: fronts of distance and difficulty, then difficulty, distance, key.

    The difficulty is taken back out of the cost.  Rows beyond the last layer come after all layers.
    """
    df = df.withColumn("difficulty", round_tenth((F.col(cost) / F.col(seconds) - 1) * 100 / penalty)).withColumn("_near", F.floor(F.col(distance) / distance_step))
    layered = pareto_layers(df, "_near", "difficulty", layers)
    order = F.struct(F.coalesce("layer", F.lit(layers)), "difficulty", distance, key)
    placed = running(layered.drop("_near").withColumn("_order", order).withColumn("_one", F.lit(1)), [], "_order", "_one")
    return placed.withColumn("position", F.col("running").cast("int")).drop("_order", "_one", "running")


def spread_order(remaining: DataFrame, chosen: DataFrame, key: str, bearing: str, closeness: str) -> DataFrame:
    """``remaining`` with ``gap``, the smallest angle to a chosen bearing, for ordering: the widest first, then the closest, then the key."""
    taken = chosen.agg(F.collect_list(bearing).alias("_taken"))  # a handful of accepted routes
    gap = F.array_min(F.transform("_taken", lambda b: folded_angle_deg(F.col(bearing), b)))
    return remaining.crossJoin(F.broadcast(taken)).withColumn("gap", gap).drop("_taken").orderBy(F.desc_nulls_last("gap"), closeness, key)


def pick_diverse(candidates: DataFrame, rows: DataFrame, wanted: int, thresholds: Sequence[float] = (0.6, 0.85), by: Sequence[str] = (), spread: bool = False, part_rows: int = 1 << 18) -> DataFrame:
    """``(*by, route, choice)``: of each request the first ``wanted`` ranked candidates none of which overlaps a chosen one too much.

    ``candidates`` (``route``, ``position``) are taken in order of position, ``rows`` (``route``, ``segment``, ``length``) are what they run
    over; the overlap is the share of a candidate's length that a chosen one covers too, a segment counting once.
    Where no candidate is left within the first threshold, the next one holds.  With ``spread``, candidates of one position
    are a tie that goes to the widest angle from all chosen ``bearing``s, then the smallest ``closeness``, then the route.
    A candidate without rows is no route.

    A round chooses one route of every request and compares the rest with that one alone, by segment, so rounds are as
    many as are wanted and no pairs of candidates are made.  Tasks get about ``part_rows`` segments each, however many there are.
    """
    by = list(by)
    own, size = measured(rows.groupBy(*by, "route", "segment").agg(F.max("length").cast("double").alias("length")), n=F.count(F.lit(1)))
    parts = max(own.sparkSession.sparkContext.defaultParallelism, -(-(size["n"] or 0) // part_rows))
    total = own.groupBy(*by, "route").agg(F.sum("length").alias("total"))
    extra = ["bearing", "closeness"] if spread else []
    state = stored(candidates.join(total, [*by, "route"]).select(*by, "route", "position", "total", *extra, F.lit(0.0).alias("worst"), F.lit(None).cast("double").alias("gap")))
    chosen = []
    for choice in range(1, wanted + 1):
        step = F.coalesce(*[F.when(F.col("worst") <= t, i) for i, t in enumerate(thresholds)])
        tie = [F.coalesce(-F.col("gap"), F.lit(1.0)).alias("_gap"), F.col("closeness")] if spread else []
        first = state.withColumn("_step", step).where("_step is not null").groupBy(*by).agg(F.min(F.struct("_step", "position", *tie, "route", *extra[:1])).alias("_f"))
        picked, seen = measured(first.where("_f is not null").select(*by, F.col("_f.route").alias("route"), *[F.col(f"_f.{c}").alias(f"_{c}") for c in extra[:1]]), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        chosen.append(picked.select(*by, "route", F.lit(choice).alias("choice")))
        key = [*by, "segment"]
        shared = own.repartition(parts, *key).join(picked.select(*by, "route").join(own, [*by, "route"]).select(*key), key, "left_semi").groupBy(*by, "route").agg(F.sum("length").alias("_shared"))
        state = state.repartition(parts, *by, "route").join(picked.select(*by, "route"), [*by, "route"], "left_anti").join(shared, [*by, "route"], "left")
        state = state.withColumn("worst", F.greatest("worst", F.coalesce(F.try_divide(F.col("_shared"), F.col("total")), F.lit(0.0))))
        if spread:
            last = picked.select(*by, "_bearing")
            state = state.join(last, by) if by else state.crossJoin(F.broadcast(last))  # one row without requests
            state = state.withColumn("gap", F.least("gap", folded_angle_deg(F.col("bearing"), F.col("_bearing"))))
        state = stored(state.select(*by, "route", "position", "total", *extra, "worst", "gap"))
    if not chosen:
        return state.select(*by, "route", F.lit(0).alias("choice")).limit(0)
    return reduce(DataFrame.unionByName, chosen)


def far_apart(candidates: DataFrame, chosen: DataFrame, least_m: float) -> DataFrame:
    """Candidates that lie at least ``least_m`` from every chosen point (``lon``, ``lat``)."""
    points = chosen.agg(F.collect_list(F.struct("lon", "lat")).alias("_points"))
    near = F.exists("_points", lambda p: haversine_m(F.col("lon"), F.col("lat"), p["lon"], p["lat"]) < least_m)
    return candidates.crossJoin(F.broadcast(points)).where(~near).drop("_points")


def via_nodes(there: DataFrame, back: DataFrame, stretch: float = 1.3) -> DataFrame:
    """``(node, cost, length_m, best)`` of the nodes whose way from start to goal is at most ``stretch`` times as long as the best one's.

    ``there`` and ``back`` have ``node``, ``cost`` and ``length_m`` to the start and to the goal.  The cheapest node (the
    smallest on ties) is the best and always stays.
    """
    both = there.select("node", F.col("cost").alias("_c"), F.col("length_m").alias("_l")).join(back, "node")
    both = both.select("node", (F.col("_c") + F.col("cost")).alias("cost"), (F.col("_l") + F.col("length_m")).alias("length_m"))
    best = both.agg(F.min(F.struct("cost", "node", "length_m")).alias("_b"))  # one row
    out = both.crossJoin(F.broadcast(best)).where(F.col("length_m") <= F.col("_b.length_m") * stretch)
    return out.select("node", "cost", "length_m", (F.col("node") == F.col("_b.node")).alias("best"))


def without_shared_halves(halves: DataFrame, route: str, leg: str, segment: str) -> DataFrame:
    """Routes of which no segment, in either direction, lies on both legs."""
    ends = F.min(leg), F.max(leg)
    legs = halves.groupBy(route, segment).agg(F.when(ends[0] == ends[1], 1).when(ends[0] < ends[1], 2).otherwise(0).alias("_n"))
    return legs.groupBy(route).agg(F.max("_n").alias("_n")).where("_n = 1").select(route)


def leg_costs(edges: DataFrame, hourly: DataFrame, key: str, penalty: float, bins: int = 4) -> DataFrame:
    """``(key, bin, seconds, cost)`` for each edge and hour of a leg, in long form.

    ``edges`` have ``seconds``, ``fixed_score`` and ``fixed_weight``, what does not change with time; ``hourly`` has
    (``key``, ``bin``, ``factor``, ``score``, ``weight``) where something does.  An hour without a row keeps the fixed
    part; an edge without any score costs its seconds.
    """
    spine = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    both = spine.join(hourly, [key, "bin"], "left")
    seconds = F.col("seconds") * F.coalesce("factor", F.lit(1.0))
    moving = F.col("score").isNotNull() & F.col("weight").isNotNull()
    weight = F.coalesce("fixed_weight", F.lit(0.0)) + F.when(moving, F.col("weight")).otherwise(0.0)
    score = F.coalesce(F.col("fixed_score") * F.col("fixed_weight"), F.lit(0.0)) + F.when(moving, F.col("score") * F.col("weight")).otherwise(0.0)
    return both.select(key, "bin", seconds.alias("seconds"), (seconds * (1 + penalty * F.coalesce(F.try_divide(score, weight), F.lit(0.0)) / 100)).alias("cost"))


def passages(rows: DataFrame, route: str, bins: int, bin_seconds: float = 3600.0, cruise_ms: float = 5.0, step: str = "step") -> DataFrame:
    """``(route, step, bin, elapsed, seconds, beyond)``: when each row of a route is entered, and how long it takes.

    ``rows`` have ``leg``, ``distance_m``, ``wait`` (the turn into the next row) and ``seconds_by_bin``.  The bin is that
    of the time since the leg began, before the turn into the row; waits count within a leg and for the whole route.
    Seconds that are missing or infinite are those at cruising speed.
    """
    listed = rows.groupBy(route).agg(F.array_sort(F.collect_list(F.struct(step, "leg", "distance_m", F.coalesce("wait", F.lit(0.0)).alias("wait"), "seconds_by_bin"))).alias("r"))
    one = F.struct(F.lit(0).alias("bin"), F.lit(0.0).alias("elapsed"), F.lit(0.0).alias("seconds"), F.lit(False).alias("beyond"))
    zero = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("own"), F.lit(None).cast("int").alias("leg"), F.lit(0.0).alias("wait"), F.slice(F.array(one), 1, 0).alias("out"))

    def enter(s: Column, x: Column) -> Column:
        same = F.coalesce(s["leg"] == x["leg"], F.lit(False))
        clock = F.when(same, s["own"]).otherwise(0.0)  # the bin is read before the turn's wait is added
        at = F.least(F.floor(clock / bin_seconds), F.lit(bins - 1)).cast("int")
        given = F.get(x["seconds_by_bin"], at)
        takes = F.when(given.isNotNull() & ~F.isnan(given) & (F.abs(given) != float("inf")), given).otherwise(x["distance_m"] / cruise_ms)
        entry = F.struct(at.alias("bin"), (s["all"] + s["wait"]).alias("elapsed"), takes.alias("seconds"), (F.lit(bins > 1) & (clock >= bins * bin_seconds)).alias("beyond"))
        return F.struct((s["all"] + s["wait"] + takes).alias("all"), (F.when(same, s["own"] + s["wait"]).otherwise(0.0) + takes).alias("own"), x["leg"].alias("leg"), x["wait"].alias("wait"), F.concat(s["out"], F.array(entry)).alias("out"))

    # the wait after a row belongs to the leg only if the next row does, so it is added on entering that one
    folded = listed.select(route, "r", F.aggregate("r", zero, enter)["out"].alias("o"))
    return folded.select(route, F.explode(F.arrays_zip("r", "o")).alias("z")).select(route, F.col(f"z.r.{step}").alias(step), "z.o.*")


def halves(rows: DataFrame, route: str, weight: str, step: str = "step") -> DataFrame:
    """``rows`` with ``leg``: 0 while less than half of the route's weight lies before a row, 1 after that."""
    by = Window.partitionBy(route)
    before = F.coalesce(F.sum(weight).over(by.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("leg", F.when(before < F.sum(weight).over(by) / 2, 0).otherwise(1))


def retrace_penalised(edges: DataFrame, travelled: DataFrame, factor: float = 8.0, cost: str = "cost") -> DataFrame:
    """``edges`` with the cost of those between the same two nodes as a travelled edge, in either direction, times ``factor``."""
    pair = lambda df: df.withColumn("_x", F.least("tail", "head")).withColumn("_y", F.greatest("tail", "head"))
    known = pair(travelled).select("_x", "_y").distinct().withColumn("_hit", F.lit(True))
    out = pair(edges).join(known, ["_x", "_y"], "left")
    return out.withColumn(cost, F.when(F.col("_hit"), F.col(cost) * factor).otherwise(F.col(cost))).drop("_x", "_y", "_hit")


def loops_within(loops: DataFrame, target_km: float, tolerance_km: float, length_km: str = "length_km") -> DataFrame:
    """Loops whose length meets the target, with ``miss_km`` to order by."""
    return loops.withColumn("miss_km", F.abs(F.col(length_km) - target_km)).where(F.col("miss_km") <= tolerance_km)


def similar_loops(candidates: DataFrame, accepted: DataFrame, route: str, a: str, b: str, length: str, share: float = 0.7, prefix: int = 0, step: str = "step") -> DataFrame:
    """``(route, other)``: candidates of which more than ``share`` of the length lies on an accepted loop, either way; a fixed start is left out."""
    ends = lambda df: df.where(F.col(step) >= prefix).withColumn("_x", F.least(a, b)).withColumn("_y", F.greatest(a, b))
    own = ends(candidates).groupBy(route, "_x", "_y").agg(F.max(length).alias("_l"))
    total = own.groupBy(route).agg(F.sum("_l").alias("_all"))
    known = ends(accepted).select(F.col(route).alias("other"), "_x", "_y").distinct()
    shared = own.join(known, ["_x", "_y"]).groupBy(route, "other").agg(F.sum("_l").alias("_s"))
    return shared.join(total, route).where((F.col("_s") > F.col("_all") * share) & (F.col("other") != F.col(route))).select(route, "other")


def reversed_rows(rows: DataFrame, route: str, step: str = "step") -> DataFrame:
    """A route's rows the other way round: last first, ends swapped."""
    last = F.max(step).over(Window.partitionBy(route))
    swap = {"tail": F.col("head"), "head": F.col("tail"), step: last - F.col(step)}
    return rows.select(*[swap.get(c, F.col(c)).alias(c) for c in rows.columns])


def easier_direction(rows: DataFrame, route: str, there: str, back: str, distance: str) -> DataFrame:
    """``(route, reversed, difficulty)``: the way round with the smaller mean difficulty; as given where the other has none or is no easier."""
    both = rows.groupBy(route).agg(weighted_mean(F.col(there), F.col(distance)).alias("_f"), weighted_mean(F.col(back), F.col(distance)).alias("_r"))
    turn = F.col("_r").isNotNull() & (F.col("_f").isNull() | (F.col("_r") < F.col("_f")))
    return both.select(route, turn.alias("reversed"), F.when(turn, F.col("_r")).otherwise(F.col("_f")).alias("difficulty"))


def with_baseline(candidates: DataFrame, key: str, difficulty: str, baseline: str, wanted: int) -> DataFrame:
    """The ``wanted`` easiest candidates in order (``position``); the baseline stays among them if there are two or more."""
    order = [F.col(difficulty).isNull(), F.col(difficulty), F.col(key)]
    first = F.when(F.col(baseline) & F.lit(wanted >= 2), 0).otherwise(1)
    kept = candidates.orderBy(first, *order).limit(wanted)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # of the wanted few


def missing_share(rows: DataFrame, route: str, value: str, distance: str) -> DataFrame:
    """The share of each route's length without a value."""
    return rows.groupBy(route).agg(F.try_divide(F.sum(F.when(F.col(value).isNull(), F.col(distance)).otherwise(0.0)), F.sum(distance)).alias("missing"))


def winds_at(entered: DataFrame, winds: DataFrame, start: Column, hour: str = "hour", point: str = "point") -> DataFrame:
    """``entered`` (with ``elapsed`` seconds and a ``point``) with the wind of the nearest hour there; times beyond the series take its end."""
    ends = winds.agg(F.min(hour).alias("_a"), F.max(hour).alias("_b"))  # one row
    nearest = F.floor((F.unix_timestamp(start) + F.col("elapsed")) / 3600 + 0.5) * 3600
    at = entered.crossJoin(F.broadcast(ends)).withColumn(hour, F.timestamp_seconds(F.least(F.greatest(nearest, F.unix_timestamp("_a")), F.unix_timestamp("_b"))))
    return at.drop("_a", "_b").join(winds, [point, hour], "left")


def raw_values(rows: DataFrame, route: str, bin_: str, value: str, distance: str) -> DataFrame:
    """The mean of a route's bins, each the distance-weighted mean of its rows, weighted by the bins' lengths with a value."""
    has = F.col(value).isNotNull()
    bins = rows.groupBy(route, bin_).agg(weighted_mean(F.col(value), F.col(distance)).alias("_v"), F.sum(F.when(has, F.col(distance))).alias("_d"))
    return bins.groupBy(route).agg(weighted_mean(F.col("_v"), F.col("_d")).alias(value))


def elevation_gain(rows: DataFrame, route: str, gain: str) -> DataFrame:
    """Metres climbed on each route; null where no row knows them."""
    return rows.groupBy(route).agg(F.sum(gain).alias(gain))


def joined_line(lines: Sequence[Column] | Column) -> Column:
    """One array of points from an array of arrays: a first point that equals the last one so far is left out."""
    parts = F.array(*lines) if isinstance(lines, (list, tuple)) else lines
    last = lambda line: F.get(line, F.size(line) - 1)
    add = lambda line, part: F.concat(line, F.when((F.size(line) > 0) & (last(line) == F.get(part, F.lit(0))), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))).otherwise(part))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), add)
