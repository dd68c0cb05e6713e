"""The metric language on orders as road segments: materials, axes, composite, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.aggregates import weighted_mean
from tarmac.plans import axes as A
from tarmac.queries.registry import Registry, exact_tenth, table

query = Registry()

#: Added before rounding on both sides: prices make exact decimal ties, which sums in another order tip either way.
OFF_TIES = 1.23e-8

MATERIALS = [
    A.Material("quantity_per_line", "numeric", "per line", True),
    A.Material("discount_percent", "numeric", "%"),
    A.Material("price", "numeric", "currency", True),
    A.Material("priority", "categorical"),
    A.Material("returned", "boolean"),
    A.Material("wind", "numeric", "ratio", dynamic=True),
]
AXES = [
    A.Axis("load", A.Linear((A.Term("quantity_per_line"), A.Term("discount_percent", 2.0, required=False)), ((0.0, 0.0), (20.0, 30.0), (50.0, 100.0))), 0.3),
    A.Axis("urgency", A.Categorical("priority", {"1-URGENT": 100.0, "2-HIGH": 70.0, "3-MEDIUM": 40.0}), 0.2),
    A.Axis("value", A.Linear((A.Term("price"),), ((0.0, 0.0), (150_000.0, 50.0), (400_000.0, 100.0))), 0.5, overrides=(A.Override("returned", "true", 95.0),)),
    A.Axis("strain", A.Linear((A.Term("load", 0.5), A.Term("value", 0.5)), ((0.0, 0.0), (100.0, 100.0))), 0.4),
    A.Axis("gust", A.Linear((A.Term("wind"), A.Term("load", 0.1, required=False)), ((0.0, 0.0), (2.0, 100.0))), 0.0, published=False),
]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with materials: line sums are the value table that the segments are joined with."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.avg("l_quantity").alias("quantity_per_line"), (F.avg("l_discount") * 100).alias("_discount"), F.bool_or(F.col("l_returnflag") == "R").alias("_returned"), F.sum("l_quantity").alias("distance"),
    )
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return orders.select(
        "o_orderkey", "o_custkey", "distance", "quantity_per_line", F.when(F.col("o_orderkey") % 3 > 0, F.col("_discount")).alias("discount_percent"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), (F.col("_returned") & (F.col("o_orderstatus") == "F")).alias("returned"),
    )


_LINE = "CASE WHEN {x} <= {a} THEN {p} WHEN {x} <= {b} THEN {p} + ({x} - {a}) * ({q} - {p}) / ({b} - {a}) WHEN {x} <= {c} THEN {q} + ({x} - {b}) * ({r} - {q}) / ({c} - {b}) WHEN {x} IS NOT NULL THEN {r} END"
#: Scores are cut to a tenth here by decimals; the engine's exact rounding is tested apart, so ties are avoided in both.
_SCORES = f"""lines AS (SELECT l_orderkey AS o_orderkey, avg(l_quantity) AS q, avg(l_discount) * 100 AS d, bool_or(l_returnflag = 'R') AS ret, sum(l_quantity) AS distance FROM lineitem GROUP BY 1),
    seg AS (SELECT o_orderkey, o_custkey, distance, q, CASE WHEN o_orderkey % 3 > 0 THEN d END AS d, o_totalprice AS price, o_orderpriority AS pri, ret AND o_orderstatus = 'F' AS returned FROM orders LEFT JOIN lines USING (o_orderkey)),
    raw AS (SELECT *, CASE WHEN q IS NOT NULL THEN q + 2 * coalesce(d, 0) END AS x FROM seg),
    s AS (SELECT *, {_LINE.format(x="x", a="0.0", b="20.0", c="50.0", p="0.0", q="30.0", r="100.0")} AS load0,
      CASE pri WHEN '1-URGENT' THEN 100.0 WHEN '2-HIGH' THEN 70.0 WHEN '3-MEDIUM' THEN 40.0 END::DOUBLE AS urgency,
      CASE WHEN returned THEN 95.0 ELSE {_LINE.format(x="price", a="0.0", b="150000.0", c="400000.0", p="0.0", q="50.0", r="100.0")} END::DOUBLE AS value0 FROM raw),
    t AS (SELECT *, CASE WHEN floor(load0 * 10) + 0.5 = load0 * 10 THEN 2 * round(load0 * 5) / 10 ELSE round(load0 * 10) / 10 END AS load, round(value0 * 10) / 10 AS value FROM s)"""


@query(f"""WITH {_SCORES} SELECT o_orderkey, round(load0 + {OFF_TIES}, 6) AS load_raw, urgency, round(value0 + {OFF_TIES}, 6) AS value_raw FROM s""")
def axis_scores(spark, sf_dir):
    """Scores before rounding, for an oracle that does not repeat the rounding."""
    from tarmac.functions.numbers import interpolate

    df = segments(spark, sf_dir)
    load, value = AXES[0].shape, AXES[2].shape
    scored = F.when(F.coalesce(F.col("returned"), F.lit(False)), 95.0).otherwise(interpolate(value.raw(), value.points))
    return df.select("o_orderkey", F.round(interpolate(load.raw(), load.points) + OFF_TIES, 6).alias("load_raw"), AXES[1].column().alias("urgency"), F.round(scored + OFF_TIES, 6).alias("value_raw"))


_PLAIN = """(coalesce(load0 * 0.3, 0) + coalesce(urgency * 0.2, 0) + coalesce(value0 * 0.5, 0)) / nullif(CASE WHEN load0 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN urgency IS NULL THEN 0 ELSE 0.2 END + CASE WHEN value0 IS NULL THEN 0 ELSE 0.5 END, 0)"""


def _unrounded(spark, sf_dir):
    from tarmac.functions.numbers import interpolate

    df = segments(spark, sf_dir)
    load, value = AXES[0].shape, AXES[2].shape
    scored = F.when(F.coalesce(F.col("returned"), F.lit(False)), 95.0).otherwise(interpolate(value.raw(), value.points))
    return df.withColumns({"load": interpolate(load.raw(), load.points), "urgency": AXES[1].column(), "value": scored})


_COMPOSITE = "(coalesce(load * 0.3, 0) + coalesce(urgency * 0.2, 0) + coalesce(value * 0.5, 0) + coalesce(strain * 0.4, 0)) / nullif(total, 0)"


@query(f"""WITH {_SCORES}, a AS (SELECT o_orderkey, {exact_tenth("load0")} AS load, urgency, {exact_tenth("value0")} AS value FROM s), b AS (SELECT *, CASE WHEN load IS NOT NULL AND value IS NOT NULL THEN {exact_tenth("(load * 0.5 + value * 0.5)")} END AS strain FROM a),
    w AS (SELECT *, CASE WHEN load IS NULL THEN 0 ELSE 0.3 END + CASE WHEN urgency IS NULL THEN 0 ELSE 0.2 END + CASE WHEN value IS NULL THEN 0 ELSE 0.5 END + CASE WHEN strain IS NULL THEN 0 ELSE 0.4 END AS total FROM b)
    SELECT o_orderkey, load, urgency, value, strain, {exact_tenth(_COMPOSITE)} AS difficulty FROM w ORDER BY difficulty DESC NULLS LAST, o_orderkey LIMIT 20""")
def flagship_axis_composite(spark, sf_dir):
    """Materials to axes (one reads two others, one has an override) to a weighted composite; the twenty hardest."""
    A.check(AXES, MATERIALS)
    scored = A.evaluate(segments(spark, sf_dir), [a for a in AXES if a.published])
    weights = A.weight_columns(AXES, A.preference(AXES))
    out = scored.withColumn("difficulty", A.composite(weights))
    return out.orderBy(F.desc_nulls_last("difficulty"), "o_orderkey").limit(20).select("o_orderkey", "load", "urgency", "value", "strain", "difficulty")


_WEIGHTS = {"load": 0.3, "urgency": 0.2, "value": 0.5}


@query(f"""WITH {_SCORES} SELECT o_orderkey, round({_PLAIN} + {OFF_TIES}, 6) AS difficulty FROM s""")
def composite_missing_renormalise(spark, sf_dir):
    weights = {n: F.lit(w) for n, w in _WEIGHTS.items()}
    return _unrounded(spark, sf_dir).select("o_orderkey", F.round(A.composite(weights, rounded=False) + OFF_TIES, 6).alias("difficulty"))


@query(f"""WITH {_SCORES}, w AS (SELECT *, CASE WHEN load0 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN urgency IS NULL THEN 0 ELSE 0.2 END + CASE WHEN value0 IS NULL THEN 0 ELSE 0.5 END AS total FROM s)
    SELECT o_orderkey, axis, round(part + {OFF_TIES}, 6) AS part FROM w, LATERAL (VALUES ('load', load0 * 0.3 / total), ('urgency', urgency * 0.2 / total), ('value', value0 * 0.5 / total)) v(axis, part) WHERE part IS NOT NULL""")
def contributions(spark, sf_dir):
    weights = {n: F.lit(w) for n, w in _WEIGHTS.items()}
    out = _unrounded(spark, sf_dir).select("o_orderkey", F.explode(A.contributions(weights)).alias("axis", "part"))
    return out.select("o_orderkey", "axis", F.round(F.col("part") + OFF_TIES, 6).alias("part"))


@query(f"""WITH {_SCORES}, d AS (SELECT *, {_PLAIN} AS difficulty FROM s), m AS (SELECT sum(difficulty * distance) / sum(CASE WHEN difficulty IS NOT NULL THEN distance END) AS mean FROM d)
    SELECT o_orderkey, round(distance * (1 + 0.7 * coalesce(difficulty, mean) / 100) + 100 * {OFF_TIES}, 4) AS cost FROM d, m""")
def travel_cost(spark, sf_dir):
    weights = {n: F.lit(w) for n, w in _WEIGHTS.items()}
    df = _unrounded(spark, sf_dir).withColumn("difficulty", A.composite(weights, rounded=False))
    return A.travel_cost(df, "difficulty", "distance", 0.7).select("o_orderkey", F.round(F.col("cost") + 100 * OFF_TIES, 4).alias("cost"))


@query(f"""WITH {_SCORES} SELECT o_custkey, round(sum(value0 * distance) / sum(CASE WHEN value0 IS NOT NULL THEN distance END) + {OFF_TIES}, 6) AS value FROM s GROUP BY 1""")
def way_level_fold(spark, sf_dir):
    out = _unrounded(spark, sf_dir).groupBy("o_custkey").agg(weighted_mean(F.col("value"), F.col("distance")).alias("value"))
    return out.select("o_custkey", F.round(F.col("value") + OFF_TIES, 6).alias("value"))


@query(f"""WITH {_SCORES} SELECT o_orderkey, round(CASE WHEN o_orderkey % 24 < 6 THEN (coalesce(load0 * 0.3, 0) + coalesce(value0 * 0.5, 0)) / nullif(CASE WHEN load0 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN value0 IS NULL THEN 0 ELSE 0.5 END, 0) ELSE load0 END + {OFF_TIES}, 6) AS difficulty FROM s""")
def night_weights(spark, sf_dir):
    night = F.col("o_orderkey") % 24 < 6
    own = [A.Axis("load", AXES[0].shape, 0.3), A.Axis("value", AXES[2].shape, 0.5, night_only=True)]
    weights = A.weight_columns(own, {"load": 0.3, "value": 0.5}, night)
    return _unrounded(spark, sf_dir).select("o_orderkey", F.round(A.composite(weights, rounded=False) + OFF_TIES, 6).alias("difficulty"))


@query(f"""WITH q AS (SELECT o_orderkey, o_orderkey % 5 / 2.0 AS wind, avg(l_quantity) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), a AS (SELECT *, {exact_tenth("CASE WHEN q <= 20 THEN q * 1.5 WHEN q <= 50 THEN 30.0 + (q - 20) * (70.0 / 30.0) WHEN q IS NOT NULL THEN 100.0 END")} AS load FROM q), x AS (SELECT *, wind + coalesce(load * 0.1, 0) AS x FROM a)
    SELECT o_orderkey, load, {exact_tenth("CASE WHEN x <= 0 THEN 0.0 WHEN x <= 2 THEN x * 50.0 ELSE 100.0 END")} AS gust FROM x""")
def dynamic_axes(spark, sf_dir):
    """Only the axes that depend on wind are evaluated, on top of stored static ones."""
    own = segments(spark, sf_dir).withColumn("discount_percent", F.lit(None).cast("double"))
    static = A.evaluate(own, AXES[:1]).withColumn("wind", (F.col("o_orderkey") % 5 / 2.0))
    return A.evaluate(static, A.dependents({"wind"}, AXES)).select("o_orderkey", "load", "gust")


@query(f"""WITH {_SCORES} SELECT o_custkey, round(sum(price * distance) / sum(distance), 4) AS density FROM s WHERE distance IS NOT NULL GROUP BY 1""")
def density_average(spark, sf_dir):
    """Density axes are averaged on the way and scored after."""
    if not A.averages_density(A.Axis("v", A.Linear((A.Term("price"),), AXES[2].shape.points)), MATERIALS):
        raise AssertionError("price is additive")
    out = segments(spark, sf_dir).groupBy("o_custkey").agg(weighted_mean(F.col("price"), F.col("distance")).alias("density")).where("density is not null")
    return out.select("o_custkey", F.round("density", 4).alias("density"))


@query("""SELECT x, y FROM (VALUES (0.0, 0.0), (10.0, 15.0), (20.0, 30.0), (35.0, 65.0), (50.0, 100.0), (80.0, 100.0)) v(x, y)""")
def score_preview(spark, sf_dir):
    from tarmac.functions.numbers import interpolate, round_tenth

    xs = spark.createDataFrame([(x,) for x in (0.0, 10.0, 20.0, 35.0, 50.0, 80.0)], "x double")
    return xs.select("x", round_tenth(interpolate(F.col("x"), AXES[0].shape.points)).alias("y"))


QUERIES, ORACLES = query.queries, query.oracles
