"""The metric language: missing values, overrides, order, validation, composites."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.plans import axes as A
from tarmac.plans.materials import Catalog, ValueTable, coverage, exclusion

STEEP = A.Axis("steep", A.Linear((A.Term("grade"),), ((0.0, 0.0), (10.0, 100.0)), absolute=True), 2.0)
ROUGH = A.Axis("rough", A.Categorical("surface", {"gravel": 60.0, "paved": 0.0}), 1.0)
BUSY = A.Axis("busy", A.Linear((A.Term("signals"), A.Term("crossings", 0.5, required=False)), ((0.0, 0.0), (4.0, 100.0))), 1.0, overrides=(A.Override("closed", "true", 7.0),))
BOTH = A.Axis("both", A.Linear((A.Term("steep", 0.5), A.Term("rough", 0.5)), ((0.0, 0.0), (100.0, 100.0))), 1.0)
MATERIALS = [A.Material("grade", "numeric", "%"), A.Material("surface", "categorical"), A.Material("signals", "numeric", "per km", True), A.Material("crossings", "numeric", "per km", True), A.Material("closed", "boolean")]
ROWS = [(-5.0, "gravel", 2.0, None, False), (None, "mud", None, 4.0, True), (20.0, None, None, None, None), (1.0, "paved", 1.0, 2.0, None)]


@pytest.fixture(scope="module")
def roads(spark):
    return spark.createDataFrame(ROWS, "grade double, surface string, signals double, crossings double, closed boolean")


def test_axes(roads):
    got = [tuple(r) for r in A.evaluate(roads, [BOTH, STEEP, ROUGH, BUSY]).select("steep", "rough", "busy", "both").collect()]
    assert got == [(50.0, 60.0, 50.0, 55.0), (None, None, 7.0, None), (100.0, None, None, None), (10.0, 0.0, 50.0, 5.0)]


def test_composite_renormalises(roads):
    weights = A.weight_columns([STEEP, ROUGH, BUSY], {"steep": 2.0, "rough": 1.0, "busy": 1.0})
    scored = A.evaluate(roads, [STEEP, ROUGH, BUSY]).select(A.composite(weights).alias("d"), A.contributions(weights).alias("c"))
    rows = scored.collect()
    assert [r.d for r in rows] == [52.5, 7.0, 100.0, 17.5]
    assert rows[1].c == {"busy": 7.0} and sum(rows[0].c.values()) == pytest.approx(52.5)
    nothing = A.weight_columns([STEEP], {"steep": 0.0})
    assert [r.d for r in A.evaluate(roads, [STEEP]).select(A.composite(nothing).alias("d")).collect()] == [None] * 4


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 100)), st.floats(0, 5)), min_size=1, max_size=5))
def test_composite_is_its_definition(spark, items):
    frame = spark.range(1).select(*[F.lit(s).cast("double").alias(f"a{i}") for i, (s, _) in enumerate(items)])
    got = frame.select(A.composite({f"a{i}": F.lit(float(w)) for i, (_, w) in enumerate(items)}, rounded=False)).first()[0]
    total = sum(w for s, w in items if s is not None)
    want = sum(s * w for s, w in items if s is not None) / total if total else None
    assert got == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))


def test_order_and_checks():
    assert [a.name for a in A.ordered([BOTH, STEEP, ROUGH])] == ["steep", "rough", "both"]
    A.check([BOTH, STEEP, ROUGH, BUSY], MATERIALS)
    loop = [A.Axis("a", A.Linear((A.Term("b"),), ((0.0, 0.0),))), A.Axis("b", A.Linear((A.Term("a"),), ((0.0, 0.0),)))]
    for bad in (loop, [A.Axis("x", A.Linear((A.Term("nothing"),), ((0.0, 0.0),)))], [A.Axis("x", A.Linear((A.Term("surface"),), ((0.0, 0.0),)))], [A.Axis("x", A.Categorical("grade", {"a": 1.0}))], [A.Axis("grade", ROUGH.shape)], [A.Axis("x", ROUGH.shape, -1.0)], [STEEP, STEEP]):
        with pytest.raises(A.AxisError):
            A.check(bad, MATERIALS)
    for broken in (lambda: A.Linear((), ((0.0, 0.0),)), lambda: A.Linear((A.Term("x"),), ((1.0, 0.0), (1.0, 1.0))), lambda: A.Categorical("x", {}), lambda: A.Linear((A.Term("x", float("nan")),), ((0.0, 0.0),))):
        with pytest.raises(A.AxisError):
            broken()


def test_metadata():
    axes = [BOTH, STEEP, ROUGH, BUSY]
    assert A.leaves("both", axes) == {"grade", "surface"}
    assert A.leaf_shares("both", axes) == {"grade": 0.5, "surface": 0.5}
    assert [a.name for a in A.dependents({"grade"}, axes)] == ["steep", "both"]
    assert A.preference(axes, {"rough": 3}) == {"both": 1.0, "steep": 2.0, "rough": 3, "busy": 1.0}
    for bad in ({"no": 1.0}, {"rough": -1.0}, {"rough": float("inf")}):
        with pytest.raises(A.AxisError):
            A.preference(axes, bad)
    assert A.band_thresholds(STEEP) == [-10.0, 0.0, 10.0] and A.band_thresholds(ROUGH) == [30.0]
    assert not A.averages_density(BUSY, MATERIALS) and A.averages_density(A.Axis("b", BUSY.shape), MATERIALS)


def test_costs(spark):
    df = spark.createDataFrame([(50.0, 100.0), (None, 100.0), (100.0, 300.0)], "d double, m double")
    got = [r.cost for r in A.travel_cost(df, "d", "m", 0.7).collect()]
    assert got == pytest.approx([135.0, 100 * (1 + 0.7 * 0.875), 510.0])
    assert spark.range(1).select(A.difficulty_of_cost(F.lit(135.0), F.lit(100.0), 0.7)).first()[0] == pytest.approx(50.0)


def test_catalog_joins_what_is_read(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    catalog = Catalog({n: ValueTable(spark.createDataFrame([(1, 5.0)], f"k int, {n} double"), ("k",)) for n in ("a", "b")})
    catalog.add("x", F.col("a.a") * 2, "a")
    catalog.add("y", F.col("b.b"), "b")
    out = catalog.read(base, ["x"])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 10.0), (2, None)]
    assert out._jdf.queryExecution().analyzed().toString().count("Join") == 1
    with pytest.raises(ValueError):
        catalog.read(base, ["z"])


def test_coverage_and_exclusion(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert [(r.material, r.present, r.total, r.missing_ratio) for r in coverage(df, ["a", "b"]).collect()] == [("a", 1, 2, 0.5), ("b", 0, 2, 1.0)]
    assert [r.missing_ratio for r in coverage(df.limit(0), ["a"]).collect()] == [None]
    with pytest.raises(ValueError):
        exclusion({"a": F.lit(True)}, {"b": True})
    assert spark.range(1).select(exclusion({"a": F.lit(None).cast("boolean")}, {"a": True}, F.lit(None).cast("double"), 3.0)).first()[0] is False
