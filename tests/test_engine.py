"""Running sums, stored tables, binned searches, stages, the standard catalogue, validators, tuning, and periodic jobs."""

import heapq
import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarmac import storage
from tarmac.functions import geo
from tarmac.operators import bulletins, graph, prefix, routes
from tarmac.plans import axes as A
from tarmac.plans import catalog, stages, tuning
from tarmac.sources import ingest, views
from tarmac.streaming import feeds


def test_running_sums_and_minima(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 400)]
    frame = spark.createDataFrame(rows, "k string, o int, v int").repartition(4)
    for how, inclusive in (("sum", True), ("sum", False), ("min", True), ("min", False)):
        got = {(r.k, r.o): r.running for r in prefix.running(frame, ["k"], "o", "v", how, inclusive).collect()}
        assert len(got) == len(rows)
        for k, o, v in rows:
            before = [w for x, p, w in rows if x == k and (p < o or inclusive and p == o)]
            want = sum(before) if how == "sum" else min(before, default=None)
            assert got[(k, o)] == want
    whole = prefix.running(frame, [], "o", "v")
    assert max(r.running for r in whole.collect()) == sum(v for _, _, v in rows)
    assert prefix.running(frame.limit(0), ["k"], "o", "v").count() == 0


def test_stored_tables_are_measured_and_forgotten(spark):
    out, seen = storage.measured(spark.range(10), n=F.count(F.lit(1)), s=F.sum("id"))
    assert (seen["n"], seen["s"], out.count()) == (10, 45, 10)
    folder = Path(out.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists()
    storage.forget(out)
    assert not folder.exists()


def dijkstra(edges, source, bins=1):
    best, queue = {}, [(0.0, 0.0, source)]
    while queue:
        cost, clock, node = heapq.heappop(queue)
        if node in best:
            continue
        best[node] = (cost, clock)
        for tail, head, b, c, s in edges:
            if tail == node and b == min(int(clock // 3600), bins - 1) and head not in best:
                heapq.heappush(queue, (cost + c, clock + s, head))
    return best


def test_search_with_time_bins(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(90)}
    edges = [(a, b, t, float(rng.randint(1, 50)), 700.0 + 100 * rng.randint(0, 9)) for a, b in pairs if a != b for t in (0, 1, 2)]
    kind = "tail long, head long, bin int, cost double, seconds double"
    source = spark.createDataFrame([(0, 0.0)], "node long, cost double")
    flat = [(a, b, t, float(a + b + 1), s) for a, b, t, _, s in edges]  # costs that do not move: the search is exact
    want = dijkstra(flat, 0, 3)
    got = {r.node: r for r in graph.relax(spark.createDataFrame(flat, kind), source, bins=3, compact=2).collect()}
    assert {n: r.cost for n, r in got.items()} == {n: c for n, (c, _) in want.items()}
    moving = {r.node: r for r in graph.relax(spark.createDataFrame(edges, kind), source, bins=3).collect()}
    by = {(a, b, t): (c, s) for a, b, t, c, s in edges}
    assert moving.keys() == want.keys()
    for node, r in moving.items():  # every label is the step from some label of its predecessor
        assert node == 0 or any(r.cost > by[(r.prev, node, t)][0] - 1e-9 and r.elapsed >= by[(r.prev, node, t)][1] - 1e-9 for t in (0, 1, 2))
    plain = spark.createDataFrame([(a, b, c) for a, b, t, c, _ in edges if t == 0], "tail long, head long, cost double")
    assert {r.node: r.cost for r in graph.relax(plain, source, compact=2).collect()} == {n: c for n, (c, _) in dijkstra([e for e in edges if e[2] == 0], 0).items()}
    with pytest.raises(RuntimeError):
        graph.relax(spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "tail long, head long, cost double"), source, rounds=5)
    assert [tuple(r) for r in graph.legs(spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "tail long, head long, cost double"), [0, 2, 0, 1]).collect()] == [(0, 5.0, 0.0), (1, None, 5.0), (2, 2.0, None)]


def test_passages_of_one_route(spark):
    rows = [(1, 0, 0, 100.0, 10.0, [50.0, 70.0]), (1, 1, 0, 100.0, 20.0, [60.0, 80.0]), (1, 2, 1, 100.0, None, [30.0, 90.0]), (1, 3, 1, 500.0, 5.0, [None, math.inf])]
    frame = spark.createDataFrame(rows, "route int, step int, leg int, distance_m double, wait double, seconds_by_bin array<double>")
    got = [tuple(r) for r in routes.passages(frame, "route", 2, 55.0, 5.0).orderBy("step").collect()]
    assert got == [(1, 0, 0, 0.0, 50.0, False), (1, 1, 0, 60.0, 60.0, False), (1, 2, 0, 140.0, 30.0, False), (1, 3, 0, 170.0, 100.0, False)]


def test_nearest_station_is_always_found(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 50.0), (3, 0.1, 0.1)], "p int, lon double, lat double")
    stations = spark.createDataFrame([(7, 0.0, 0.01), (8, -170.0, 10.0)], "s int, lon double, lat double")
    assert {r.p: r.s for r in bulletins.nearest_station(points, stations, "p", "s", 5000.0).collect()} == {1: 7, 2: 8, 3: 7}
    assert bulletins.nearest_station(points, stations.limit(0), "p", "s").count() == 0


def test_points_along_odd_lines(spark):
    rows = spark.createDataFrame([(1, []), (2, [(1.0, 2.0)]), (3, [(0.0, 0.0), (0.0, 0.0)]), (4, [(0.0, 0.0), (1.0, 0.0)]), (5, None)], "k int, p array<struct<lon:double,lat:double>>")
    got = {r.k: r.a and tuple(round(x, 6) for x in r.a) for r in rows.select("k", geo.along(F.col("p"), 0.5).alias("a")).collect()}
    assert got == {1: None, 2: (1.0, 2.0), 3: (0.0, 0.0), 4: (0.5, 0.0), 5: None}


def test_stages_build_what_changed(spark, tmp_path):
    made = []

    def double(s, t):
        made.append("double")
        return t["raw"].select((F.col("id") * 2).alias("x"))

    def total(s, t):
        made.append("total")
        return t["double"].agg(F.sum("x").alias("s"))

    plan = [stages.Stage("total", ("double",), total), stages.Stage("double", ("raw",), double, invariants=("x >= 0",))]
    path, raw = str(tmp_path), spark.range(4)
    assert stages.run(spark, path, plan, {"raw": (raw, "a")}) == ["double", "total"]
    assert stages.run(spark, path, plan, {"raw": (raw, "a")}) == []
    assert stages.run(spark, path, plan, {"raw": (spark.range(6), "b")}) == ["double", "total"]
    assert ingest.current(spark, path, "total").first()["s"] == 30
    plan[0] = stages.Stage("total", ("double",), total, "2")
    assert stages.run(spark, path, plan, {"raw": (raw, "b")}) == ["total"]
    with pytest.raises(stages.StageError, match="x >= 0"):
        stages.run(spark, path, plan, {"raw": (spark.range(-3, 3), "c")})
    assert ingest.current(spark, path, "total").first()["s"] == 30
    with pytest.raises(stages.StageError, match="circle"):
        stages.in_order([stages.Stage("a", ("b",), total), stages.Stage("b", ("a",), total)])


def test_the_standard_catalogue(spark):
    listed = catalog.materials()
    names = [m.name for m in listed]
    assert len(names) == len(set(names)) == 45
    assert {m.name for m in listed if m.additive} == {n for n in names if n.endswith(("_per_km", "_per_km_year"))}
    assert [m.name for m in listed if m.dynamic] == ["wind_drag_ratio"]


LINE = A.Linear((A.Term("a"),), ((0.0, 0.0), (10.0, 100.0)))


def test_axis_validators(spark):
    materials = [A.Material("a", "numeric", "1/km", True), A.Material("b", "numeric"), A.Material("c", "categorical")]
    one, two = A.Axis("one", LINE), A.Axis("two", A.Linear((A.Term("a", 0.5), A.Term("b")), LINE.points))
    with pytest.raises(A.AxisError, match="read by"):
        A.check_exclusive([one, two], materials)
    A.check_exclusive([one, A.Axis("three", A.Linear((A.Term("one"), A.Term("b")), LINE.points))], materials)
    A.check_change(one, one)
    A.check_change(one, one, ({"icon": 1}, {"icon": 2}))
    for new in (None, two):
        with pytest.raises(A.AxisError):
            A.check_change(one, new)
    A.check_change(A.Axis("draft", LINE, published=False), None)
    with pytest.raises(A.AxisError, match="count by themselves"):
        A.check_published([one, A.Axis("three", A.Linear((A.Term("one"),), LINE.points))])
    for bad in (lambda: A.Linear((A.Term("a"),), ((1.0, 0.0), (1.0, 5.0))), lambda: A.Linear((A.Term("a", 0.0),), LINE.points), lambda: A.Categorical("c", {})):
        with pytest.raises(A.AxisError):
            A.check_points(A.Axis("x", bad()))
    assert A.density_slope(one) == 10.0
    with pytest.raises(A.AxisError):
        A.density_slope(A.Axis("x", A.Linear((A.Term("a"),), ((0.0, 0.0), (1.0, 5.0), (2.0, 6.0)))))
    assert A.needed_materials([one, A.Axis("cat", A.Categorical("c", {"x": 1.0}))], materials, ["b"]) == (["a", "b"], ["c"])
    frame = spark.createDataFrame([(1, 5.0), (2, None)], "k int, a double")
    weights = A.weight_columns([one], {"one": 2.0})
    row = A.inspected(frame, "k", 1, [one], weights).first()
    assert (row.one, row.composite, row.parts) == (50.0, 50.0, {"one": 50.0})


def test_tuning():
    assert tuning.resolved({"turn.left_seconds": 5.0, "unknown": 1.0})["turn.left_seconds"] == 5.0
    assert tuning.resolved({})["turn.right_seconds"] == 12.0
    for bad in (math.nan, -1.0, 1000.0):
        with pytest.raises(ValueError):
            tuning.resolved({"turn.left_seconds": bad})


def test_views_read_what_parses(spark):
    rows = [("p1", "place", '{"names": {"primary": "n"}, "confidence": "x", "taxonomy": {"hierarchy": ["a", "b"]}, "websites": null}'), ("w", "way", "{}"), ("p2", "place", "no json")]
    out = {r.natural_key: r for r in views.view(spark.createDataFrame(rows, "natural_key string, source string, attrs string"), "places").collect()}
    assert out.keys() == {"p1", "p2"}
    assert (out["p1"].name, out["p1"].confidence, out["p1"].hierarchy, out["p1"].phones, out["p2"].name) == ("n", None, ["a", "b"], None, None)
    packed = spark.createDataFrame([(bytes(range(8)) + (2**64 - 5).to_bytes(8, "little") + b"xx",), (b"",), (None,)], "b binary").select(views.int64s(F.col("b")).alias("n")).collect()
    assert [r.n for r in packed] == [[int.from_bytes(bytes(range(8)), "little"), -5], [], None]


def test_publishing_again_leaves_readers_alone(spark, tmp_path):
    ingest.publish(spark.range(3).toDF("x"), str(tmp_path), "t", "r")
    old = ingest.current(spark, str(tmp_path), "t")
    ingest.publish(spark.range(5).toDF("x"), str(tmp_path), "t", "r")
    assert (old.count(), ingest.current(spark, str(tmp_path), "t").count()) == (3, 5)
    (tmp_path / "a.txt").write_text("one")
    first = ingest.file_digests(spark, str(tmp_path / "a.txt"))
    (tmp_path / "b.txt").write_text("one")
    assert list(first.values()) == list(ingest.file_digests(spark, str(tmp_path / "b.txt")).values())
    assert ingest.code_digest(ingest) != ingest.code_digest(views)


def test_periodic_jobs(spark, tmp_path):
    seen = []
    query = feeds.periodic(spark, lambda s, n: seen.append((n, s.range(2).count())), str(tmp_path / "c"), "1 second")
    until = time.time() + 60
    while len(seen) < 2 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert seen[:2] == [(0, 2), (1, 2)]
