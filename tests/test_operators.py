"""Operators against brute force: distances, clusters, graphs, topology, windows, statistics, places."""

import heapq
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarmac.operators import aggregates, derive, graph, places, spatial, windows
from tarmac.operators.components import connected


def metres(a, b):
    x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(x))


@pytest.fixture(scope="module")
def dots():
    rng = random.Random(4)
    spot = lambda: (139.7 + rng.random() * 0.02, 35.6 + rng.random() * 0.02)
    return [(i, *spot()) for i in range(80)], [(100 + i, *spot()) for i in range(60)]


def test_distance_joins(spark, dots):
    left, right = dots
    a, b = spark.createDataFrame(left, "a int, lon double, lat double"), spark.createDataFrame(right, "b int, lon double, lat double")
    near = {(i, j) for i, *p in left for j, *q in right if metres(p, q) <= 200}
    assert {(r.a, r.b) for r in spatial.within(a, b, 200).collect()} == near
    best = {i: min((metres(p, q), j) for j, *q in right)[1] for i, *p in left if min(metres(p, q) for _, *q in right) <= 200}
    assert {r.a: r.b for r in spatial.nearest(a, b, "a", "b", 200).collect()} == best
    assert {r.a for r in spatial.near_any(a, b, "a", 200).collect()} == {i for i, _ in near}
    twins = spark.createDataFrame([(7, 139.7, 35.6), (3, 139.7, 35.6)], "b int, lon double, lat double")
    assert [r.b for r in spatial.nearest(spark.createDataFrame([(1, 139.7, 35.6001)], "a int, lon double, lat double"), twins, "a", "b", 30).collect()] == [3]


def test_clusters(spark, dots):
    points = [(i, k % 2, *p) for k, (i, *p) in enumerate(dots[0])]
    root = {i: i for i, *_ in points}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, k, *p in points:
        for j, m, *q in points:
            if k == m and metres(p, q) <= 250:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = spatial.clusters(spark.createDataFrame(points, "k int, kind int, lon double, lat double"), "k", 250, ["kind"])
    assert {r.k: r.cluster for r in got.collect()} == {i: find(i) for i in root}


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert connected(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.fixture(scope="module")
def net():
    rng = random.Random(9)
    return sorted({(rng.randrange(40), rng.randrange(40)): float(rng.randint(1, 20)) for _ in range(160)}.items())


def dijkstra(edges, source):
    out, best, heap = defaultdict(list), {source: 0.0}, [(0.0, source)]
    for (a, b), c in edges:
        out[a].append((b, c))
    while heap:
        d, n = heapq.heappop(heap)
        if d == best[n]:
            for m, c in out[n]:
                if d + c < best.get(m, math.inf):
                    best[m] = d + c
                    heapq.heappush(heap, (d + c, m))
    return best


def test_shortest_paths(spark, net):
    states = spark.createDataFrame([(a, b, c) for (a, b), c in net], "tail int, head int, cost double")
    source = spark.createDataFrame([(0, 0.0)], "node int, cost double")
    tree = graph.relax(states, source)
    want = dijkstra(net, 0)
    assert {r.node: r.cost for r in tree.collect()} == want
    assert {r.node for r in graph.relax(states, source, limit=20.0).collect()} == {n for n, c in want.items() if c <= 20}
    far = max(want, key=lambda n: (want[n], n))
    steps = [r.node for r in graph.path(tree, F.lit(far)).orderBy("step").collect()]
    cost = dict(net)
    assert steps[0] == 0 and steps[-1] == far and sum(cost[p] for p in zip(steps, steps[1:], strict=False)) == want[far]
    back = graph.relax(graph.reversed_states(states), spark.createDataFrame([(far, 0.0)], "node int, cost double"))
    through = {r.node: r.through for r in graph.junction(tree, back).collect()}
    assert min(through.values()) == want[far] == through[0] == through[far]


def test_strong_component(spark, net):
    forward = {n: set(dijkstra(net, n)) for n in range(40)}
    groups = {frozenset(m for m in forward[n] if n in forward.get(m, ())) | {n} for n in range(40)}
    got = {r.node for r in graph.largest_strong_component(spark.createDataFrame([(a, b) for (a, b), _ in net], "tail int, head int")).collect()}
    assert got == set(max(groups, key=len))


def test_turns(spark):
    rows = [("in", 1, 2, 0.0, 0.0, "s1", 1), ("straight", 2, 3, 10.0, 10.0, "s2", 1), ("left", 2, 4, 270.0, 270.0, "s3", 1), ("right", 2, 5, 90.0, 90.0, "s4", 3), ("back", 2, 1, 180.0, 180.0, "s1", 1)]
    edges = spark.createDataFrame(rows, "edge string, tail int, head int, bearing_in double, bearing_out double, segment string, rank int").withColumn("signal", F.lit(False)).withColumn("node_rank", F.lit(3))
    got = {r.next: r.seconds for r in graph.transitions(edges).where("edge = 'in'").collect()}
    assert got == {"straight": 8.0, "left": 17.0, "right": 27.0, "back": 60.0}
    free = {r.next: r.seconds for r in graph.transitions(edges.withColumn("signal", F.lit(True))).where("edge = 'in'").collect()}
    assert free == {"straight": 0.0, "left": 2.0, "right": 12.0, "back": 60.0}


def way(key, nodes):
    return key, nodes, [(139.7 + 0.001 * n, 35.68 + 0.001 * (n % 2)) for n in nodes]


def test_topology(spark):
    ways = spark.createDataFrame([way(1, [1, 2, 3, 4]), way(2, [3, 5]), way(3, [6, 7, 8, 9, 6]), way(4, [10, 10])], "way int, node_ids array<int>, points array<struct<lon:double,lat:double>>")
    segments = derive.segments(ways)
    got = {(r.way, r.segment): (r.from_node, r.to_node) for r in segments.collect()}
    assert got == {(1, 0): (1, 3), (1, 1): (3, 4), (2, 0): (3, 5), (3, 0): (6, 8), (3, 1): (8, 6)}
    row = segments.where("way = 1 and segment = 0").first()
    assert row.distance_m == pytest.approx(2 * metres((139.701, 35.681), (139.702, 35.68)), rel=1e-6)
    assert abs(row.bearing_deg - row.reverse_bearing_deg) == pytest.approx(180, abs=0.01)
    assert {r.node: r.branches for r in derive.branch_counts(segments).collect()} == {1: 1, 3: 3, 4: 1, 5: 1, 6: 2, 8: 2}
    assert {(r.way, r.segment): r.n for r in derive.intersection_counts(segments).collect()}[(1, 0)] == 0.5


def test_counts(spark):
    ways = spark.createDataFrame([way(1, [1, 2, 3]), way(2, [3, 4])], "way int, node_ids array<int>, points array<struct<lon:double,lat:double>>")
    stops = spark.createDataFrame([(2, "signal", 139.702, 35.68), (3, "signal", 139.703, 35.681), (4, "stop", 139.704, 35.68)], "node int, kind string, lon double, lat double")
    got = {(r.way, r.segment, r.kind): r.n for r in derive.place_counts(derive.segments(ways), stops).collect()}
    assert got == {(1, 0, "signal"): 1.5, (2, 0, "signal"): 0.5, (2, 0, "stop"): 0.5}
    lines = spark.createDataFrame([(e, [(x, 35.6), (x + 0.0001, 35.6)]) for e, x in (("b", 139.7), ("a", 139.7), ("c", 139.8))], "edge string, points array<struct<lon:double,lat:double>>")
    accidents = spark.createDataFrame([(1, "bicycle", None, 1, 139.70001, 35.6), (2, "car", "bicycle", 0, 139.7, 35.60001), (3, "car", "car", 0, 139.7, 35.6), (4, "bicycle", None, 0, 139.75, 35.6)], "accident int, party_a string, party_b string, deaths int, lon double, lat double")
    assert {r.edge: r.n for r in derive.accident_counts(lines, accidents).collect()} == {"a": 4.0}


def test_elevation(spark):
    up = [(1, 0, i, 139.7 + 0.001 * i, 35.6, e, False) for i, e in ((0, 10.0), (1, 12.0), (2, 11.0), (5, 40.0), (6, None), (7, 41.0))]
    bridge = [(2, 0, i, 139.7 + 0.001 * i, 35.6, e, True) for i, e in ((0, 10.0), (1, 80.0), (2, 13.0))]
    cliff = [(3, 0, i, 139.7 + 0.0001 * i, 35.6, e, False) for i, e in ((0, 0.0), (1, 50.0))]
    df = spark.createDataFrame(up + bridge + cliff, "way int, seg int, ord int, lon double, lat double, elev double, on_structure boolean")
    out = windows.elevation_values(df, ["way", "seg"])
    got = {r.way: (r.start_elev, r.end_elev, r.gain, r.loss) for r in out.collect()}
    assert got == {1: (10.0, 41.0, 2.0, 1.0), 2: (10.0, 13.0, 3.0, 0.0), 3: (0.0, 50.0, None, None)}
    back = {r.way: (r.start_elev, r.gain, r.loss, r.grade) for r in windows.reversed_elevation(out).collect()}
    first = out.where("way = 1").first()
    assert back[1] == (41.0, 1.0, 2.0, -first.grade)


def test_rain(spark):
    series = [1.0, 0.0, None, 2.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(series)], "k string, h int, mm double")
    got = [r.mm_3h for r in windows.trailing_sums(df, "k", "h", "mm", [3]).orderBy("h").collect()]
    assert got == [None, None, None, None, None, 2.0, 0.0]
    assert [r.hours_since for r in windows.hours_since(df, "k", "h", "mm", 1.0).orderBy("h").collect()] == [0, 1, None, 0, 1, 2, 3]


def test_pareto(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(12), rng.randrange(12)) for i in range(120)]
    rest, layers = list(rows), {}
    for layer in range(3):
        front = [r for r in rest if not any(s[1] <= r[1] and s[2] <= r[2] and s[1:] != r[1:] for s in rest)]
        layers.update({r[0]: layer for r in front})
        rest = [r for r in rest if r not in front]
    df = spark.createDataFrame(rows, "id int, a int, b int").repartition(4)
    assert {r.id for r in windows.pareto_front(df, "a", "b").collect()} == {i for i, layer in layers.items() if layer == 0}
    assert {r.id: r.layer for r in windows.pareto_layers(df, "a", "b", 3).collect() if r.layer is not None} == layers


def test_weighted_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 5.0, 1.0), ("a", 0.0, 9.0), ("a", None, 50.0), ("b", 2.0, 0.0)], "k string, v double, w double")
    out = aggregates.weighted_quantiles(df, ["k"], "v", "w", [0.25, 0.5, 0.99]).collect()
    assert [tuple(r) for r in out] == [("a", 0.0, 1.0, 5.0)]
    assert aggregates.spread(df, ["k"], "v", "w", [0.5]).first().zero_share == pytest.approx(0.45)
    bins = aggregates.weighted_histogram(df, ["k"], "v", "w", bins=6).orderBy("bin").collect()
    assert [r.w for r in bins] == [9.0, 10.0, 0.0, 0.0, 0.0, 1.0]
    mean = df.groupBy("k").agg(aggregates.weighted_mean(F.col("v"), F.col("w")).alias("m"))
    assert {r.k: r.m for r in mean.collect()} == {"a": pytest.approx(0.75), "b": None}


def test_routes(spark):
    df = spark.createDataFrame([("r", i, d) for i, d in enumerate((0.2, 0.2, 0.2, 0.6, 0.1))], "route string, i int, km double")
    assert [r.bin for r in aggregates.distance_bins(df, ["route"], "i", "km").orderBy("i").collect()] == [0, 0, 0, 1, 2]
    loop = spark.createDataFrame([("r", 1, 2, 5.0), ("r", 2, 1, 5.0), ("r", 2, 3, 10.0)], "route string, a int, b int, l double")
    assert aggregates.retraced_share(loop, "route", "a", "b", "l").first().retraced == pytest.approx(0.25)
    assert aggregates.overlap_ratio(loop, loop.where("b = 3"), "route", "a", "b", "l").first().overlap == pytest.approx(10 / 15)
    maps = spark.createDataFrame([("r", {"x": 1.0, "y": 4.0}, 1.0), ("r", {"x": 3.0}, 3.0)], "route string, m map<string,double>, w double")
    assert aggregates.merge_maps(maps, ["route"], "m", "w").first().m == {"x": 2.5, "y": 4.0}


def test_rasters(spark):
    tiles = spark.createDataFrame([(3637, 1612, 2, [5] * 16), (3637, 1612, 1, [None] * 15 + [7])], "x int, y int, rank int, pixels array<int>")
    points = spark.createDataFrame([(1, 139.66, 35.7), (2, 0.0, 0.0)], "id int, lon double, lat double")
    got = {r.id: r.value for r in spatial.raster_values(points, tiles, 12, "rank", size=4).collect()}
    assert got[2] is None and got[1] in (5, None)
    cells = spark.createDataFrame([("t", 0, 0, 1, 0), ("t", 0, 0, 2, 4), ("t", 1, 0, 1, 3), ("t", 1, 0, 2, 9), ("u", 0, 0, 1, 0)], "tile string, px int, py int, priority int, class int")
    assert {(r.tile, r.px, r["class"]) for r in spatial.mosaic(cells).collect()} == {("t", 0, 4), ("t", 1, 3)}
    raw = spark.createDataFrame([(0, 0, 100), (128, 0, 0), (255, 255, 156)], "r int, g int, b int").select(spatial.decoded_elevation(*map(F.col, "rgb")))
    assert [r[0] for r in raw.collect()] == [1.0, None, -1.0]
    parent = spark.createDataFrame([(128, 0, "a"), (0, 0, "b")], "px int, py int, v string")
    assert {(r.px, r.py, r.v) for r in spatial.child_pixels(parent, 1, 0).collect()} == {(0, 0, "a"), (0, 1, "a"), (1, 0, "a"), (1, 1, "a")}


def test_places(spark):
    rows = [(1, "Cafe A", 0.9, ["cafe"], ["03-1"], [], 139.7, 35.6), (2, "Café A!", 0.5, ["cafe"], ["03-1"], [], 139.7001, 35.6), (3, "cafe a", 0.4, ["cafe"], [], [], 139.7002, 35.6), (4, "Cafe A", 0.4, ["cafe"], [], [], 139.9, 35.6), (5, "Bank", 0.9, ["bank"], [], [], 139.7, 35.6)]
    df = spark.createDataFrame(rows, "id int, name string, confidence double, categories array<string>, phones array<string>, websites array<string>, lon double, lat double")
    food = places.grouped(df, {"food": ["cafe"]})
    assert {r.id for r in food.collect()} == {1, 2, 3, 4}
    merged = places.merge_by_contact(food)
    assert {r.id for r in merged.collect()} == {1, 3, 4}
    assert {r.id for r in places.merge_by_name(merged).collect()} == {1, 4}
    areas = spark.createDataFrame([("c", "b", "C"), ("b", "a", "B"), ("a", None, "A")], "area string, parent string, name string")
    assert {r.area: r.names for r in places.full_names(areas).collect()} == {"a": ["A"], "b": ["A", "B"], "c": ["A", "B", "C"]}
    keys = spark.createDataFrame([(1, "tokyo"), (2, "tokyo1"), (3, "to"), (4, "kyoto")], "area int, key string")
    assert [r.area for r in places.search(keys, "tokyo").collect()] == [1, 2]
    assert [r.area for r in places.search(keys, "tokx").collect()] == [3]


def test_largest_strong_component_away_from_the_busiest_node(spark):
    hub = [(0, i) for i in range(1, 9)] + [(i, 100) for i in range(1, 9)] + [(100, 0)]  # ten nodes, of highest degree
    ring = [(200 + i, 200 + (i + 1) % 12) for i in range(12)]
    pairs = [(300, 301), (301, 300), (301, 302), (8, 200), (205, 300), (400, 0)]
    frame = spark.createDataFrame(hub + ring + pairs, "tail int, head int")
    assert {r.node for r in graph.largest_strong_component(frame).collect()} == set(range(200, 212))
    line = spark.createDataFrame([(3, 2), (2, 1)], "tail int, head int")
    assert [r.node for r in graph.largest_strong_component(line).collect()] == [1]
    assert graph.largest_strong_component(line.limit(0)).count() == 0


def test_path_of_many_steps(spark):
    long = spark.range(17_000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("prev"))
    got = [(r.step, r.node) for r in graph.path(long, F.lit(16_999)).orderBy("step").collect()]
    assert got == [(i, i) for i in range(17_000)]


def test_cheapest_path_of_more_than_200_hops(spark):
    """Takes minutes: every hop is a stored round."""
    chain = spark.range(206).select(F.col("id").alias("tail"), (F.col("id") + 1).alias("head"), F.lit(1.0).alias("cost")).coalesce(1)
    tree = graph.relax(chain, spark.createDataFrame([(0, 0.0)], "node bigint, cost double"))
    assert {r.node: r.cost for r in tree.collect()} == {i: float(i) for i in range(207)}
