"""Lines, rings, divided roads, clusters and diverse choices against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarmac.functions.geo import METRES_PER_DEGREE, pieces_m
from tarmac.operators import lines, routes, spatial

POINTS = "array<struct<lon:double,lat:double>>"


def metres(a, b):
    x, y = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    return 2 * 6371000 * math.asin(math.sqrt(math.sin(y) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(x) ** 2))


def to_piece(p, a, b):
    k = math.cos(math.radians(p[1])) * METRES_PER_DEGREE
    ax, ay, bx, by = (a[0] - p[0]) * k, (a[1] - p[1]) * METRES_PER_DEGREE, (b[0] - p[0]) * k, (b[1] - p[1]) * METRES_PER_DEGREE
    n = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0.0 if not n else min(1.0, max(0.0, -(ax * (bx - ax) + ay * (by - ay)) / n))
    return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))


def to_line(p, line):
    return min(to_piece(p, a, b) for a, b in zip(line, line[1:] or line, strict=False))


def test_ring_along_bent_lines(spark):
    step, size = 0.001, 8
    bent = [(139.7, 35.6), (139.712, 35.6031), (139.7121, 35.62), (139.7, 35.62)]  # slanted, upright, level
    odd = {"bent": bent, "point": [(139.75, 35.65)], "edge": [(139.6, 35.6), (139.61, 35.61)], "away": [(10.0, 10.0), (10.1, 10.1)]}
    tiles = [(x, y, [(x * 7 + y * 5 + i) % 4 if (x + y + i) % 9 else None for i in range(size * size)]) for x in range(17450, 17475) for y in range(4445, 4460)]
    want = Counter()
    for name, line in odd.items():
        for x, y, pixels in tiles:
            for i, v in enumerate(pixels):
                middle = ((x * size + i % size + 0.5) * step, (y * size + i // size + 0.5) * step)
                if v and abs(middle[0] - line[0][0]) < 0.1 and 150 < to_line(middle, line) <= 700:
                    want[name, v] += 1
    got = lines.ring_counts(spark.createDataFrame(list(odd.items()), f"k string, points {POINTS}"), spark.createDataFrame(tiles, "tx int, ty int, pixels array<int>"), "k", 150.0, 700.0, step, size)
    assert Counter({(r.k, r["class"]): r.n for r in got.collect()}) == want and ("bent", 1) in want and ("point", 1) in want


def test_near_lines(spark):
    rng = random.Random(4)
    roads = [(f"r{i}", [(139.7 + rng.random() / 20, 35.6 + rng.random() / 20) for _ in range(rng.randint(1, 4))]) for i in range(12)]
    spots = [(i, 139.7 + rng.random() / 20, 35.6 + rng.random() / 20) for i in range(60)]
    want = {}
    for i, x, y in spots:
        d, name = min((to_line((x, y), line), name) for name, line in roads)
        if d <= 300:
            want[i] = (name, pytest.approx(d, abs=0.01))
    got = lines.nearest_line(spark.createDataFrame(spots, "p int, lon double, lat double"), spark.createDataFrame(roads, f"road string, points {POINTS}"), "p", "road", 300.0)
    assert {r.p: (r.road, r.dist_m) for r in got.collect()} == want
    pair = spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0)], [(0.0, 1.0), (1.0, 0.0)])], f"u {POINTS}, v {POINTS}")
    assert pair.select(pieces_m(F.col("u")[0], F.col("u")[1], F.col("v")[0], F.col("v")[1])).first()[0] == 0.0


def test_divided_roads(spark):
    east = lambda y, x=139.7, n=0.002: [(x, y), (x + n / 2, y), (x + n, y)]
    d = 1 / METRES_PER_DEGREE
    rows = [
        ("tag", east(35.1), "forward", "primary", " Triple", None, None), ("both ways", east(35.11), "both", "primary", "dual", None, None),
        ("named", east(35.2), "forward", "primary", None, "4", "x"), ("named back", east(35.2 + 39 * d)[::-1], "forward", "residential", None, " 4 ", None),
        ("too far", east(35.3), "forward", "primary", None, "5", None), ("too far back", east(35.3 + 41 * d)[::-1], "forward", "primary", None, "5", None),
        ("same way", east(35.4), "forward", "primary", None, "6", None), ("same way too", east(35.4 + 5 * d), "forward", "primary", None, "6", None),
        ("backward", east(35.5), "forward", "primary", None, "7", None), ("backward too", east(35.5 + 30 * d), "backward", "primary", None, "7", None),
        ("relay", east(35.6), "forward", "primary", None, None, None), ("first half", east(35.6 + 14 * d, n=0.0011)[::-1], "forward", "primary", None, None, "a"), ("second half", east(35.6 + 14 * d, x=139.7009, n=0.0011)[::-1], "forward", "primary", None, None, "b"),
        ("half only", east(35.7), "forward", "primary", None, None, None), ("its half", east(35.7 + 10 * d, n=0.001)[::-1], "forward", "primary", None, None, None),
        ("other kind", east(35.8), "forward", "primary", None, None, None), ("side road", east(35.8 + 10 * d)[::-1], "forward", "service", None, None, None),
        ("other name", east(35.9), "forward", "primary", None, None, "p"), ("other name back", east(35.9 + 10 * d)[::-1], "forward", "primary", None, None, "q"),
        ("loop", [(139.7, 36.0), (139.71, 36.0), (139.7, 36.0)], "forward", "primary", "dual", None, None),
    ]
    got = lines.divided(spark.createDataFrame(rows, f"way string, points {POINTS}, direction string, highway string, carriageway string, ref string, name string"))
    assert {r.way for r in got.where("divided").collect()} == {"tag", "named", "named back", "backward", "backward too", "relay", "first half", "second half", "its half"}
    assert got.count() == len(rows)


def groups_by_hand(points, eps):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(points):
        for j, b in enumerate(points[:i]):
            if a[1] == b[1] and metres(a[2:], b[2:]) <= eps:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {p[0]: points[find(i)][0] for i, p in enumerate(points)}


@pytest.mark.parametrize("pairs", [1, 20, 4096])
def test_clusters_at_any_split(spark, pairs):
    rng = random.Random(9)
    points = [(i, rng.choice(["a", "b", None]), 139.7 + rng.gauss(0, 0.01), 35.6 + rng.gauss(0, 0.01)) for i in range(350)]
    points += [(400 + i, "a", 139.75 + i % 2 * 0.0027, 35.65) for i in range(30)]  # two places in the next cells
    frame = spark.createDataFrame(points, "k int, kind string, lon double, lat double")
    for eps in (130.0, 300.0):
        got = spatial.clusters(frame, "k", eps, ["kind"], pairs)
        assert {r.k: r.cluster for r in got.collect()} == groups_by_hand(points, eps)


def test_clusters_of_crowded_cells(spark):
    """Two crowds of 100,000 points: near one another by one pair only, and not at all."""
    crowd = spark.range(100_000).select("id", (139.7 + F.rand(1) * 1e-4).alias("lon"), (35.6 + F.rand(2) * 1e-4).alias("lat"))
    far = spark.range(100_000).select((F.col("id") + 100_000).alias("id"), (139.7025 + F.rand(3) * 1e-4).alias("lon"), (35.6 + F.rand(4) * 1e-4).alias("lat"))
    both = crowd.unionByName(far)
    assert spatial.clusters(both, "id", 200.0).select("cluster").distinct().count() == 2
    assert spatial.clusters(both, "id", 240.0).select("cluster").distinct().count() == 1
    lost = spark.createDataFrame([(1, None, 35.6), (2, 139.7, 35.6)], "id int, lon double, lat double")
    assert {r.id: r.cluster for r in spatial.clusters(lost, "id", 10.0).collect()} == {1: 1, 2: 2}
    assert spatial.clusters(lost.limit(0), "id", 10.0).count() == 0


def choose_by_hand(candidates, rows, wanted, thresholds, spread):
    own = {}
    for route, segment, length in rows:
        own.setdefault(route, {})
        own[route][segment] = max(length, own[route].get(segment, 0))
    chosen = []
    over = lambda r: max((sum(v for s, v in own[r].items() if s in own[c]) / sum(own[r].values()) for c in chosen), default=0.0)
    angle = lambda a, b: min((a - b) % 360, (b - a) % 360)
    info = {c[0]: c for c in candidates if c[0] in own}
    for limit in thresholds:
        while len(chosen) < wanted:
            rest = [r for r in info if r not in chosen and over(r) <= limit]
            if not rest:
                break
            gap = lambda r: -min(angle(info[r][2], info[c][2]) for c in chosen) if chosen else 1.0
            chosen.append(min(rest, key=lambda r: (info[r][1], *((gap(r), info[r][3]) if spread else ()), r)))
    return chosen


@pytest.mark.parametrize("spread", [False, True])
def test_diverse_choice_is_the_greedy_one(spark, spread):
    rng = random.Random(7 + spread)
    requests, candidates, rows = {}, [], []
    for req in range(12):
        own = [(i, rng.randint(0, 3) if spread else i, float(rng.randint(0, 359)), float(rng.randint(0, 9))) for i in range(rng.randint(1, 25))]
        runs = [(i, rng.randint(0, 14), float(rng.randint(1, 9))) for i, *_ in own for _ in range(rng.randint(0, 9))]
        requests[req] = choose_by_hand(own, runs, 5, (0.2, 0.5), spread)
        candidates += [(req, *c) for c in own]
        rows += [(req, *r) for r in runs]
    c = spark.createDataFrame(candidates, "req int, route int, position int, bearing double, closeness double")
    r = spark.createDataFrame(rows, "req int, route int, segment int, length double")
    got = {q: [] for q in requests}
    for x in routes.pick_diverse(c, r, 5, (0.2, 0.5), ["req"], spread).orderBy("req", "choice").collect():
        got[x.req].append(x.route)
    assert got == requests
    one = routes.pick_diverse(c.where("req = 3").drop("req"), r.where("req = 3").drop("req"), 5, (0.2, 0.5), spread=spread)
    assert [x.route for x in one.orderBy("choice").collect()] == requests[3]
    assert routes.pick_diverse(c.limit(0), r, 5, by=["req"]).count() == 0
