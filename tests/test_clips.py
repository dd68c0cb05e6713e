"""Clipping against plain loops over random lines and rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import tiles

BOX = (10.0, 20.0, 50.0, 60.0)
KIND = "k int, points array<struct<x:double,y:double>>"


def inside(p):
    return BOX[0] <= p[0] <= BOX[2] and BOX[1] <= p[1] <= BOX[3]


def test_lines_keep_what_is_inside(spark):
    rng = random.Random(6)
    lines = [[(float(rng.randint(0, 70)), float(rng.randint(0, 80))) for _ in range(rng.randint(0, 7))] for _ in range(60)]
    lines += [[(0.0, 40.0), (70.0, 40.0)], [(12.0, 22.0), (12.0, 22.0), (30.0, 30.0)], [(10.0, 0.0), (10.0, 70.0)], [(0.0, 20.0), (10.0, 20.0)], [(0.0, 30.0), (20.0, 10.0)], [(5.0, 5.0)]]
    out = spark.createDataFrame(list(enumerate(lines)), KIND).select("k", tiles.clip_line(F.col("points"), BOX).alias("parts")).collect()
    for r in out:
        line, steps = lines[r.k], 4000
        kept = sum(math.dist(a, b) for part in r.parts for a, b in zip(part, part[1:], strict=False))
        want = 0.0
        for a, b in zip(line, line[1:], strict=False):
            hits = sum(inside((a[0] + (b[0] - a[0]) * (i + 0.5) / steps, a[1] + (b[1] - a[1]) * (i + 0.5) / steps)) for i in range(steps))
            want += math.dist(a, b) * hits / steps
        assert kept == pytest.approx(want, abs=0.2)
        assert all(len(part) > 1 and all(BOX[0] - 1e-9 <= p.x <= BOX[2] + 1e-9 and BOX[1] - 1e-9 <= p.y <= BOX[3] + 1e-9 for p in part) for part in r.parts)
        assert all(tuple(a[-1]) != tuple(b[0]) for a, b in zip(r.parts, r.parts[1:], strict=False))
    got = {r.k: r.parts for r in out}
    assert [len(got[60 + i]) for i in range(6)] == [1, 1, 1, 0, 0, 0]


def test_rings_keep_the_area_inside(spark):
    rng = random.Random(2)
    rings = []
    for _ in range(40):  # star-shaped, so without crossings
        x, y = rng.uniform(0, 70), rng.uniform(0, 80)
        rings.append([(x + math.cos(t) * r, y + math.sin(t) * r) for t, r in ((2 * math.pi * i / 9, rng.uniform(4, 35)) for i in range(9))])
    rings += [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)], []]
    out = spark.createDataFrame(list(enumerate(rings)), KIND).select("k", tiles.clip_ring(F.col("points"), BOX).alias("ring")).select("k", "ring", tiles.ring_area(F.col("ring")).alias("area")).collect()

    def holds(ring, p):
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
        return odd

    n = 80
    for r in out:
        hits = sum(holds(rings[r.k], (BOX[0] + 40 * (i + 0.5) / n, BOX[1] + 40 * (j + 0.5) / n)) for i in range(n) for j in range(n))
        assert r.area == pytest.approx(1600 * hits / n / n, abs=30)
    assert {r.k: r.area for r in out}[40] == pytest.approx(1600.0) and [len(r.ring) for r in out if r.k > 40] == [0, 0]
