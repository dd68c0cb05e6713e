"""Strong components against reachability by definition, and the rounds that long chains take."""

import numpy as np

from tarmac.operators import strong


def by_definition(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    while True:
        more = {n: set().union(seen, *({b for a, b in edges if a in seen},)) for n, seen in reach.items()}
        if more == reach:
            return {(n, min(m for m in reach[n] if n in reach[m])) for n in nodes}
        reach = more


def found(spark, edges):
    return {(r.node, r.component) for r in strong.components(spark.createDataFrame(edges, "tail bigint, head bigint")).collect()}


def test_components_of_all_shapes(spark):
    rng = np.random.default_rng(5)
    ring = lambda a, n: [(a + i, a + (i + 1) % n) for i in range(n)]
    shapes = [
        ring(0, 7) + ring(10, 3) + [(2, 11), (5, 5)],  # two rings, one link, one loop
        [(i, i + 1) for i in range(9)] + [(4, 100), (101, 3)],  # a chain with side leaves
        ring(0, 6) + ring(0, 4) + [(3, 20), (20, 21), (21, 22), (22, 1), (22, 30), (30, 31), (31, 22)],  # chains between, and back to one node
        [(i, i + 1) for i in range(6)] + [(i + 1, i) for i in range(3)] + [(6, 4)],  # two-way, then one-way
        ring(0, 5) + ring(10, 5) + [(0, 10), (1, 12), (3, 14)] + ring(20, 4) + [(22, 20), (12, 21)],  # no chain is left, three components
        [(7, 7)],
    ]
    shapes += [[(int(a), int(b)) for a, b in rng.integers(0, 30, (m, 2))] for m in (30, 45)]
    for edges in shapes:
        assert found(spark, edges) == by_definition(edges)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    counted = strong.measured
    monkeypatch.setattr(strong, "measured", lambda *a, **k: rounds.append(1) or counted(*a, **k))
    line = [(i, i + 1) for i in range(n - 1)]
    assert len({c for _, c in found(spark, line)}) == n  # each node alone
    assert len(rounds) < 40
    rounds.clear()
    assert {c for _, c in found(spark, [*line, (n - 1, 0)])} == {0}  # one ring
    assert len(rounds) < 40
    rounds.clear()
    assert {c for _, c in found(spark, [*line, (n - 1, 5000), (5000, 0)])} == {0}  # two chains that meet
    assert len(rounds) < 40


def test_empty_and_null_edges(spark):
    empty = spark.createDataFrame([], "tail bigint, head bigint")
    assert strong.components(empty).count() == 0
    assert strong.largest(empty).count() == 0
    assert found(spark, [(None, 1), (2, None), (3, 4)]) == {(3, 3), (4, 4)}
