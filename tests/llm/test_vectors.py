"""Mixing, hard negatives and whitening against brute force; odd rows, ties, repeated rows, empty tables, clashing names."""

import itertools
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.llm import mix, negatives, queries, vectors, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def ints(v):
    """The contract's integers, or None if the vector takes no part."""
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(256 * float(c)) for c in v]


@pytest.fixture(scope="module")
def cloud():
    """Vectors in clusters, repeated ones, ties, odd ones."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 0.4, (6, 8))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 6] + rng.normal(0, 0.1, 8)], int(rng.integers(0, 4))) for i in range(700)]
    hot = rows[100][1]
    rows = [(i, hot if i % 5 == 0 and i > 300 else v, k) for i, v, k in rows]
    rows += [(1000, rows[0][1], 0), (1000, rows[0][1], 0), (1100, rows[0][1], 1), (1200, [0.0] * 8, 2), (1300, [5.0] * 8, 3), (1400, [-0.0, 1.0], 0), (1500, [], 1), (None, rows[3][1], 2), (None, hot, 1), (200, hot, 3)]
    rows += [(1600, None, 1), (1700, [1.0, None] * 4, 1), (1800, [float("nan")] * 8, 2), (1900, [float("inf")] + [0.0] * 7, 2), (2000, hot, None), (2100, hot, 99)]
    return rows


def brute_negatives(rows, k=5):
    table = []
    for i, v, label in rows:
        x = ints(v)
        if x is None or label is None:
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        table.append((i, label, tuple(x)))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = Counter()
    for a in {t for t in table if t[0] is not None and t[0] % 100 == 0}:
        rest = list(table)
        rest.remove(a)
        order = sorted(rest, key=lambda t: (-dot(a[2], t[2]), t[0] if t[0] is not None else math.inf))
        for p in [t for t in order if t[1] == a[1]][:k]:
            top = dot(a[2], p[2])
            fits = [t for t in order if t[1] != a[1] and 80 * top <= 100 * dot(a[2], t[2]) <= 100 * top][:k]
            for rank, t in enumerate(fits, 1):
                out[a[0], p[0], rank, t[0], top, dot(a[2], t[2])] += 1
    return out


def labelled(frame):
    v = F.col("vec_id")
    return frame.withColumn("label", F.when(v % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


@pytest.mark.parametrize("settings_of", [{}, {"pivots": 3, "groups": 2, "slice_rows": 90}, {"pivots": 20, "groups": 9, "block": 2, "slice_rows": 300}])
def test_hard_negatives_match_brute_force(spark, cloud, settings_of):
    want = brute_negatives(cloud)
    frame = labelled(spark.createDataFrame(cloud, SCHEMA).repartition(3))
    if settings_of:
        frame = frame.withColumns({c: F.lit(1) for c in ("id", "vec", "key", "unit", "slice", "k0", "square", "rank", "cell", "anchor")})
    got = negatives.mine(frame, F.col("vec_id") % 100 == 0, **settings_of)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert len(want) > 100 and any(key[4] == key[5] for key in want)


def test_hard_negatives_send_rows_only_where_they_may_be_needed(spark):
    """Clusters apart: a row goes to its own cluster's group only."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.eye(4)[i % 4] + rng.normal(0, 0.01, 4)], (i // 4) % 2) for i in range(1200)]
    sent = []
    plain = negatives._sent

    def counted(*args):
        out = plain(*args)
        sent.append(out.count())
        return out

    negatives._sent = counted
    try:
        got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 < 4, pivots=8, groups=4)
        assert got.count() > 0
    finally:
        negatives._sent = plain
    assert all(n <= 1.3 * len(rows) for n in sent), sent


def test_hard_negatives_of_nothing(spark, cloud):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame(cloud[:50], SCHEMA), F.lit(False)).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, None, 1)], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [3e38] * 3, 1), (1, [1.0] * 3, 1)], SCHEMA).limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(spark.createDataFrame([(0, [3e38] * 3, 1)], SCHEMA), F.lit(True))


@pytest.mark.parametrize("size", [1.0, 1e4, 1e6])
def test_scores_are_exact_at_any_size(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, size, 5)], i % 3) for i in range(260)]
    got = negatives.mine(labelled(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")), F.col("vec_id") % 100 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows)


def brute_scatter(rows):
    fit = sorted({tuple(x) for x in rows})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = [[n * v - s for v, s in zip(x, total, strict=True)] for x in fit]
    return n, total, [[sum(r[i] * r[j] for r in y) for j in range(len(total))] for i in range(len(total))]


def test_whitening_matches_exact_fractions(spark, cloud):
    whole = [(i, x + [0] * (8 - len(x))) for i, v, _ in cloud if (x := ints(v)) is not None]
    n, total, exact = brute_scatter([x for _, x in whole])
    covariance = np.array([[float(Fraction(v, n**3)) for v in row] for row in exact])
    values, axes = np.linalg.eigh(covariance)
    frame = spark.createDataFrame(cloud, SCHEMA).repartition(4)
    for extra in ({}, {c: F.lit(1) for c in ("n", "component", "vec", "k0", "dims", "whitened")}):
        got = whiten.whitened(frame.withColumns(extra)).collect()
        assert len(got) == 4 * len(whole)
        assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == Counter((i, c, n, sum((n * v - s) ** 2 for v, s in zip(x, total, strict=True))) for i, x in whole for c in (1, 2, 3, 4))
        assert all(abs(r.explained - values[-r.component] / values.sum()) < 1e-12 and r.identity_error < 1e-9 for r in got)
        by_id = {(i, tuple(x)) for i, x in whole}
        known = {i: x for i, x in by_id if i is not None and i not in (200, 1000)}
        for r in got:
            if r.vec_id in known:
                want = (np.array(known[r.vec_id]) - np.array(total) / n) @ axes[:, -r.component] / math.sqrt(values[-r.component])
                assert abs(abs(r.whitened) - abs(want)) < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whiten.whitened(make([])).count() == 0
    assert whiten.whitened(make([(1, None), (2, [None])])).count() == 0
    assert whiten.whitened(make([(1, []), (2, [])])).count() == 0
    alone = whiten.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    line = whiten.whitened(make([(i, [float(i), 0.0, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in line)
    huge = whiten.whitened(make([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [4e15, 3.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge) and all(r.identity_error < 1e-6 for r in huge)


@settings(max_examples=30, deadline=None)
@given(st.integers(-(2**150), 2**150))
def test_remainders_return_the_integer(value):
    moduli = whiten.primes(2 * abs(value))
    assert whiten.remaindered([value % p for p in moduli], moduli) == value
    assert all(p < 2**21 and all(p % q for q in range(2, 1500)) for p in moduli)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40) | st.integers(-9, 9), max_size=5), max_size=6))
def test_vectors_as_bytes(rows):
    matrix = np.zeros((len(rows), 5), np.int64)
    for i, r in enumerate(rows):
        matrix[i, : len(r)] = r
    import pyarrow as pa

    found = vectors.to_bytes(matrix)
    assert (vectors.from_bytes(pa.array(found, pa.binary()), 5) == matrix).all()
    for (a, x), (b, y) in itertools.combinations(zip(found, matrix.tolist(), strict=True), 2):
        assert (a == b) == (x == y)


@pytest.mark.parametrize("value", [2**31 - 1, 2**45, 2**62])
def test_deviations_of_large_sums(value):
    x = np.array([[1, value, -3], [0, 0, 0], [value, -value, value]], np.int64)
    total = [int(c) * 5 + 7 for c in x.sum(axis=0, dtype=object)]
    for n in (3, 10**9):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist()]
        assert whiten._deviations(x, n, total, int(np.abs(x).max())) == [w if w < 2**63 else None for w in want]


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        by = sum(weight[s] for s in names if s not in full) or 1
        more = {s for s in names if s not in full and Fraction(rest * weight[s], by) > limit * sizes[s]}
        if not more:
            return {s: limit * sizes[s] if s in full else rest * weight[s] / by for s in names}
        full |= more


def mixed_by_hand(rows, got):
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    targets = brute_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-9 * (1 + r.target)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for source in sizes:
        assert len({r.copies for r in got if r.source == source and r.size}) <= 2
    return {s: taken[s] - targets[s] for s in sizes}


@pytest.fixture(scope="module")
def sources():
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 90)), ["a", "b", "c", None, "é", "\U0001f600"][int(rng.integers(0, 6))]) for i in range(900)]
    rows += [(2000 + i, "same text here", "b") for i in range(500)]
    return rows + [(5000, None, "a"), (5001, "", "z"), (5002, None, None), (5003, "x " * 3000, "c"), (None, "no id", "a"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (7, "used id", "a")]


def test_mix_meets_targets_to_the_word(spark, sources):
    frame = spark.createDataFrame(sources, "doc_id bigint, text string, source string")
    got = mix.mixed(frame.repartition(5)).collect()
    off = mixed_by_hand(sources, got)
    assert all(abs(v) <= 0.5 + 1e-6 for v in off.values()), off
    again = mix.mixed(frame.repartition(2).withColumns({c: F.lit(0) for c in ("part", "hash", "size", "rank", "place", "k0", "_s", "n")}), keep=["doc_id", "source"]).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in again) == Counter((r.doc_id, r.source, r.size, r.copies) for r in got)
    other = mix.mixed(frame, keep=["doc_id"], seed=99).collect()
    assert sum(r.taken for r in other) == sum(r.taken for r in got)
    assert Counter((r.doc_id, r.copies) for r in other) != Counter((r.doc_id, r.copies) for r in got)
    assert mix.repeated(mix.mixed(frame)).agg(F.sum("size")).first()[0] == sum(r.taken for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, " ", None)], [(1, "one two three", "only")], [(1, "w " * 200_000, "a"), (2, "w", "b"), (3, "w w", "c")]])
def test_mix_of_odd_tables(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    off = mixed_by_hand(rows, mix.mixed(frame).collect())
    assert all(abs(v) <= 100_000 for v in off.values())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 7), max_size=7), st.integers(0, 900), st.integers(0, 3))
def test_knapsack_is_the_best_subset_sum(counts, budget, seed):
    """Small budgets go to the knapsack but for equal shares, and of the sums that leaves none is nearer."""
    lengths, n = np.array(sorted(counts), np.int64), np.array([counts[k] for k in sorted(counts)], np.int64)
    take = mix.fit(lengths, n, budget, seed)
    assert ((take >= 0) & (take <= n)).all()
    whole = int((lengths * n).sum())
    got = int((lengths * take).sum())
    floors = np.array([int(c) * budget // whole if x and 0 < budget < whole else 0 for x, c in zip(lengths, n, strict=True)], np.int64)
    if 0 < budget < whole:
        sums = {int((lengths * floors).sum())}
        for x, c, t in zip(lengths, n, floors, strict=True):
            sums = {s + int(x) * k for s in sums for k in range(int(c - t) + 1)}
        assert abs(got - budget) == min(abs(s - budget) for s in sums)
    else:
        assert got == (0 if budget <= 0 else whole)


def test_queries_return_the_columns_of_their_contracts(spark, tmp_path, sources, cloud):
    spark.createDataFrame(sources, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(cloud, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    mixes, mined, white = (queries.QUERIES[n](spark, str(tmp_path)) for n in ("op11_source_mix", "op12_hard_negatives", "op13_whitening"))
    assert mixes.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert mined.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert white.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert mixes.count() == len(sources) and white.count() > 0
    assert Counter(tuple(r) for r in mined.collect()) == brute_negatives(cloud)
