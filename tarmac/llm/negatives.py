"""Hard negatives by a Voronoi-partitioned nearest-neighbour join on exact integer scores.

A row ``s`` is lifted by one coordinate, ``sqrt(M^2 - |s|^2)`` with M the largest norm, and an anchor ``a`` by 0.  Then
``|s - a|^2 = M^2 + |a|^2 - 2 s.a``, so the highest inner products are the nearest neighbours.  Anchors belong to the cell
of their nearest pivot.  A row's distance to a pivot bounds its distance to all anchors of that cell, and it is sent to a
group of cells only where the bound allows that an anchor there needs it:

- positives: the k-th nearest row of a label to the pivot bounds how far the k-th positive of an anchor can be;
- negatives: the scores of an anchor's positives bound the distances of the rows that it can take.

Groups hold a bounded number of anchors and rows are dealt into slices, so a join task has one block of anchors in memory and
reads its rows as a stream.  Every slice returns a handful of rows an anchor, and those are ranked in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm import vectors
from tarmac.llm.frames import emit_rows, importable, quoted, stored

_NO_ID = 2**63 - 1  # a null id, which comes last among ties
_CHUNK, _ROWS = 1024, 2048  # anchors and rows of one block of scores


def centres(points: np.ndarray, wanted: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Pivots of a sample: different points, then some rounds of moving each to the mean of those nearest to it."""
    points = np.unique(points, axis=0).astype(np.float64)
    at = points[np.sort(np.random.default_rng(seed).permutation(len(points))[:wanted])]
    for _ in range(rounds if len(points) > wanted else 0):
        own = np.argmin((at**2).sum(axis=1) - 2 * points @ at.T, axis=1)
        sums, n = np.zeros_like(at), np.bincount(own, minlength=len(at))
        np.add.at(sums, own, points)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


class Space:
    """What tasks know of the vectors: dimensions, square of the largest norm, an exact type for scores, and pivots."""

    def __init__(self, dims: int, square: float) -> None:
        self.dims, self.square = dims, square
        most = square * (1 + 1e-9)  # no score and no part of its sum is larger
        if most >= 2**62:
            raise ValueError("scores of these vectors do not fit 64 bits")
        self.kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        self.slack = 1e-6 * (square**0.5 + 1)
        self.pivots = np.zeros((0, dims))

    def read(self, column: pa.Array) -> np.ndarray:
        return vectors.from_bytes(column, self.dims)

    def away(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to the pivots, of lifted rows or of anchors."""
        x = x.astype(np.float64)
        own = self.square if lifted else (x**2).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(own + (self.pivots**2).sum(axis=1) - 2 * x @ self.pivots.T, 0.0))


def best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their slot: higher scores first, smaller ids on ties."""
    order = np.lexsort((ids, -score, slot))
    own = slot[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


class Held:
    """The first k entries of each slot so far, and the score that a new entry of a full slot must exceed."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -(2**63), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Ids do not fall from call to call, so an entry that ties with a full slot's last one is behind it."""
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        kept = best(slot, score, ids, self.k)
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]
        last = np.flatnonzero(np.append(self.slot[1:] != self.slot[:-1], True))
        n = np.bincount(self.slot, minlength=len(self.least))
        full = last[n[self.slot[last]] >= self.k]
        self.least[self.slot[full]] = self.score[full]


class Block:
    """One block of anchors of a slice; rows pass by and leave their best in ``held``."""

    def __init__(self, space: Space, anchors: list[pa.RecordBatch], k: int, labels: dict[str, int]) -> None:
        table = pa.Table.from_batches(anchors)
        self.space, self.labels, self.k = space, labels, k
        column = lambda c: table.column(c).combine_chunks()
        self.keys, self.ids = column("key").to_numpy(), column("id").to_numpy()
        self.vec, self.x = column("vec").to_pylist(), space.read(column("vec")).astype(space.kind)
        self.code = self._codes(column("label"))
        self.low, self.high = (np.array(column(c).to_pylist(), object) for c in ("low", "high"))

    def _codes(self, column: pa.Array) -> np.ndarray:
        return np.array([self.labels.setdefault(x, len(self.labels)) for x in column.to_pylist()], np.int64)

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part.column("id").to_numpy(), self._codes(part.column("label")), self.space.read(part.column("vec")).astype(self.space.kind), part.column("vec")


class Positives(Block):
    """The k other rows of an anchor's label with the highest scores."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.held, self.met = Held(len(self.keys), self.k), np.zeros(len(self.keys), bool)
        self.named: dict[int, list[int]] = {}
        for i, own in enumerate(self.ids.tolist()):
            self.named.setdefault(own, []).append(i)
        self.places = [np.flatnonzero(self.code == c) for c in range(len(self.labels))]

    def take(self, batch: pa.RecordBatch) -> None:
        for ids, code, x, vec in self.rows(batch):
            for c in np.unique(code):
                ours = self.places[c] if c < len(self.places) else np.zeros(0, int)
                theirs = np.flatnonzero(code == c)
                for at in range(0, len(ours), _CHUNK):
                    self._scores(ours[at : at + _CHUNK], ids[theirs], x[theirs], vec.take(pa.array(theirs)))

    def _scores(self, ours: np.ndarray, ids: np.ndarray, x: np.ndarray, vec: pa.Array) -> None:
        score = (self.x[ours] @ x.T).astype(np.int64)
        place = {int(a): i for i, a in enumerate(ours)}
        for j in np.flatnonzero(np.isin(ids, self.ids[ours])):  # the anchor's own row, once
            for a in self.named[int(ids[j])]:
                if a in place and not self.met[a] and vec[int(j)].as_py() == self.vec[a]:
                    self.met[a], score[place[a], j] = True, -(2**63)
        least = self.held.least[ours][:, None]
        if score.shape[1] > self.k:
            kth = np.partition(score, -self.k, axis=1)[:, -self.k][:, None]
            fits = (score > least) & (score >= kth)
        else:
            fits = score > least
        a, j = np.nonzero(fits)
        self.held.add(ours[a], score[a, j], ids[j])

    def found(self) -> dict:
        h = self.held
        return {"key": self.keys[h.slot], "place": np.zeros(len(h.slot), np.int32), "id": h.ids, "score": h.score}


class Negatives(Block):
    """For each positive of an anchor, the k rows of other labels with the highest scores between its bounds."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.wide = max(map(len, self.low), default=0)
        low, high = np.full((len(self.keys), self.wide), 2**62, np.int64), np.full((len(self.keys), self.wide), -(2**62), np.int64)
        for i, (a, b) in enumerate(zip(self.low, self.high, strict=True)):
            low[i, : len(a)], high[i, : len(b)] = a, b
        self.low, self.high = low, high
        self.held = Held(len(self.keys) * self.wide, self.k)

    def take(self, batch: pa.RecordBatch) -> None:
        for ids, code, x, _ in self.rows(batch):
            for at in range(0, len(self.keys), _CHUNK):
                ours = slice(at, at + _CHUNK)
                score = self.x[ours] @ x.T
                fits = (score >= self.low[ours].min(axis=1)[:, None]) & (score <= self.high[ours].max(axis=1)[:, None]) & (self.code[ours][:, None] != code)
                a, j = np.nonzero(fits)
                own, a = score[a, j].astype(np.int64), a + at
                slot, values, rows = [], [], []
                for p in range(self.wide):
                    s = a * self.wide + p
                    ok = (own >= self.low[a, p]) & (own <= self.high[a, p]) & (own > self.held.least[s])
                    slot.append(s[ok])
                    values.append(own[ok])
                    rows.append(ids[j[ok]])
                self.held.add(np.concatenate(slot), np.concatenate(values), np.concatenate(rows))

    def found(self) -> dict:
        h = self.held
        return {"key": self.keys[h.slot // self.wide], "place": (h.slot % self.wide).astype(np.int32), "id": h.ids, "score": h.score}


def _joined(anchors: DataFrame, rows: DataFrame, space: Space, kind: type[Block], k: int, slices: int) -> DataFrame:
    """``(key, place, id, score)``: the best rows of each slice for the anchors of each unit."""
    none = F.lit(None).cast("array<bigint>")
    ours = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("unit", "slice", F.lit(0).alias("kind"), "key", "id", "label", "vec", "low", "high")
    theirs = rows.select("unit", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("key"), "id", "label", "vec", none.alias("low"), none.alias("high"))
    dealt = ours.unionByName(theirs).repartition("unit", "slice").sortWithinPartitions("unit", "slice", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, waiting, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("unit", "slice", "kind")], axis=1)
            edges = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1))).tolist()
            for start, end in zip(edges, [*edges[1:], len(marks)], strict=True):
                own, part = tuple(marks[start, :2]), batch.slice(start, end - start)
                if own != at:
                    if block:
                        yield block.found()
                    at, waiting, block = own, [], None
                if marks[start, 2] == 0:
                    waiting.append(part)
                    continue
                if waiting and block is None:
                    block, waiting = kind(space, waiting, k, {}), []
                if block:
                    block.take(part)
        if block:
            yield block.found()

    return emit_rows(dealt, run, {"key": T.LongType(), "place": T.IntegerType(), "id": T.LongType(), "score": T.LongType()})


def _nearest(rows: DataFrame, space: Space, k: int) -> DataFrame:
    """``(label, cell, reach)``: distance of the k-th nearest row of each label to each pivot; null if there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[dict]:
            for label, found in held.items():
                yield {"label": [label] * len(space.pivots), "cell": np.arange(len(space.pivots)), "near": found.T.tolist()}
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                away, label = space.away(space.read(part.column("vec")), True), np.array(part.column("label").to_pylist(), object)
                for own in set(label.tolist()):
                    found = np.concatenate([held[own], away[label == own]]) if own in held else away[label == own]
                    held[own] = np.partition(found, k - 1, axis=0)[:k] if len(found) > k else found
            if len(held) > 2048:
                yield from out()
        yield from out()

    parts = emit_rows(rows.select("label", "vec"), run, {"label": T.StringType(), "cell": T.IntegerType(), "near": T.ArrayType(T.DoubleType())})
    near = parts.select("label", "cell", F.explode("near").alias("d")).withColumn("_n", F.row_number().over(Window.partitionBy("label", "cell").orderBy("d"))).where(F.col("_n") <= k)
    return near.groupBy("label", "cell").agg(F.max(F.when(F.col("_n") == k, F.col("d"))).alias("reach"))


def _sent(rows: DataFrame, space: Space, units: list[list[int]], bounds: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(unit, id, label, vec)``: rows, once for each unit of a cell between whose bounds they lie."""
    cells = np.array([[c, u] for c, own in enumerate(units) for u in own]).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                away = space.away(space.read(part.column("vec")), True)
                low, high = bounds(part)
                i, c = np.nonzero((away >= low - space.slack) & (away <= high + space.slack))
                hit = np.zeros((part.num_rows, 1 + cells[:, 1].max(initial=0)), bool)
                for cell, unit in cells.tolist():
                    hit[i[c == cell], unit] = True
                i, unit = np.nonzero(hit)
                own = part.take(pa.array(i))
                yield {"unit": unit, **{name: own.column(name) for name in ("id", "label", "vec")}}

    return emit_rows(rows, run, {"unit": T.IntegerType(), "id": T.LongType(), "label": T.StringType(), "vec": T.BinaryType()})


def _units(counts: dict[int, int], pivots: np.ndarray, groups: int, most: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Units of each cell; the first unit and the number of units of each cell's group.

    Cells next to one another along the pivots' widest direction form ``groups`` groups of like numbers of anchors; a
    group with more than ``most`` is split into units of that many.
    """
    n = np.array([counts.get(c, 0) for c in range(len(pivots))])
    _, _, axis = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)
    order = np.argsort(pivots @ axis[0], kind="stable")
    group = np.zeros(len(pivots), int)
    group[order] = np.minimum((np.cumsum(n[order]) - n[order]) * groups // max(1, n.sum()), groups - 1)
    sizes = np.bincount(group, weights=n, minlength=groups).astype(int)
    split = np.maximum(1, -(-sizes // most))
    first = np.cumsum(split) - split
    units = [list(range(first[g], first[g] + split[g])) if n[c] else [] for c, g in enumerate(group)]
    return units, first[group], split[group]


def mine(
    df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), pivots: int = 64, groups: int = 4,
    sample: int = 4096, block: int = 1 << 16, slice_rows: int = 1 << 17,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows of ``anchor``.

    Vectors become integers ``floor(256 * c)``; a score is their inner product, exact.  An anchor's positives are the first
    ``positives`` other rows of its label, its negatives for a positive of score p the first ``negatives`` rows of other labels
    with ``band[0] * p <= 100 * score <= band[1] * p`` (none if p is negative); higher scores first, then smaller ids.  Where
    there are fewer, all are returned; an anchor without positives, or a positive without negatives, has no rows.

    Rows with a null label, or a vector that is null or holds a null or non-finite entry, take no part.  A null id comes
    last among ties.  A repeated row is another row, with the same id; as anchors, repeated rows count once.  Shorter
    vectors are continued by zeros.  An empty table gives no rows; other columns are not read.  Scores beyond 64 bits are an
    error.  Pivots come from ``sample`` anchors, which changes what is sent where and never the result; where vectors have no
    clusters, every row goes to every group: ``groups``, more if one has over ``block`` anchors.
    """
    importable(df.sparkSession)
    spark = df.sparkSession
    own = df.where(quoted(label).isNotNull()).select(F.coalesce(quoted(vec_id).cast("long"), F.lit(_NO_ID)).alias("id"), quoted(label).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), quoted(vector).alias("v"))
    rows, n, dims, _ = vectors.measured_rows(own, "v", ["id", "label", "anchor"])
    rows = rows.select(F.col("k0").alias("id"), F.col("k1").alias("label"), F.col("k2").alias("anchor"), "vec", "square")
    space = Space(dims, rows.agg(F.max("square")).first()[0] or 0.0)
    chosen = rows.where("anchor").select("id", "label", "vec").distinct()
    drawn = [r["vec"] for r in chosen.orderBy(F.xxhash64("id", "vec")).limit(sample).collect()]
    if not drawn:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    space.pivots = centres(space.read(pa.array(drawn, pa.binary())), pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = space.read(batch.column("vec"))
            away = space.away(x, False)
            cell = np.argmin(away, axis=1)
            yield {**{c: batch.column(c) for c in ("id", "label", "vec")}, "cell": cell, "away": away[np.arange(len(cell)), cell], "square": (x.astype(np.float64) ** 2).sum(axis=1)}

    fields = {"id": T.LongType(), "label": T.StringType(), "vec": T.BinaryType(), "cell": T.IntegerType(), "away": T.DoubleType(), "square": T.DoubleType()}
    anchors = stored(emit_rows(chosen, placed, fields).withColumn("key", F.monotonically_increasing_id()))
    counts = {r["cell"]: r["count"] for r in anchors.groupBy("cell").count().collect()}  # a row a pivot
    units, first, split = _units(counts, space.pivots, min(groups, len(counts)), block)
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    anchors = anchors.withColumn("unit", (at(first) + F.pmod(F.xxhash64("key"), at(split))).cast("int"))
    slices = max(-(-n // slice_rows), min(8, -(-n // 4096)))

    # positives: of a row's label, how far from each pivot it may be
    reach = _nearest(rows, space, positives + 1).join(anchors.groupBy("label", "cell").agg(F.max("away").alias("wide")), ["label", "cell"])
    reach = stored(reach.groupBy("label").agg(F.collect_list(F.struct("cell", (F.coalesce("reach", F.lit(float("inf"))) + 2 * F.col("wide")).alias("high"))).alias("bounds")))
    n_pivots = len(space.pivots)

    def by_label(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        high, known = np.full((part.num_rows, n_pivots), -np.inf), {}
        for i, (name, bounds) in enumerate(zip(part.column("label").to_pylist(), part.column("bounds"), strict=True)):
            if name not in known:
                known[name] = np.full(n_pivots, -np.inf)
                for b in bounds.as_py():
                    known[name][b["cell"]] = b["high"]
            high[i] = known[name]
        return np.zeros(1), high

    none = F.lit(None).cast("array<bigint>")
    alike = _sent(rows.join(reach, "label").select("id", "label", "vec", "bounds"), space, units, by_label)
    found = _joined(anchors.withColumn("low", none).withColumn("high", none), alike, space, Positives, positives, slices)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    found = found.withColumn("place", place).where(F.col("place") <= positives)
    # the lowest score that a negative may have: 80 * p <= 100 * s
    wide = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(wide * band[0] / 100), F.floor(wide * band[1] / 100)
    ranked = found.where("score >= 0").withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))
    lists = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "low", "high"))).alias("p"))  # five a key
    served = stored(anchors.join(lists, "key").select("key", "id", "label", "vec", "cell", "away", "square", "unit", F.col("p.id").alias("ids"), F.col("p.score").alias("scores"), F.col("p.low").alias("low"), F.col("p.high").alias("high")))

    # negatives: how near to and how far from each pivot a row may be
    apart = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.lit(space.square) + F.col("square") - 2 * score))
    ring = served.groupBy("cell").agg(F.min(apart(F.array_max("high")) - F.col("away")).alias("low"), F.max(apart(F.array_min("low")) + F.col("away")).alias("high")).collect()  # a row a pivot
    near, far = np.full(n_pivots, np.inf), np.full(n_pivots, -np.inf)
    for r in ring:
        near[r["cell"]], far[r["cell"]] = r["low"], r["high"]
    other = _joined(served, _sent(rows.select("id", "label", "vec"), space, units, lambda _: (near, far)), space, Negatives, negatives, slices)
    rank = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("score"), "id"))
    other = other.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = other.withColumnRenamed("id", "_n").withColumnRenamed("score", "negative_score").join(served.select("key", "id", "ids", "scores"), "key")
    of = lambda c: F.element_at(c, F.col("place") + 1)
    real = lambda c: F.when(c != _NO_ID, c)
    return named.select(real(F.col("id")).alias("anchor_id"), real(of("ids")).alias("positive_id"), "rank", real(F.col("_n")).alias("negative_id"), of("scores").alias("positive_score"), "negative_score")
