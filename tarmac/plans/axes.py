"""The metric language: materials feed axes, axes feed a weighted composite; all compiled to Spark columns.

Null is the only missing marker.  A required term that is missing leaves the axis without a value, an optional one adds
nothing, and an axis none of whose terms has a value has none.  A missing axis leaves the composite, and the other
weights are renormalised.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numbers import compensated_sum, interpolate, round_tenth


class AxisError(ValueError):
    """A definition that cannot be compiled."""


@dataclass(frozen=True)
class Term:
    material: str
    weight: float = 1.0
    required: bool = True


@dataclass(frozen=True)
class Linear:
    """A weighted sum of materials, its sign dropped on demand, read off a broken line and rounded to a tenth."""

    terms: tuple[Term, ...]
    points: tuple[tuple[float, float], ...]
    absolute: bool = False

    def __post_init__(self) -> None:
        if not self.terms or not self.points:
            raise AxisError("terms and points must not be empty")
        numbers = [*(t.weight for t in self.terms), *(v for p in self.points for v in p)]
        if not all(map(math.isfinite, numbers)):
            raise AxisError("weights and points must be finite")
        if any(b[0] <= a[0] for a, b in zip(self.points, self.points[1:], strict=False)):
            raise AxisError("x must ascend strictly")

    def materials(self) -> list[str]:
        return list(dict.fromkeys(t.material for t in self.terms))

    def raw(self) -> Column:
        """The value before the broken line."""
        missing = reduce(lambda a, b: a | b, [F.col(t.material).isNull() for t in self.terms if t.required], F.lit(False))
        nothing = reduce(lambda a, b: a & b, [F.col(t.material).isNull() for t in self.terms])
        value = lambda t: F.coalesce(F.col(t.material).cast("double"), F.lit(0.0)) * t.weight
        total = reduce(lambda a, b: a + b, map(value, self.terms))
        return F.when(~missing & ~nothing, F.abs(total) if self.absolute else total)

    def score(self) -> Column:
        return round_tenth(interpolate(self.raw(), self.points))


@dataclass(frozen=True)
class Categorical:
    """A score for each value of one material, as given; other values have none."""

    material: str
    mapping: Mapping[str | bool, float]

    def __post_init__(self) -> None:
        if not self.mapping or not all(map(math.isfinite, self.mapping.values())):
            raise AxisError("the mapping must not be empty, and its scores must be finite")

    def materials(self) -> list[str]:
        return [self.material]

    def score(self) -> Column:
        items = F.create_map(*[F.lit(x) for k, v in self.mapping.items() for x in (str(k).lower() if isinstance(k, bool) else k, float(v))])
        return F.try_element_at(items, F.col(self.material).cast("string"))


@dataclass(frozen=True)
class Override:
    """Where ``material`` equals ``equals`` the axis is ``value``, whatever its shape says; the first match wins."""

    material: str
    equals: str
    value: float


@dataclass(frozen=True)
class Axis:
    name: str
    shape: Linear | Categorical
    weight: float = 1.0
    published: bool = True
    overrides: tuple[Override, ...] = ()
    night_only: bool = False

    def reads(self) -> list[str]:
        return list(dict.fromkeys([*self.shape.materials(), *(o.material for o in self.overrides)]))

    def column(self) -> Column:
        out = self.shape.score()
        for o in reversed(self.overrides):
            out = F.when(F.coalesce(F.col(o.material).cast("string") == o.equals, F.lit(False)), F.lit(o.value)).otherwise(out)
        return out


@dataclass(frozen=True)
class Material:
    """A catalogue entry: its type, unit, whether values add up along a way, and the column that computes it."""

    name: str
    dtype: str
    unit: str = ""
    additive: bool = False
    column: Column | None = field(default=None, compare=False)
    dynamic: bool = False


def ordered(axes: Sequence[Axis]) -> list[Axis]:
    """Axes after those they read, otherwise in the given order; a cycle is an error."""
    by_name = {a.name: a for a in axes}
    if len(by_name) < len(axes):
        raise AxisError("two axes share a name")
    out: list[Axis] = []
    state: dict[str, int] = {}

    def visit(axis: Axis, trail: tuple[str, ...]) -> None:
        if state.get(axis.name) == 2:
            return
        if state.get(axis.name) == 1:
            raise AxisError(f"axes read one another in a circle: {' -> '.join((*trail, axis.name))}")
        state[axis.name] = 1
        for name in axis.reads():
            if name in by_name:
                visit(by_name[name], (*trail, axis.name))
        state[axis.name] = 2
        out.append(axis)

    for axis in axes:
        visit(axis, ())
    return out


def check(axes: Sequence[Axis], materials: Iterable[Material]) -> None:
    """Raises for unknown names, clashing names and shapes that do not suit a material's type."""
    known = {m.name: m for m in materials}
    names = {a.name for a in axes}
    if clash := names & known.keys():
        raise AxisError(f"names of materials: {sorted(clash)}")
    for axis in ordered(axes):
        for name in axis.reads():
            if name not in known and name not in names:
                raise AxisError(f"{axis.name} reads {name}, which is unknown")
        if isinstance(axis.shape, Linear) and (bad := [n for n in axis.shape.materials() if n in known and known[n].dtype == "categorical"]):
            raise AxisError(f"{axis.name} adds up categories: {bad}")
        if isinstance(axis.shape, Categorical) and known.get(axis.shape.material, Material("", "numeric")).dtype == "numeric":
            raise AxisError(f"{axis.name} looks up the number {axis.shape.material}")
        if not math.isfinite(axis.weight) or axis.weight < 0:
            raise AxisError(f"{axis.name}: a weight is a finite number from zero up")
    moving = {m.name for m in known.values() if m.dynamic}
    for axis in ordered(axes):
        sources = leaves(axis.name, axes)
        if sources & moving and not sources <= moving and axis.published and isinstance(axis.shape, Linear) and len(axis.shape.terms) == 1:
            raise AxisError(f"{axis.name} mixes dynamic and static materials in its conditions")


#: What an axis looks like on a map; these change no score.
COSMETIC = ("icon", "bands", "band_labels")


def check_change(old: Axis, new: Axis | None, looks: tuple[Mapping, Mapping] = ({}, {})) -> None:
    """Raises if a published axis is deleted (``new`` is None) or changed in more than its looks."""
    if not old.published:
        return
    if new is None:
        raise AxisError(f"{old.name} is published and stays")
    if new != old or {k: v for k, v in looks[0].items() if k not in COSMETIC} != {k: v for k, v in looks[1].items() if k not in COSMETIC}:
        raise AxisError(f"{old.name} is published and keeps its scores")


def check_exclusive(axes: Sequence[Axis], materials: Iterable[Material]) -> None:
    """Raises if two axes read the same material, which would count twice; axes may be shared."""
    known = {m.name for m in materials}
    owner: dict[str, str] = {}
    for axis in axes:
        for name in axis.reads():
            if name in known and owner.setdefault(name, axis.name) != axis.name:
                raise AxisError(f"{name} is read by {owner[name]} and {axis.name}")


def check_published(axes: Sequence[Axis]) -> None:
    """Raises if a published axis is read by another published one: its score would count twice in the composite."""
    published = {a.name for a in axes if a.published}
    for axis in axes:
        if axis.published and (inner := [n for n in axis.reads() if n in published]):
            raise AxisError(f"{axis.name} reads {inner}, which count by themselves")


def check_points(axis: Axis) -> None:
    """Raises for broken lines that do not ascend, empty look-ups, and overrides that read nothing."""
    if isinstance(axis.shape, Linear):
        xs = [x for x, _ in axis.shape.points]
        if not xs or any(b <= a for a, b in zip(xs, xs[1:], strict=False)):
            raise AxisError(f"{axis.name}: knots ascend: {xs}")
        if not axis.shape.terms or all(t.weight == 0 for t in axis.shape.terms):
            raise AxisError(f"{axis.name} weighs nothing")
    elif not axis.shape.mapping:
        raise AxisError(f"{axis.name} looks up nothing")
    if bad := [o.material for o in axis.overrides if not math.isfinite(o.value)]:
        raise AxisError(f"{axis.name}: overrides without a value: {bad}")


def density_slope(axis: Axis) -> float:
    """The slope of an axis that is averaged before it is scored; it must be one straight line through zero."""
    points = axis.shape.points
    slopes = {(y1 - y0) / (x1 - x0) for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False)}
    if len(slopes) != 1 or points[0][0] != 0 or points[0][1] != 0:
        raise AxisError(f"{axis.name} is averaged before scoring and needs one line from zero")
    return slopes.pop()


def inspected(df: DataFrame, key: str, value: object, axes: Sequence[Axis], weights: Mapping[str, Column]) -> DataFrame:
    """One row of ``df`` with all its axes, the composite, and each axis' part of it; the key's filter reaches the scan."""
    own = evaluate(df.where(F.col(key) == value), axes)
    return own.select(key, *[a.name for a in axes], composite(weights).alias("composite"), contributions(weights).alias("parts"))


def needed_materials(axes: Sequence[Axis], materials: Iterable[Material], forced: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Static materials that a request carries, numbers and flags first, categories second: forced ones and all leaves of published axes."""
    known = {m.name: m for m in materials}
    wanted = set(forced).union(*(leaves(a.name, axes) for a in axes if a.published))
    kept = [m for n, m in known.items() if n in wanted and not m.dynamic]
    return [m.name for m in kept if m.dtype != "categorical"], [m.name for m in kept if m.dtype == "categorical"]


def leaves(name: str, axes: Sequence[Axis]) -> set[str]:
    """The materials that an axis reads, through other axes too."""
    by_name = {a.name: a for a in axes}
    return set().union(*(leaves(n, axes) if n in by_name else {n} for n in by_name[name].reads()))


def leaf_shares(name: str, axes: Sequence[Axis]) -> dict[str, float]:
    """The share of each leaf material in an axis by the size of its terms' weights; shares add up to one."""
    by_name = {a.name: a for a in axes}
    shape = by_name[name].shape
    parts = {t.material: abs(t.weight) for t in shape.terms} if isinstance(shape, Linear) else {shape.material: 1.0}
    total = sum(parts.values())
    out: dict[str, float] = {}
    for material, weight in parts.items():
        inner = leaf_shares(material, axes) if material in by_name else {material: 1.0}
        for leaf, share in inner.items():
            out[leaf] = out.get(leaf, 0.0) + (share * weight / total if total else 0.0)
    return out


def raw_unit(axis: Axis, materials: Iterable[Material]) -> str | None:
    """The unit of an axis' raw value: that of its only term, if weighted one and additive."""
    known = {m.name: m for m in materials}
    if isinstance(axis.shape, Linear) and len(axis.shape.terms) == 1 and axis.shape.terms[0].weight == 1:
        found = known.get(axis.shape.terms[0].material)
        return found.unit if found and found.additive else None
    return None


def averages_density(axis: Axis, materials: Iterable[Material]) -> bool:
    """Whether an axis is averaged before it is scored: a linear sum of additive materials, without overrides."""
    known = {m.name: m for m in materials}
    return isinstance(axis.shape, Linear) and not axis.overrides and all(t.material in known and known[t.material].additive for t in axis.shape.terms)


def dependents(moving: Iterable[str], axes: Sequence[Axis]) -> list[Axis]:
    """The axes to evaluate again when some materials change, in order."""
    changed, out = set(moving), []
    for axis in ordered(axes):
        if changed & set(axis.reads()):
            changed.add(axis.name)
            out.append(axis)
    return out


def evaluate(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """``df`` with a column for each axis; axes that read no other new axis share one projection."""
    todo = ordered(axes)
    while todo:
        waiting = {a.name for a in todo}
        ready = [a for a in todo if not waiting & set(a.reads())]
        df = df.withColumns({a.name: a.column() for a in ready})
        todo = [a for a in todo if a not in ready]
    return df


def preference(axes: Sequence[Axis], chosen: Mapping[str, float] | None = None) -> dict[str, float]:
    """Weights of the published axes in their order, defaults where nothing was chosen."""
    chosen = dict(chosen or {})
    known = {a.name: a.weight for a in axes if a.published}
    if unknown := chosen.keys() - known.keys():
        raise AxisError(f"unknown axes: {sorted(unknown)}")
    if bad := [n for n, w in chosen.items() if not math.isfinite(w) or w < 0]:
        raise AxisError(f"weights from zero up: {bad}")
    return {name: chosen.get(name, weight) for name, weight in known.items()}


def weight_columns(axes: Sequence[Axis], weights: Mapping[str, float], night: Column | None = None) -> dict[str, Column]:
    """Weights as columns; a night axis weighs nothing by day."""
    scoped = {a.name for a in axes if a.night_only}
    return {n: F.when(night, w).otherwise(0.0) if n in scoped and night is not None else F.lit(float(w)) for n, w in weights.items()}


def weight_sum(weights: Mapping[str, Column]) -> Column:
    return compensated_sum([F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in weights.items()])


def composite(weights: Mapping[str, Column], rounded: bool = True) -> Column:
    """The weighted mean of the axes that have a value; null if their weights add up to nothing."""
    scores = compensated_sum([F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in weights.items()])
    total = weight_sum(weights)
    value = F.when(total != 0, scores / total)
    return round_tenth(value) if rounded else value


def contributions(weights: Mapping[str, Column]) -> Column:
    """Each present axis' part of the composite as a map; an absent axis has no key."""
    total = weight_sum(weights)
    items = F.array(*[F.struct(F.lit(n).alias("axis"), F.when(total != 0, F.col(n) * w / total).alias("part")) for n, w in weights.items()])
    return F.map_from_entries(F.filter(items, lambda x: x["part"].isNotNull()))


def travel_cost(df: DataFrame, difficulty: str, distance: str, penalty: float, seconds: Column | None = None) -> DataFrame:
    """``df`` with ``cost``: seconds of travel times ``1 + penalty * difficulty / 100``; a missing difficulty counts as the distance-weighted mean."""
    has = F.col(difficulty).isNotNull()
    mean = df.agg(F.try_divide(F.sum(F.when(has, F.col(difficulty) * F.col(distance))), F.sum(F.when(has, F.col(distance)))).alias("_mean"))
    base = F.col(distance) if seconds is None else seconds
    filled = df.crossJoin(F.broadcast(mean))  # one row
    return filled.withColumn("cost", base * (1 + penalty * F.coalesce(F.col(difficulty), F.col("_mean"), F.lit(0.0)) / 100)).drop("_mean")


def difficulty_of_cost(cost: Column, base: Column, penalty: float) -> Column:
    """The inverse of ``travel_cost``; null without penalty or length."""
    return F.when((base > 0) & F.lit(penalty > 0), (cost / base - 1) * 100 / penalty) if penalty else F.lit(None).cast("double")


def band_thresholds(axis: Axis) -> list[float]:
    """Where a map changes colour: knots of a line, middles between neighbouring category scores, sums of flags."""
    shape = axis.shape
    if axis.overrides:
        raise AxisError("an axis with overrides has no bands")
    if isinstance(shape, Categorical):
        scores = sorted(set(shape.mapping.values()))
        return [(a + b) / 2 for a, b in zip(scores, scores[1:], strict=False)]
    knots = sorted(x for x, _ in shape.points)
    return sorted({s * x for x in knots for s in ((-1, 1) if shape.absolute and len(shape.terms) == 1 else (1,))})
