"""Tuning parameters: defaults, checked overrides, and values learned from earlier requests."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameter:
    """A number with its default and its range."""

    name: str
    default: float
    low: float
    high: float

    def check(self, value: float) -> float:
        if not math.isfinite(value) or not self.low <= value <= self.high:
            raise ValueError(f"{self.name} lies between {self.low} and {self.high}: {value}")
        return float(value)


# Parameters of the search with defaults and ranges.
PARAMETERS: dict[str, Parameter] = {
    p.name: p
    for p in (
        Parameter("turn.left_seconds", 2.0, 0.0, 120.0),
        Parameter("turn.right_seconds", 12.0, 0.0, 120.0),
        Parameter("turn.uturn_seconds", 60.0, 0.0, 600.0),
        Parameter("turn.straight_max_deg", 30.0, 0.0, 90.0),
        Parameter("turn.major_crossing_seconds", 8.0, 0.0, 300.0),
        Parameter("turn.major_turn_seconds", 15.0, 0.0, 300.0),
    )
}
DETOUR = 1.3


def resolved(overrides: Mapping[str, float], parameters: Mapping[str, Parameter] = PARAMETERS) -> dict[str, float]:
    """Every parameter's value; overrides of unknown names are ignored, those out of range are an error."""
    return {name: p.check(overrides[name]) if name in overrides else p.default for name, p in parameters.items()}


def resolved_table(parameters: DataFrame, overrides: DataFrame) -> DataFrame:
    """The same over tables: ``parameters`` (``name``, ``standard``, ``low``, ``high``) and ``overrides`` (``name``, ``value``).

    ``value`` is the override where it lies in the range, else the default; ``rejected`` tells an override that does not.
    """
    both = parameters.join(overrides.select("name", F.col("value").alias("_v")), "name", "left")
    fine = F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_v").between(F.col("low"), F.col("high"))
    return both.select("name", F.when(fine, F.col("_v")).otherwise(F.col("standard")).alias("value"), (F.col("_v").isNotNull() & ~fine).alias("rejected"))


def detour(learned: Column) -> Column:
    """The learned ratio of ridden to straight distance where it is usable, else the default."""
    return F.when(learned.isNotNull() & ~F.isnan(learned) & (learned > 0) & (learned < float("inf")), learned).otherwise(F.lit(DETOUR))
