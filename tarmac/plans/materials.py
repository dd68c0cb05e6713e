"""Materials by name, read from value tables that are joined only if a wanted material needs them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ValueTable:
    """A table with at most one row for each key; an absent row means no value."""

    frame: DataFrame
    keys: tuple[str, ...]


@dataclass
class Catalog:
    """Which columns a material reads and from which table; ``base`` columns need no join."""

    tables: Mapping[str, ValueTable] = field(default_factory=dict)
    materials: dict[str, tuple[str | None, Column]] = field(default_factory=dict)

    def add(self, name: str, column: Column, table: str | None = None) -> None:
        if name in self.materials:
            raise ValueError(f"{name} is there already")
        if table is not None and table not in self.tables:
            raise ValueError(f"no table {table}")
        self.materials[name] = (table, column)

    def read(self, base: DataFrame, names: Iterable[str]) -> DataFrame:
        """``base`` with the wanted materials; tables that none of them reads are not joined."""
        names = list(dict.fromkeys(names))
        if unknown := [n for n in names if n not in self.materials]:
            raise ValueError(f"unknown materials: {unknown}")
        out = base
        for table in dict.fromkeys(self.materials[n][0] for n in names if self.materials[n][0]):
            value = self.tables[table]
            fields = [c for c in value.frame.columns if c not in value.keys]
            own = value.frame.select(*value.keys, F.struct(*fields).alias(table))
            out = out.join(own, list(value.keys), "left")
        return out.select(*base.columns, *[self.materials[n][1].alias(n) for n in names])


def coverage(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row for each column: rows, rows with a value, and the missing share; one scan for all."""
    columns = list(columns)
    counts = df.agg(F.count("*").alias("_total"), *[F.count(F.col(c)).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("material"), F.col(c).alias("present")) for i, c in enumerate(columns)]))
    out = counts.select("_total", rows.alias("r")).select("r.*", F.col("_total").alias("total"))
    return out.withColumn("missing_ratio", F.when(F.col("total") > 0, 1 - F.col("present") / F.col("total")))


def exclusion(filters: Mapping[str, Column], enabled: Mapping[str, bool], gradient: Column | None = None, max_gradient: float | None = None) -> Column:
    """Whether any enabled hard filter excludes a row; an unknown gradient excludes nothing."""
    if filters.keys() != enabled.keys():
        raise ValueError(f"filters and switches differ: {sorted(filters.keys() ^ enabled.keys())}")
    out = F.lit(False)
    for name, column in filters.items():
        if enabled[name]:
            out = out | F.coalesce(column, F.lit(False))
    if gradient is not None and max_gradient is not None:
        out = out | F.coalesce(F.abs(gradient) > max_gradient, F.lit(False))
    return out
