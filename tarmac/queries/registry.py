"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.oracles[query.__name__] = sql
            return query

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_tenth(x: str) -> str:
    """SQL that rounds a double of up to 2^60 in size to a tenth by its exact binary value, half to even."""
    unit = 1 << 60
    ten = f"(10 * CAST(abs({x}) * {unit}.0 AS HUGEINT))"
    tie = f"{ten} % {unit} = {unit // 2} AND ({ten} // {unit}) % 2 = 0"
    return f"(sign({x}) * CAST(({ten} + {unit // 2}) // {unit} - CASE WHEN {tie} THEN 1 ELSE 0 END AS DOUBLE) / 10)"
