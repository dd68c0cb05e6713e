"""Small Spark helpers shared by the operators: column-adding Arrow passes, row keys and shared storage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.llm.words import slices
from tarmac.storage import shared_dir, stored

__all__ = ["RESERVED", "ROW", "add_columns", "emit_rows", "importable", "quoted", "row_key", "row_keys", "shared_dir", "stored", "table"]


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, unless they have it installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


#: Column names that begin like this belong to the operators; an input column of such a name may be replaced.
RESERVED = "_tarmac_"
ROW = RESERVED + "row"


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two 64-bit keys of a row, 128 bits together: rows alike in id and text share them, and share every result that is joined by them."""
    parts = [x for c in (quoted(doc_id), quoted(text)) for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def row_key(doc_id: str, text: str) -> Column:
    """Both keys of a row as one binary value."""
    return F.unhex(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in row_keys(doc_id, text)]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: dict[str, T.DataType],
    text: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with the columns that ``fn`` derives from slices of its rows (about 1 MB of text each).

    ``keep`` names the input columns that stay (all by default); a kept column named like a new one is replaced.
    """
    importable(df.sparkSession)
    taken = {name.lower() for name in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(keep)], quoted(text).alias("_text"))
    kept = source.schema[: len(keep)] if keep else T.StructType([])
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *(T.StructField(k, v) for k, v in fields.items())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                new = fn(part)
                columns = [*part.columns[: len(keep)], *(new[k] for k in fields)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    out = source.mapInArrow(run, schema)
    return out.select(*[quoted(f"_k{i}").alias(c) for i, c in enumerate(keep)], *fields)


def emit_rows(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, pa.Array]]],
    fields: dict[str, T.DataType],
) -> DataFrame:
    """Rows that ``fn`` makes from a partition's batches; it yields columns by name."""
    importable(df.sparkSession)
    schema = T.StructType([T.StructField(k, v) for k, v in fields.items()])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name]).cast(f.type) if not isinstance(new[f.name], pa.Array) else new[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
