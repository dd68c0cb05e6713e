"""Integer vectors as bytes: read from arrays of floats, compared by value, and read back as matrices.

A vector's entries are ``floor(256 * c)`` of its components as doubles, limited to 64 bits.  Its bytes are a width (2 or
8), then its entries in that width without the zeros at its end: equal vectors have equal bytes, and a vector that is
shorter than others counts as continued by zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.frames import importable, quoted
from tarmac.storage import measured

_LIMIT = 2.0**63 - 1024  # the largest double below 2^63


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector is whole (not null, no null or non-finite entry), their lengths, and their entries padded to a matrix."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = pc.list_flatten(column), pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(column), bool)
    bad[row[~np.isfinite(values)]] = True
    whole = np.flatnonzero(~bad & column.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), int(size.max(initial=0))), np.int64)
    at = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, at] = np.clip(np.nan_to_num(np.floor(256.0 * values)), -_LIMIT, _LIMIT).astype(np.int64)
    return whole, size[whole], out[whole]


def to_bytes(matrix: np.ndarray) -> list[bytes]:
    wide = (np.abs(matrix) > 32767).any(axis=1)
    ends = matrix.shape[1] - np.argmax((matrix != 0)[:, ::-1], axis=1) if matrix.shape[1] else np.zeros(len(matrix), int)
    ends = np.where((matrix != 0).any(axis=1), ends, 0)
    small, large = matrix.astype("<i2"), matrix.astype("<i8")
    return [b"\x08" + large[i, :e].tobytes() if w else b"\x02" + small[i, :e].tobytes() for i, (w, e) in enumerate(zip(wide, ends, strict=True))]


def from_bytes(column: pa.Array, dims: int) -> np.ndarray:
    """A matrix of ``dims`` columns, 64-bit integers."""
    rows = column.to_pylist()
    full = 1 + 2 * dims
    if dims and all(len(r) == full and r[0] == 2 for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), full)[:, 1:].copy().view("<i2").astype(np.int64)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        own = np.frombuffer(r, "<i2" if r[0] == 2 else "<i8", offset=1)
        out[i, : len(own)] = own
    return out


def packed(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """Rows with whole vectors: the columns ``keep`` (as ``k0``, ``k1``, ...), ``vec`` (bytes), ``dims``, ``top`` (largest size of an entry), ``square`` (its square length)."""
    importable(df.sparkSession)
    source = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(vector).cast("array<double>").alias("v"))
    schema = T.StructType([*source.schema[: len(keep)], T.StructField("vec", T.BinaryType()), T.StructField("dims", T.IntegerType()), T.StructField("top", T.LongType()), T.StructField("square", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                rows, size, matrix = integers(part.column(len(keep)))
                kept = part.take(pa.array(rows))
                top = np.abs(matrix).max(axis=1, initial=0)
                new = [pa.array(to_bytes(matrix), pa.binary()), pa.array(size, pa.int32()), pa.array(top, pa.int64()), pa.array((matrix.astype(np.float64) ** 2).sum(axis=1), pa.float64())]
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(keep)], *new], names=schema.names)

    return source.mapInArrow(run, schema)


def measured_rows(df: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, int, int, int]:
    """``packed`` rows, stored; their number, the dimensions of the longest and the largest size of an entry."""
    rows, seen = measured(packed(df, vector, keep), n=F.count(F.lit(1)), dims=F.max("dims"), top=F.max("top"))
    return rows, seen["n"] or 0, seen["dims"] or 0, seen["top"] or 0
