"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Entries are integers, so the scatter of the centred vectors ``n * x - S`` is a matrix of integers, too large for doubles.
Every partition multiplies the vectors' residues modulo several primes below 2^21; such products of 4,096 rows stay below
2^53, so doubles hold them exactly and BLAS may be used.  Spark sums the residues by prime and entry, and Chinese
remaindering turns the sums into the exact scatter.  Its quotient by n^3 is the covariance, rounded once an entry, of which
the driver takes the eigenvectors.  What meets on the driver is bounded by the dimensions, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm import vectors
from tarmac.llm.frames import emit_rows, importable
from tarmac.storage import measured

_BLOCK = 4096
_LONG = 2**63 - 1


def primes(above: int) -> list[int]:
    """The largest primes below 2^21, as many as have a product over ``above``."""
    found, product, at = [], 1, 2**21 - 1
    while product <= above:
        if all(at % q for q in range(3, math.isqrt(at) + 1, 2)):
            found.append(at)
            product *= at
        at -= 2
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of smallest size that has these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, column: str = "vec") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(start, _BLOCK)
            yield part, vectors.from_bytes(part.column(column), dims)


def sums(fit: DataFrame, dims: int) -> list[int]:
    """Sum of each dimension, exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(dims, object)
        for _, x in _blocks(batches, dims):
            total += (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield {"dim": np.arange(dims), "high": [int(t) >> 32 for t in total], "low": [int(t) & 0xFFFFFFFF for t in total]}

    parts = emit_rows(fit.select("vec"), partial, {"dim": T.IntegerType(), "high": T.LongType(), "low": T.LongType()})
    out = [0] * dims
    for r in parts.groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # a row a dimension
        out[r["dim"]] = r["high"] * 2**32 + r["low"]
    return out


def scatter(fit: DataFrame, dims: int, n: int, total: list[int], top: int) -> list[list[int]]:
    """Sum over the fit list of ``y y'`` for ``y = n * x - S``, exact."""
    moduli = primes(2 * n * (2 * n * max(top, 1)) ** 2)
    i, j = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = np.zeros((len(moduli), dims, dims), np.int64)
        for _, x in _blocks(batches, dims):
            for k, p in enumerate(moduli):
                y = ((n % p) * (x % p) - np.array([s % p for s in total], np.int64)) % p
                y = np.where(y > p // 2, y - p, y).astype(np.float64)
                held[k] = (held[k] + np.rint(y.T @ y).astype(np.int64)) % p
        for k in range(len(moduli)):
            yield {"k": np.full(len(i), k), "at": np.arange(len(i)), "value": held[k][i, j]}

    parts = emit_rows(fit.select("vec"), partial, {"k": T.IntegerType(), "at": T.IntegerType(), "value": T.LongType()})
    found = parts.groupBy("k", "at").agg(F.sum("value").alias("value")).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("v"))
    out = [[0] * dims for _ in range(dims)]
    for r in found.toLocalIterator():  # a row for each pair of dimensions
        a, b = int(i[r["at"]]), int(j[r["at"]])
        out[a][b] = out[b][a] = remaindered([v["value"] % p for v, p in zip(r["v"], moduli, strict=True)], moduli)
    return out


def _identity_error(fit: DataFrame, dims: int, mean: np.ndarray, turn: np.ndarray, n: int) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity, measured on the rows."""
    k = turn.shape[1]
    if not k:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, dims):
            w = (x - mean) @ turn
            first += w.sum(axis=0)
            second += w.T @ w
        yield {"at": np.arange(k + k * k), "value": np.concatenate([first, second.ravel()])}

    found = emit_rows(fit.select("vec"), partial, {"at": T.IntegerType(), "value": T.DoubleType()}).groupBy("at").agg(F.sum("value").alias("v")).collect()
    values = np.array([r["v"] for r in sorted(found, key=lambda r: r["at"])])
    centre = values[:k] / n
    return float(np.abs(values[k:].reshape(k, k) / n - np.outer(centre, centre) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, total: list[int], top: int) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S)^2``; None beyond 64 bits."""
    dims = x.shape[1]
    if dims * (2 * n * max(top, 1)) ** 2 <= _LONG:
        y = n * x - np.array(total, np.int64)
        return (y * y).sum(axis=1).tolist()
    squares = sum(s * s for s in total)
    if dims * max(top, 1) * 2**31 <= _LONG:  # parts of S, so that products fit
        high, low = np.array([s >> 31 for s in total], object), np.array([s & (2**31 - 1) for s in total], np.int64)
        dot = x @ low
        far = (x.astype(object) @ high) if max(map(abs, high), default=0) * dims * max(top, 1) > _LONG else x @ high.astype(np.int64)
        own = (x * x).sum(axis=1) if dims * top * top <= _LONG else (x.astype(object) ** 2).sum(axis=1)
        out = [n * n * int(q) - 2 * n * (int(f) * 2**31 + int(d)) + squares for q, f, d in zip(own, far, dot, strict=True)]
    else:
        out = [sum((n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist()]
    return [v if v <= _LONG else None for v in out]


def whitened(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = 4) -> DataFrame:
    """``df``'s whole vectors on their first principal components, scaled to unit variance: a row for each row and component.

    A vector that is null or holds a null or a non-finite entry is left out.  The rest become integers ``x = floor(256 * c)``.
    The fit list has each different ``x`` once, so repeated rows do not weigh; every row is whitened.  Columns: ``keep`` (all
    but the vector by default; one that is named like a new column gives way), ``component`` from 1 by falling eigenvalue,
    ``n`` (length of the fit list), ``deviation`` (sum of ``(n * x - S)^2``, exact; null if beyond 64 bits), ``whitened``,
    ``explained`` (eigenvalue / trace), ``identity_error`` (largest entry of the whitened fit list's covariance less the
    identity, one value).  Shorter vectors are continued by zeros.  A component without variance has ``whitened`` null; if
    none has any, ``identity_error`` and ``explained`` are null, too.  There are as many components as dimensions at
    most.  A tie of eigenvalues leaves the choice of axes to the decomposition; it is one choice for all rows, and the
    largest entry of each axis is positive.  An empty table, or one without whole vectors, gives no rows.
    """
    importable(df.sparkSession)
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    keep = [c for c in (df.columns if keep is None else keep) if c != vector and c.lower() not in new]
    rows, _, dims, top = vectors.measured_rows(df, vector, keep)
    fit, count = measured(rows.select("vec").distinct(), n=F.count(F.lit(1)))
    n = count["n"] or 0
    total = sums(fit, dims) if n and dims else []
    exact = scatter(fit, dims, n, total, top) if n and dims else []
    covariance = np.array([[v / n**3 for v in row] for row in exact], np.float64).reshape(dims, dims)
    values, axes = np.linalg.eigh(covariance) if dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    values, axes = values[order], axes[:, order]
    axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(len(order))]) if dims else axes
    trace = sum(exact[i][i] for i in range(dims)) / n**3 if n else 0.0
    real = values > dims * np.finfo(float).eps * values.max(initial=0.0)
    mean = np.array([s / n for s in total], np.float64)
    turn = axes[:, real] / np.sqrt(values[real])
    error = _identity_error(fit, dims, mean, turn, n) if n and dims else None
    explained = [float(v) / trace if trace else None for v in values]

    schema = T.StructType([*rows.schema[: len(keep)], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in new[3:])])
    slots, lanes = np.flatnonzero(real), len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dims):
            found = np.full((len(x), lanes), np.nan)
            found[:, slots] = (x - mean) @ turn
            deviation = np.array(_deviations(x, n, total, top), object)
            for c in range(lanes):
                fixed = [pa.array([v] * len(x), kind) for v, kind in ((c + 1, pa.int32()), (n, pa.int64()))]
                own = pa.array(found[:, c], pa.float64(), from_pandas=True)
                rest = [pa.array([v] * len(x), pa.float64()) for v in (explained[c], error)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *fixed, pa.array(deviation, pa.int64()), own, *rest], names=schema.names)

    out = rows.select(*[f"k{i}" for i in range(len(keep))], "vec").mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *new)


