"""Removal of repeated word windows behind a count-min prefilter.

First pass: every partition sketches its windows and the partition sketches are merged into one, whose counts are
never too low.  A window is counted through its smallest shingle (of ``shingle`` words): equal windows share it at
different places, so the shingle's count bounds the window's, while only about one place in fourteen is counted.
Second pass: only windows estimated to occur twice or more are grouped, by 128-bit hashes of their words.  A group of
one is a false alarm of the sketch; those few are sent back to their documents, and all other candidates are repeated.

Grouping has map-side combining and keeps a count and one locator for each window, so a passage in any share of all
rows is no hot spot.  The merged sketch is kept as bits ("two or more"), ``2 ** bits / 4`` bytes: sized by the input up
to ``2 ** max_bits`` counters a row (64 MB for 28).  Beyond that it only passes more windows to the exact grouping.

Null and empty texts have no words.  Rows alike in id and text repeat one another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.frames import RESERVED, ROW, add_columns, emit_rows, quoted, row_keys, stored
from tarmac.llm.words import FIRST, SECOND, Words, mix, slices

_ALONE = RESERVED + "alone"
_OTHER = ROW + "2"
_DEPTH = 2
#: Shingles that a task keeps before it passes on what it has counted.
_HELD = 4_000_000
_LOW = 16


def _slide(f, values: np.ndarray, k: int) -> np.ndarray:
    """``f`` (minimum or maximum) over each run of ``k`` values."""
    span = 1
    while span * 2 <= k:
        values = f(values[:-span], values[span:])
        span *= 2
    return f(values[: len(values) - (k - span)], values[k - span :]) if k > span else values


class Windows:
    """The windows of a slice of texts: first words, texts, smallest shingles, and the shingles that are one."""

    def __init__(self, texts: pa.Array, size: int, shingle: int) -> None:
        self.words = words = Words(texts)
        self.starts, self.row = words.window_starts(size)
        self.hashes = FIRST.words(words.data, words.starts, words.ends)
        if not len(self.starts):
            self.least = self.shingles = np.zeros(0, np.uint64)
            return
        reach = size - shingle + 1
        each = FIRST.windows(self.hashes, np.arange(len(words) - shingle + 1), shingle)
        self.least = _slide(np.minimum, each, reach)[self.starts]
        held = np.zeros(len(each) + reach - 1, np.uint64)
        held[self.starts + reach - 1] = self.least
        self.shingles = each[(_slide(np.maximum, held, reach) == each) & (each > 0)]


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [mix(hashes + np.uint64(d * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> shift for d in range(_DEPTH)]


def sketch(docs: DataFrame, text: str, size: int, shingle: int, bits: int) -> np.ndarray:
    """The merged count-min sketch as bits, one row of ``2 ** bits`` for each hash: set where the count is 2 or more."""

    def packed(parts: list[np.ndarray]) -> dict[str, pa.Array]:
        slots, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        block = slots >> np.uint64(_LOW)
        at = np.flatnonzero(np.diff(block, prepend=np.uint64(2**63)))
        body = lambda s, c, keep: s[keep(c)].astype(np.uint16).tobytes()
        ends = [*at[1:], len(slots)]
        return {
            "block": pa.array(block[at].astype(np.int32)),
            "once": pa.array([body(slots[s:e], counts[s:e], lambda c: c == 1) for s, e in zip(at, ends, strict=False)], pa.binary()),
            "more": pa.array([body(slots[s:e], counts[s:e], lambda c: c > 1) for s, e in zip(at, ends, strict=False)], pa.binary()),
        }

    def partial(batches):
        parts, held = [], 0
        for batch in batches:
            for piece in slices(batch, "_text"):
                found = Windows(piece.column("_text"), size, shingle).shingles
                parts += [slot + np.uint64(d << bits) for d, slot in enumerate(_slots(found, bits))]
                held += len(found)
                if held > _HELD:  # memory does not follow the partition's size
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    def merged(batches):
        current, counts = -1, np.zeros(1 << _LOW, np.uint8)
        pack = lambda: {"block": pa.array([current], pa.int32()), "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())}
        for batch in batches:
            for block, once, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "more")), strict=True):
                if block != current:
                    if current >= 0:
                        yield pack()
                    current, counts = block, np.zeros(1 << _LOW, np.uint8)
                single = np.frombuffer(once, np.uint16)
                counts[single] = np.minimum(counts[single] + 1, 2)
                counts[np.frombuffer(more, np.uint16)] = 2
        if current >= 0:
            yield pack()

    parts = emit_rows(docs.select(quoted(text).alias("_text")), partial, {"block": T.IntegerType(), "once": T.BinaryType(), "more": T.BinaryType()})
    parts = parts.repartition("block").sortWithinPartitions("block")
    out = np.zeros((_DEPTH << bits) // 8, np.uint8)
    for row in emit_rows(parts, merged, {"block": T.IntegerType(), "bits": T.BinaryType()}).toLocalIterator():
        out[row.block << _LOW - 3 : row.block + 1 << _LOW - 3] = np.frombuffer(row.bits, np.uint8)
    return out


def _estimated_repeated(least: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(least), bool)
    for d, slot in enumerate(_slots(least, bits)):
        slot = slot + np.uint64(d << bits)
        found &= (bitmap[slot >> np.uint64(3)] << (slot & np.uint64(7)).astype(np.uint8) & 128) > 0
    return found


def remove_repeats(
    docs: DataFrame, size: int = 35, shingle: int = 8, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, bits: int | None = None, max_bits: int = 28
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words outside repeated windows joined by spaces."""
    if not 1 <= shingle <= size:
        raise ValueError("a shingle has at least one word and fits in a window")
    spark = docs.sparkSession
    first, second = row_keys(doc_id, text)
    keyed = docs.withColumns({ROW: first, _OTHER: second})
    if bits is None:
        total = docs.agg(F.sum(F.octet_length(quoted(text))).alias("n")).first().n or 0
        bits = min(max_bits, max(20, math.ceil(math.log2(total / 10 + 1))))
    bitmap = spark.sparkContext.broadcast(sketch(docs, text, size, shingle, bits))

    def candidates(batches):
        for batch in batches:
            for piece in slices(batch, "_text"):
                found = Windows(piece.column("_text"), size, shingle)
                hit = np.flatnonzero(_estimated_repeated(found.least, bitmap.value, bits))
                words, starts, row = found.words, found.starts[hit], found.row[hit]
                other = SECOND.words(words.data, words.starts, words.ends)
                yield {
                    "h1": pa.array(FIRST.windows(found.hashes, starts, size).view(np.int64)),
                    "h2": pa.array(SECOND.windows(other, starts, size).view(np.int64)),
                    "k1": pa.array(piece.column("k1").to_numpy()[row]),
                    "k2": pa.array(piece.column("k2").to_numpy()[row]),
                    "at": pa.array((starts - words.first[row]).astype(np.int32)),
                }

    fields = {"h1": T.LongType(), "h2": T.LongType(), "k1": T.LongType(), "k2": T.LongType(), "at": T.IntegerType()}
    rows = emit_rows(keyed.select(F.col(ROW).alias("k1"), F.col(_OTHER).alias("k2"), quoted(text).alias("_text")), candidates, fields)
    single = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "k2", "at")]).where("n = 1")
    single = stored(single.groupBy(F.col("k1").alias(ROW), F.col("k2").alias(_OTHER)).agg(F.collect_list("at").alias(_ALONE)))
    if (single.agg(F.sum(F.size(_ALONE) + 1).alias("n")).first().n or 0) <= 1_000_000:  # some 10 MB
        single = F.broadcast(single)
    marked = keyed.drop(_ALONE).join(single, [ROW, _OTHER], "left")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "n_removed", "kept_text")]

    def cut(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = Windows(part.column("_text"), size, shingle)
        words = found.words
        repeated = _estimated_repeated(found.least, bitmap.value, bits)
        alone = part.column(part.schema.names.index("_text") - 1)
        lengths = alone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        window = np.cumsum(np.bincount(found.row, minlength=len(part))) - np.bincount(found.row, minlength=len(part))
        repeated[np.repeat(window, lengths) + alone.flatten().to_numpy(zero_copy_only=False)] = False
        starts = found.starts[repeated]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + size, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        kept = []
        for i in range(len(part)):
            own = words.bytes[words.rows[i] : words.rows[i + 1]].split()
            if removed[i]:
                own = [own[j] for j in np.flatnonzero(~gone[words.first[i] : words.first[i + 1]]).tolist()]
            kept.append(b" ".join(own).decode())
        return {"n_words": pa.array(words.counts()), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.string())}

    fields = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType()}
    return add_columns(marked, cut, fields, text, [*names, _ALONE]).drop(_ALONE)
