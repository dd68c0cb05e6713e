"""Words, windows and their hashes over Arrow text batches, vectorised with numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  A span's hash is a polynomial over its
byte (or word) values modulo 2**64, shifted to position zero and mixed, so equal spans hash alike wherever they
stand.  Tables of powers grow with the longest batch seen by a worker and are kept between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about this many bytes (one long text may exceed it).
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts hold about ``limit`` bytes each."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Span hashes under one odd base; two instances with different seeds give 128 bits."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
        self.base = int(rng.integers(0, 2**61)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``values[s:e]`` for each span."""
        self._powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.spans(self.bytes[data], starts, ends)

    def windows(self, word_hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        return self.spans(word_hashes, starts, starts + size)


FIRST, SECOND = Rolling(1), Rolling(2)


class Words:
    """Word boundaries of a slice of texts.

    ``data`` holds the bytes of all texts with a newline after each; ``starts``/``ends`` bound the words in it and
    ``first[i]:first[i + 1]`` are the words of text ``i``.  A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        raw = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = b"\n".join(raw.cast(pa.large_binary()).to_pylist()) + b"\n" if len(raw) else b""
        self.bytes = joined.lower() if lower else joined
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.rows = np.concatenate([[0], np.cumsum(sizes + 1)])
        white = _WHITE[self.data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(white) and not white[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.rows)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def window_starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words that lie in one text, and the text of each."""
        n = np.maximum(self.counts() - size + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[row], row

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]]
