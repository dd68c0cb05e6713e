"""Code points of text slices, and exact look-ups of 64-bit keys, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def code_points(texts: pa.Array, before: str, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each led by ``before``; and the bounds of each text in them, ``before`` included."""
    own = [before + ((t.lower() if lower else t) if t else "") for t in texts.to_pylist()]
    joined = "".join(own)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in own], dtype=np.int64)])


class KeyTable:
    """Positions of different 64-bit keys, in a hash table of short buckets."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[self.order], np.uint64(0))
        self.first = np.searchsorted(slot[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.order = np.append(self.order, -1).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key among those given at first, or -1."""
        slot = self._slot(keys).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.where((at < end) & (self.keys[at] == keys), self.order[at], -1)
        todo = np.flatnonzero((out < 0) & (at + 1 < end))
        step = 1
        while len(todo):
            here = at[todo] + step
            hit = self.keys[here] == keys[todo]
            out[todo[hit]] = self.order[here[hit]]
            step += 1
            todo = todo[~hit & (here + 1 < end[todo])]
        return out
