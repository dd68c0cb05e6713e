"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are the queries and documents the domain.  Items are partitioned by the size of their shingle set (powers
of two).  An item's sketch holds its smallest shingle hashes (a bottom-k MinHash); a partition whose items have at
most ``u`` shingles keeps ``floor((1 - threshold) * u) + 1`` of them.  A document that contains the share ``threshold``
of an item misses fewer shingles than that, so it has at least one hash of the sketch: no match is lost, and the
documents, however long, need no sketches of their own.  Candidates are verified on the words of the shingles.

Words are split at ASCII white space and lower-cased A-Z.  An item of fewer than ``shingle`` words is one shingle, its
whole sequence.  Items without words, and null texts, match nothing.  Rows alike are each searched and found alike.

Items are dealt out in shards of at most about ``shard`` sketch hashes and ``shard_bytes`` of text.  A shard's sketches
and texts travel to the documents, one at a time with a pass over them each; candidates are verified where they are
found, so no document is shuffled and a passage in any share of all documents is no hot key.  A benchmark of a hundred
thousand items takes one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.frames import RESERVED, add_columns, emit_rows, quoted, row_key, stored
from tarmac.llm.words import FIRST, Words, slices

_HITS = RESERVED + "hits"


def _sketches(items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``(item_row, size, hash)``: for each item its shingle length in words and the hashes of its sketch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"), lower=True)
                hashes = FIRST.words(words.data, words.starts, words.ends)
                rows, sizes, out = [], [], []
                for i, n in enumerate(words.counts().tolist()):
                    if n:
                        k = min(shingle, n)
                        found = np.unique(FIRST.windows(hashes, words.first[i] + np.arange(n - k + 1), k))
                        bound = 1 << int(len(found) - 1).bit_length()
                        sketch = found[: int((1 - threshold) * bound + 1e-9) + 1]
                        rows += [part.column("item_row")[i].as_py()] * len(sketch)
                        sizes += [k] * len(sketch)
                        out.append(sketch)
                yield {"item_row": pa.array(rows, pa.binary()), "size": pa.array(sizes, pa.int32()), "hash": pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))}

    return emit_rows(items.select("item_row", F.col("item_text").alias("_text")), run, {"item_row": T.BinaryType(), "size": T.IntegerType(), "hash": T.LongType()})


def shingles(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Shard:
    """Items with their sketches: for each shingle length the sorted hashes and the item of each."""

    def __init__(self, ids: list, texts: list[str], item: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, threshold: float, shingle: int) -> None:
        self.ids, self.texts, self.threshold, self.shingle = ids, texts, threshold, shingle
        self.index = {}
        for size in np.unique(sizes).tolist():
            own = sizes == size
            order = np.argsort(hashes[own], kind="stable")
            known = hashes[own][order]
            bits = np.zeros(1 << 20, bool)
            bits[known >> np.uint64(44)] = True
            self.index[size] = known, item[own][order], bits

    @lru_cache(10_000)  # noqa: B019 - one shard a worker
    def wanted(self, item: int) -> tuple[int, frozenset[bytes]]:
        words = self.texts[item].encode().lower().split()
        size = min(self.shingle, len(words))
        return size, frozenset(shingles(words, size))

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs of a text and an item of whose sketch it has a hash."""
        hashes = FIRST.words(words.data, words.starts, words.ends)
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (known, item, bits) in self.index.items():
            starts, row = words.window_starts(size)
            own = FIRST.windows(hashes, starts, size)
            maybe = np.flatnonzero(bits[own >> np.uint64(44)])
            low, high = np.searchsorted(known, own[maybe]), np.searchsorted(known, own[maybe], "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append(np.repeat(row[maybe], n))
            items.append(item[at])
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return pairs[0], pairs[1]

    def verified(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, n_shingles, n_shared)`` of each text that contains an item."""
        words = Words(texts, lower=True)
        last, own = -1, {}
        for row, item in zip(*(x.tolist() for x in self.candidates(words)), strict=True):
            if row != last:
                last, own = row, {}
            size, wanted = self.wanted(item)
            if size not in own:
                own[size] = shingles(words.bytes[words.rows[row] : words.rows[row + 1]].split(), size)
            shared = len(wanted & own[size])
            if shared >= self.threshold * len(wanted) - 1e-9:
                yield row, item, len(wanted), shared


def _shards(items: DataFrame, threshold: float, shingle: int, item_id: str, item_text: str, shard: int, shard_bytes: int) -> Iterator[Broadcast]:
    """Each shard, sent to the executors."""
    items = stored(items.select(quoted(item_id).alias("item_id"), quoted(item_text).alias("item_text"), row_key(item_id, item_text).alias("item_row")).where("item_text is not null").distinct())
    sketches = stored(_sketches(items, threshold, shingle))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes")).first()
    n = max(-(-sketches.count() // shard), -(-size["bytes"] // shard_bytes))
    for at in range(n):
        mine = F.pmod(F.xxhash64("item_row"), F.lit(n)) == at
        texts, found = items.where(mine).toArrow(), sketches.where(mine).toArrow()
        place = {key: i for i, key in enumerate(texts.column("item_row").to_pylist())}
        item = np.array([place[key] for key in found.column("item_row").to_pylist()], np.int64)
        own = Shard(texts.column("item_id").to_pylist(), texts.column("item_text").to_pylist(), item, found.column("size").to_numpy(), found.column("hash").to_numpy().view(np.uint64), threshold, shingle)
        yield items.sparkSession.sparkContext.broadcast(own)


def matches(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard: int = 4_000_000,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for each document that contains an item.

    ``n_shingles`` counts an item's different shingles, ``n_shared`` those in the document.
    """
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("_text"))
    fields = {"doc_id": source.schema["doc_id"].dataType, "item_id": items.schema[item_id].dataType, "n_shingles": T.LongType(), "n_shared": T.LongType(), "containment": T.DoubleType()}
    found = []
    for shipped in _shards(items, threshold, shingle, item_id, item_text, shard, shard_bytes):

        def search(batches, shipped=shipped):
            for batch in batches:
                for part in slices(batch, "_text"):
                    hits = list(shipped.value.verified(part.column("_text")))
                    if hits:
                        row, item, n, shared = zip(*hits, strict=True)
                        yield {
                            "doc_id": part.column("doc_id").take(pa.array(row)), "item_id": pa.array([shipped.value.ids[i] for i in item]), "n_shingles": pa.array(n), "n_shared": pa.array(shared),
                            "containment": pa.array([s / k for s, k in zip(shared, n, strict=True)]),
                        }

        found.append(emit_rows(source, search, fields))
    if not found:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(k, v) for k, v in fields.items()]))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = 0.8, shingle: int = 5, item_id: str = "item_id", item_text: str = "text", shard: int = 4_000_000, shard_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without those that contain an item."""
    names = docs.columns
    for shipped in _shards(items, threshold, shingle, item_id, item_text, shard, shard_bytes):

        def flag(part: pa.RecordBatch, shipped=shipped) -> dict[str, pa.Array]:
            hits = np.zeros(len(part), bool)
            hits[[row for row, *_ in shipped.value.verified(part.column("_text"))]] = True
            return {_HITS: pa.array(hits)}

        docs = add_columns(docs, flag, {_HITS: T.BooleanType()}, text, names).where(~F.col(_HITS)).drop(_HITS)
    return docs
