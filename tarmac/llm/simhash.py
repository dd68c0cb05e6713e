"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits.

Links are found in a byte-position inverted index with count filtering.  A fingerprint is eight positional bytes;
two that differ in at most ``bits`` (4) bits share at least ``8 - bits`` of them.  Postings are keyed by three
positional bytes: twenty triples of positions suffice for every set of four shared positions to hold one whole, so
each qualifying pair meets in some posting list.  Pairs in a list are tallied on all eight positions, those below
the guaranteed minimum go, and the rest are verified on their bits.

Copies share a fingerprint and count once.  A posting list yields a spanning set of its links, never all pairs; one
of more than ``block`` fingerprints is dealt out as pairs of blocks, so no task gets more than two blocks of a list.

Null text counts as no words; no words give fingerprint zero, linked like any other.  Rows alike in id and text are
alike in result.  A null id takes part in links and is never the smallest id of a component that has another.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.frames import ROW, add_columns, emit_rows, quoted, row_key, stored
from tarmac.llm.words import Words
from tarmac.operators.components import connected

_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def _triples() -> list[tuple[int, ...]]:
    """Position triples such that any four of eight positions contain one: all in a group, or two in it and one in the next."""
    found = [g for g in _GROUPS if len(g) == 3]
    for i, group in enumerate(_GROUPS):
        found += [(*two, one) for two in combinations(group, 2) for one in _GROUPS[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in found]


def fingerprint_of(words: list[bytes], shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one word sequence."""
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], seed) for s, e in zip(first[: len(first) - k + 1].tolist(), last[k - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a long (lower-cased A-Z, ``shingle`` words, repeats included)."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        words = Words(part.column("_text"), lower=True)
        raw, rows = words.bytes, words.rows.tolist()
        values = [fingerprint_of(raw[s:e].split(), shingle, seed) for s, e in zip(rows[:-1], rows[1:], strict=True)]
        return {"fp": pa.array(np.array(values, np.uint64).view(np.int64))}

    return add_columns(docs, run, {"fp": T.LongType()}, text, keep)


def _keys() -> list:
    unsigned = lambda at: F.shiftright(F.col("fp"), 8 * at).bitwiseAND(255)
    return [F.lit(i << 24) + unsigned(a) * 65_536 + unsigned(b) * 256 + unsigned(c) for i, (a, b, c) in enumerate(_triples())]


def spanning_links(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of a posting list as all its pairs of at most ``bits`` differing bits would."""
    values = np.unique(members)
    left = np.ones(len(values), bool)
    found = []
    for root in range(len(values)):
        if not left[root]:
            continue
        left[root] = False
        reached = [root]
        while reached and left.any():
            at = reached.pop()
            rest = np.flatnonzero(left)
            differ = values[rest] ^ values[at]
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            tallied = rest[shared >= 8 - bits]
            near = tallied[np.bitwise_count(values[tallied] ^ values[at]) <= bits]
            left[near] = False
            found += [(int(values[at]), int(values[n])) for n in near]
            reached += near.tolist()
    return found


def near_links(fps: DataFrame, bits: int = 4, block: int = 2048) -> DataFrame:
    """``(a, b)`` links that connect distinct fingerprints ``fp`` as all pairs within ``bits`` differing bits do.

    ``bits`` is at most 4: the posting keys of three bytes meet only where four bytes are shared.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bits must lie between 0 and 4")
    postings = fps.select("fp", F.explode(F.array(*_keys())).alias("key"))
    crowded = stored(postings.groupBy("key").count().where("count > 1"))
    met = postings.join(crowded, "key").select("fp", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = met.groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    def run(batches):
        for batch in batches:
            lists = batch.column("fps")
            values = lists.flatten().to_numpy().view(np.uint64)
            sizes = lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            two = ends[sizes == 2]
            a, b = values[two - 2], values[two - 1]
            enough = ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits
            a, b = a[enough], b[enough]
            near = np.bitwise_count(a ^ b) <= bits
            more = [p for e, n in zip(ends[sizes > 2], sizes[sizes > 2], strict=True) for p in spanning_links(values[e - n : e], bits)]
            more = np.array(more, np.uint64).reshape(-1, 2)
            yield {"a": pa.array(np.concatenate([a[near], more[:, 0]]).view(np.int64)), "b": pa.array(np.concatenate([b[near], more[:, 1]]).view(np.int64))}

    return emit_rows(lists.select("fps"), run, {"a": T.LongType(), "b": T.LongType()})


def components(marked: DataFrame, doc_id: str = "doc_id", bits: int = 4) -> DataFrame:
    """``marked`` (rows with ``fp``) with ``root``, a fingerprint that names the component, and ``component_id``, its smallest id."""
    fps = stored(marked.groupBy("fp").agg(F.min(quoted(doc_id)).alias("least")))
    roots = connected(near_links(fps.select("fp"), bits))
    fps = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = fps.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stored(fps.join(least, "root").select("fp", "root", "component_id"))
    rest = [quoted(c) for c in marked.columns if c.lower() not in ("fp", "root", "component_id")]
    return marked.select(*rest, "fp").join(known, "fp").select(*rest, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """One row per document: id, row key (``ROW``), ``fp``, ``root`` and ``component_id``."""
    marked = fingerprints(docs.select(quoted(doc_id), quoted(text), row_key(doc_id, text).alias(ROW)), text, [doc_id, ROW])
    return components(stored(marked), doc_id, bits)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (null last), then the smallest row key."""
    found = near_duplicates(docs, doc_id, text, bits).select(quoted(doc_id).alias("_id"), F.col(ROW).alias("_row"), "root")
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    chosen = found.groupBy("root").agg(F.min(order).alias("o"))  # an id may stand in two components, a root in one
    chosen = chosen.select(F.col("o._row").alias(ROW))
    return docs.withColumn(ROW, row_key(doc_id, text)).join(chosen, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)
