"""Language identification by bit-sliced Bloom filters over character trigrams.

Training counts letter trigrams (lower case, word edges included) of each language.  A language contains a trigram if
it occurs there at least ``min_count`` times and with at least ``share`` of its highest relative frequency in any
language.  All languages' Bloom filters share one table of bit masks, a word for every 63 languages: a trigram sets its
languages' bits in ``hashes`` slots, and the conjunction of its slots returns all languages containing it.  A text counts
the trigrams of each language, corrected for that filter's false positive rate; the highest count decides (ties: the
first name), and its share of the text's trigrams is the score.

The table has ``2 ** bits`` slots, sixteen for each trigram up to ``max_bits`` (128 MB a word; a million trigrams).  Beyond
that filters fill and false positives grow, which the correction takes back on average.  Null text and text without a
letter are ``und`` with score 0, as is everything if no language has been learned.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.chars import code_points
from tarmac.llm.frames import add_columns, emit_rows, quoted, stored
from tarmac.llm.words import mix, slices


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One trigram for each letter, in the middle of its neighbours (other characters count as an edge); and text bounds."""
    points, rows = code_points(texts, " ", lower=True)
    letters = np.append(np.where(_letters()[points], points, 0).astype(np.uint64), np.uint64(0))
    middle = np.flatnonzero(letters)
    grams = letters[middle - 1] << np.uint64(42) | letters[middle] << np.uint64(21) | letters[middle + 1]
    return grams, np.searchsorted(middle, rows)


def _slots(grams: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    first = mix(grams)
    second = mix(first) | np.uint64(1)
    return [(first + np.uint64(i) * second) >> np.uint64(64 - bits) for i in range(hashes)]


_WORD = 63  #: Languages in a mask word: a Spark long without its sign.


class Filters:
    """The learned languages, their mask words by slot (a row a word), and each filter's false positive rate."""

    def __init__(self, languages: list[str], masks: np.ndarray, hashes: int) -> None:
        self.languages, self.masks, self.hashes = languages, masks, hashes
        self.bits = masks.shape[1].bit_length() - 1
        kind = masks.dtype.type
        self.rates = np.array([float(((masks[i // _WORD] >> kind(i % _WORD)) & kind(1)).mean()) ** hashes for i in range(len(languages))])

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """The mask words of the languages that contain each trigram."""
        slots = _slots(grams, self.bits, self.hashes)
        found = self.masks[:, slots[0]]
        for slot in slots[1:]:
            found &= self.masks[:, slot]
        return found

    def decide(self, grams: np.ndarray, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        total = np.diff(rows)
        if not self.languages:
            return ["und"] * len(total), np.zeros(len(total))
        found, kind = self.containing(grams), self.masks.dtype.type
        each = (found[i // _WORD] >> kind(i % _WORD) & kind(1) for i in range(len(self.languages)))
        counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[rows]) for hit in each])
        true = np.clip((counts - total * self.rates[:, None]) / np.maximum(1 - self.rates[:, None], 1e-9), 0, None)
        best = true.argmax(axis=0)
        score = np.divide(true[best, np.arange(len(total))], total, out=np.zeros(len(total)), where=total > 0)
        return [self.languages[b] if n else "und" for b, n in zip(best, total, strict=True)], np.minimum(score, 1.0)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = 0.25, min_count: int = 2, hashes: int = 3, max_bits: int = 24) -> Filters:
    """Filters of all languages of ``docs``; rows without a language teach nothing."""
    own = docs.where(quoted(lang).isNotNull()).select(quoted(lang).alias("lang"), quoted(text).alias("_text"))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "_text", 16 << 20):
                grams, rows = trigrams(part.column("_text"))
                names, which = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                each = np.repeat(which, np.diff(rows))
                order = np.lexsort((grams, each))
                grams, each = grams[order], each[order]
                first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (each[1:] != each[:-1]))) if len(grams) else order
                yield {"lang": pa.array(names[each[first]], pa.string()), "gram": pa.array(grams[first].view(np.int64)), "n": pa.array(np.diff(np.append(first, len(grams))))}

    counts = emit_rows(own, count, {"lang": T.StringType(), "gram": T.LongType(), "n": T.LongType()})
    counts = stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}  # one row a language
    if not totals:
        return Filters([], np.zeros((1, 1), np.uint8), hashes)
    words = [f"m{w}" for w in range(-(-len(totals) // _WORD))]
    own = docs.sparkSession.createDataFrame([(name, i // _WORD, 1 << i % _WORD, float(n)) for i, (name, n) in enumerate(totals.items())], "lang string, word int, bit long, total double")
    shares = counts.where(F.col("n") >= min_count).join(F.broadcast(own), "lang").select("gram", "word", "bit", (F.col("n") / F.col("total")).alias("p"))
    top = F.max("p").over(Window.partitionBy("gram"))  # at most a row a language
    chosen = shares.withColumn("top", top).where(F.col("p") >= share * F.col("top"))
    masks = stored(chosen.groupBy("gram").agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(c) for w, c in enumerate(words)]))
    bits = min(max_bits, max(10, math.ceil(math.log2(masks.count() * 16 + 1))))

    def spread(batches):
        for batch in batches:
            grams = batch.column("gram").to_numpy().view(np.uint64)
            for slot in _slots(grams, bits, hashes):
                yield {"slot": pa.array(slot.astype(np.int64)), **{c: batch.column(c) for c in words}}

    table = emit_rows(masks, spread, {"slot": T.LongType(), **dict.fromkeys(words, T.LongType())}).groupBy("slot").agg(*[F.bit_or(c).alias(c) for c in words]).toArrow()
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= min(len(totals), _WORD))
    filled = np.zeros((len(words), 1 << bits), kind)
    for row, c in zip(filled, words, strict=True):
        row[table.column("slot").to_numpy()] = table.column(c).to_numpy().astype(kind)
    return Filters(list(totals), filled, hashes)


def predict(docs: DataFrame, filters: Filters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        names, score = shipped.value.decide(*trigrams(part.column("_text")))
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score)}

    return add_columns(docs, run, {"lang_pred": T.StringType(), "score": T.DoubleType()}, text, keep)
