"""Quality rules whose cutoffs keep the share of wrongly rejected good documents below a bound, for each stratum.

``measure`` counts words, symbols, repeated lines and repeated word windows.  Each rule is a ratio that is worse when
higher, with a fixed series of cutoffs from lenient to strict.  Good documents of the labelled holdout test the series
in order: a cutoff passes while the exact binomial tail says that its false rejection rate exceeds ``alpha / rules``
with a p-value of at most ``delta / (rules * strata)``; the first failure ends the series (fixed sequence), and the
division over rules and strata is Bonferroni's.  With probability ``1 - delta`` no stratum then loses more than the
share ``alpha`` of its good documents to the rules.  A stratum with too few labels keeps no cutoff and rejects nothing.

Null text has no words and fails the base rules; a null stratum is one of its own; documents without a label, and
labels without a document, do not calibrate.  An id that is labelled more than once is good if all its labels are.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.frames import add_columns, quoted

_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"

#: Rule -> (value, cutoffs from lenient to strict); a document is rejected above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1)),
    "repeated_words": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeated_lines": ("n_dup_lines / n_lines", (0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "word_length": ("word_chars / n_words", (40.0, 30.0, 20.0, 15.0, 12.0, 10.0)),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts_of(text: bytes, window: int = 3) -> tuple[int, ...]:
    """The counts of one UTF-8 text, in the order of ``_COUNTS``."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        often = {g for g, n in Counter(grams).items() if n > 1}
        at = np.array([i for i, g in enumerate(grams) if g in often])
        covered = np.zeros(len(words), bool)
        for i in range(window):
            covered[at + i] = True
        repeated = int(covered.sum())
    points = len(text.decode()) - (len(text) - len(text.translate(None, _WHITE)))
    return len(words), points, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts and ``base_failed``: under 50 words, or over half of them in repeated windows."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [counts_of(t or b"") for t in part.column("_text").cast(pa.binary()).to_pylist()]
        return dict(zip(_COUNTS, (pa.array(c, pa.int64()) for c in zip(*found, strict=True)), strict=True))

    out = add_columns(docs, run, dict.fromkeys(_COUNTS, T.LongType()), text, keep)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _value(rule: str) -> Column:
    above, below = RULES[rule][0].split(" / ")
    return F.when(F.col(below) > 0, F.col(above) / F.col(below))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of chance p, summed exactly."""
    total, term = 0.0, n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)
    for i in range(k + 1):
        total += math.exp(term)
        if i < n:
            term += math.log(n - i) - math.log(i + 1) + odds
    return min(total, 1.0)


def choose(tested: list[tuple[float, int, int]], rate: float, level: float) -> float | None:
    """The strictest cutoff before the first failure; ``tested`` has (cutoff, good, good rejected), lenient first."""
    last = None
    for cutoff, n, k in tested:
        if n == 0 or k / n >= rate or binomial_tail(k, n, rate) > level:
            break
        last = cutoff
    return last


def calibrate(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", alpha: float = 0.05, delta: float = 0.05, max_strata: int = 10_000
) -> dict[str, dict[str | None, float]]:
    """For each rule the certified cutoff of each stratum; only counts for each stratum reach the driver."""
    good = labels.groupBy(F.col("doc_id").alias("_label")).agg((F.min("quality") == 1).alias("_q"), (F.coalesce(F.max("toxic"), F.lit(0)) == 0).alias("_t"))
    good = good.where("_q and _t and _label is not null").select("_label")
    held = measured.where("not base_failed").join(good, quoted(doc_id) == F.col("_label"), "left_semi")
    over = [F.count_if(_value(rule) > cutoff).alias(f"{rule}|{i}") for rule, (_, cutoffs) in RULES.items() for i, cutoff in enumerate(cutoffs)]
    rows = held.groupBy(quoted(stratum).alias("_stratum")).agg(F.count("*").alias("_n"), *over).limit(max_strata + 1).collect()
    if len(rows) > max_strata:
        raise ValueError(f"more than {max_strata} strata")
    level = delta / (len(RULES) * max(1, len(rows)))
    out: dict[str, dict[str | None, float]] = {rule: {} for rule in RULES}
    for row in rows:
        for rule, (_, cutoffs) in RULES.items():
            chosen = choose([(c, row["_n"], row[f"{rule}|{i}"]) for i, c in enumerate(cutoffs)], alpha / len(RULES), level)
            if chosen is not None:
                out[rule][row["_stratum"]] = chosen
    return out


def judge(measured: DataFrame, cutoffs: dict[str, dict[str | None, float]], stratum: str = "lang") -> DataFrame:
    """``measured`` with ``kept``: false where the base rules or a certified cutoff of the stratum reject."""
    rejects = [F.col("base_failed")]
    for rule, by in cutoffs.items():
        rejects += [quoted(stratum).eqNullSafe(F.lit(s)) & F.coalesce(_value(rule) > c, F.lit(False)) for s, c in by.items()]
    return measured.withColumn("kept", ~reduce(lambda a, b: a | b, rejects))
