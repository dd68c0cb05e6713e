"""Mixing sources to target weights, each source's budget fitted to the word by subset sums.

Documents are counted by source and exact length.  A source's budget gives every document a number of whole repeats; what
is left is shared over its lengths in proportion, and a bounded knapsack over counts of lengths fits the last words, so the
search grows with the number of different lengths and not of documents.  Which documents of a length are taken is a
matter of a seeded hash: documents are dealt into ranges of (source, length, hash), and every range learns how many its
length has taken in the ranges before it, so a length with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.frames import importable, quoted, row_keys, stored
from tarmac.operators.prefix import running

WORD = r"[^\x20\x09-\x0D]+"
_WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: DataFrame, weights: list[int], limit: int) -> DataFrame:
    """``sizes`` (``source``, ``source_size``; a row a source) with ``rank`` by code point (null last) and ``target``.

    Sources share the sum of all sizes by ``weights``, which repeat in rank order.  A target stops at ``limit`` times its
    source's size; what is over goes to the rest by weight, again until none is above.  A round is one aggregate.
    """
    named = sizes.where("source is not null").withColumn("_one", F.lit(1).cast("long"))
    ranked = running(named, [], "source", "_one", inclusive=False).withColumnRenamed("running", "rank").drop("_one")
    unnamed = sizes.where("source is null").crossJoin(F.broadcast(named.agg(F.count(F.lit(1)).alias("rank"))))  # one row each
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    each = stored(ranked.unionByName(unnamed).withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size").cast(_WIDE) * limit))
    full = F.lit(False)
    known = -1
    total = each.agg(F.sum(F.col("source_size").cast(_WIDE))).first()[0] or 0
    while True:
        row = each.agg(F.sum(F.when(full, F.col("_cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == known:
            break
        known, rest, by = row["n"], int(total - (row["held"] or 0)), row["weight"] or 1
        full = F.lit(rest).cast(_WIDE) * F.col("weight") > F.col("_cap") * by
    target = F.when(full, F.col("_cap").cast("double")).otherwise(F.lit(rest).cast(_WIDE).cast("double") * F.col("weight") / by)
    return each.select("source", "source_size", "rank", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0, table: int = 1 << 16, work: int = 1 << 31) -> np.ndarray:
    """How many of ``counts`` things of each different length to take, so that their sum comes as near to ``budget`` as can be found.

    Every length first gives the same share of its count, rounded down.  Lengths in seeded order then give one more as long
    as about half of ``table`` words stay open, and a bounded knapsack over what is left fits those: which sums up to
    twice that can be reached, by binary parts of each count.  It stops at an exact
    fit, and where ``work`` (sums looked at) is used up with the nearest sum so far.  Ties prefer the smaller sum.
    """
    n = len(lengths)
    take = np.zeros(n, np.int64)
    whole = sum(int(x) * int(c) for x, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not whole:
        return take
    if budget >= whole:
        return counts.astype(np.int64)
    take = np.array([0 if x == 0 else int(c) * budget // whole for x, c in zip(lengths, counts, strict=True)], np.int64)
    left = budget - sum(int(x) * int(t) for x, t in zip(lengths, take, strict=True))
    order = np.random.default_rng(seed).permutation(n)
    for i in order:
        if lengths[i] and take[i] < counts[i] and lengths[i] <= left - table // 2:
            take[i] += 1
            left -= int(lengths[i])
    spare = [int(i) for i in order if lengths[i] and take[i] < counts[i]]
    if not spare or not left:
        return take
    size = 2 * left + 1  # a sum beyond is farther from what is left than nothing is
    if size > work >> 4:  # texts of many million words: one more of the shortest, if that comes nearer
        least = min(spare, key=lambda i: lengths[i])
        take[least] += int(lengths[least] < 2 * left)
        return take
    # the part by which each sum was first reached; -1: not yet
    by, parts, used = np.full(size, -1, np.int32), [], 0
    by[0] = 0
    parts.append((0, 0))
    for i in spare:
        if by[left] >= 0 or used > work:
            break
        room, k = int(counts[i] - take[i]), 1
        while room and by[left] < 0:
            k = min(k, room, 1 << 40)
            step = int(lengths[i]) * k
            if step >= size:
                break
            fresh = np.flatnonzero((by[:-step] >= 0) & (by[step:] < 0)) + step
            by[fresh] = len(parts)
            parts.append((i, k))
            used += size
            room, k = room - k, 2 * k
    reached = np.flatnonzero(by >= 0)
    at = int(reached[np.argmin(np.abs(reached - left))])
    while at:
        i, k = parts[by[at]]
        take[i] += k
        at -= int(lengths[i]) * k
    return take


def mixed(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: list[str] | None = None, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 11, table: int = 1 << 16,
) -> DataFrame:
    """A row for each document: ``keep`` (all columns by default), ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` is the number of words (a null or empty text has none), ``target`` the words that the document's source is to
    have (see ``shares``), ``copies`` (0 to ``limit``) how often the mix has the document, ``taken`` the words of those
    copies.  The sum of ``taken`` of a source is the reachable number nearest to its target that ``fit`` finds: the
    target to the word, but where a source has only few or very long texts.  Documents of one source differ by one copy at
    most.  The choice follows a hash of id and text under ``seed``, so reruns agree; repeated rows have one hash, and any of
    them may be the one with a copy more.  A null source is a source, the last one.  A source without words and an empty
    table take nothing.  Columns of the input named like new ones give way to them.  Texts are read once and not moved
    unless ``keep`` has them.
    """
    importable(docs.sparkSession)
    new = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    first, second = row_keys(doc_id, text)
    own = docs.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(source).cast("string").alias("source"), word_count(quoted(text)).alias("size"), F.xxhash64(F.lit(seed), first, second).alias("hash"))
    own = stored(own)
    dealt = stored(own.repartitionByRange("source", "size", "hash").withColumn("part", F.spark_partition_id()))
    counts = stored(dealt.groupBy("part", "source", "size").agg(F.count(F.lit(1)).alias("n")))  # in place: a row for each length of a range
    lengths = stored(counts.groupBy("source", "size").agg(F.sum("n").alias("n")))
    totals = stored(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = stored(shares(totals, list(weights), limit))
    whole = F.least(F.round("target").cast("long"), F.col("source_size") * limit)
    plan = plan.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(whole / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", whole - F.col("repeats") * F.col("source_size"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        take = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]), seed, table)
        return pd.DataFrame({"rank": pdf["rank"], "size": pdf["size"], "take": take})

    # a group is a source's different lengths: as many as its longest text has words at most
    ranked = lengths.join(plan.select(F.col("source").alias("_s"), "rank", "budget"), F.col("source").eqNullSafe(F.col("_s"))).select("rank", "size", "n", "budget")
    found = stored(ranked.groupBy("rank").applyInPandas(quotas, "rank long, size long, take long"))

    # what each range of (source, size, hash) has to take of a length: the first of the length, as many as its quota has
    ids = counts.join(plan.select(F.col("source").alias("_s"), "rank", "repeats", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").join(found, ["rank", "size"])
    earlier = Window.partitionBy("rank", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    due = ids.withColumn("due", F.greatest(F.lit(0), F.col("take") - F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    due = due.select(F.col("part").alias("_p"), F.col("source").alias("_s"), F.col("size").alias("_z"), "due", "repeats", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("part", "source", "size").orderBy("hash"))
    same = (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    out = dealt.withColumn("place", place).join(due, same)
    copies = (F.col("repeats") + (F.col("place") <= F.col("due")).cast("long")).alias("copies")
    out = out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def repeated(mix: DataFrame) -> DataFrame:
    """The mix itself: every document as often as ``copies`` says."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
