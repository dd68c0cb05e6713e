"""Quality classifier: an interpolated modified Kneser-Ney character model of trusted text.

Tokens are characters.  The ``letters`` most frequent code points of the trusted text are one symbol each, every other
code point is spelled by two (its upper bits, then its lower eleven), so no character is unknown whatever the script.
Four start symbols lead each text, and n-grams up to order five pack into 60 bits.  Counts of five-grams come from all
trusted text, combined in each task, then summed by key; the lower orders have continuation counts.  Each order's
counts are joined with its context sums, sharded by context, and with the next lower order's probabilities, sharded by
suffix: p(w|h) = (c - D(c)) / c(h) + g(h) p(w|h').

Documents get their perplexity for each character.  A model of up to ``max_broadcast`` n-grams (some 16 bytes each)
travels to the texts.  A larger one stays in place: texts are dealt into blocks of ``block_bytes``, each block's
different n-grams are joined with the model's shards, order by order while they are not found, and their scores return
to the block.  A block asks for an n-gram once, so no n-gram is a hot key.  Both give the same values, but for the
order of additions.

A language's threshold is a quantile of the perplexity of trusted documents that the model has not seen (half of them
are held back), on a grid of thousandths of a nat, so a language has some ten thousand steps at most; a language with
fewer than ``least`` of them, whose quantile would rest on a few documents, uses all languages' quantile.  Documents above the threshold are rejected, and those without text, as they have no perplexity.  A null
language is one of its own.  Without any trusted document nothing with text is rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.llm.chars import KeyTable, code_points
from tarmac.llm.frames import add_columns, emit_rows, importable, quoted, stored
from tarmac.llm.words import slices

ORDER = 5
_WIDTH = 12
_GRID = 1000
#: Symbol 0 starts a text; then come the upper parts of spelled code points, their lower parts, and code points of their own.
_LOW = 11
_LOWER = 1 + (0x110000 >> _LOW)
_OWN = _LOWER + (1 << _LOW)


class Alphabet:
    """Symbols of code points."""

    def __init__(self, points: list[int]) -> None:
        self.size = _OWN + len(points)
        self.table = np.zeros(0x110000, np.uint16)
        self.table[points] = np.arange(_OWN, self.size)

    def grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The five-gram that ends at each symbol, packed; the bounds of each text in them; and each text's characters."""
        lead = ORDER - 1
        points, rows = code_points(texts, "\0" * lead)
        start = (rows[:-1, None] + np.arange(lead)).ravel()
        spelled = self.table[points] == 0
        spelled[start] = False
        at = np.arange(len(points)) + np.cumsum(spelled) - spelled
        symbols = np.zeros(len(points) + spelled.sum(), np.uint64)
        symbols[at] = np.where(spelled, 1 + (points >> _LOW), self.table[points])
        symbols[at[spelled] + 1] = _LOWER + (points[spelled] & ((1 << _LOW) - 1))
        symbols[at[start]] = 0
        packed = symbols.copy()
        for back in range(1, ORDER):
            packed[back:] |= symbols[:-back] << np.uint64(_WIDTH * back)
        own = np.ones(len(packed), bool)
        own[at[start]] = False
        return packed[own], np.append(at, len(symbols))[rows] - lead * np.arange(len(rows)), np.diff(rows) - lead


def learn_alphabet(texts: DataFrame, letters: int = (1 << _WIDTH) - _OWN) -> Alphabet:
    """The most frequent code points of ``_text`` (ties: the smaller)."""

    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                points, _ = code_points(part.column("_text"), "")
                found = np.bincount(points)
                total[: len(found)] += found
        points = np.flatnonzero(total)
        yield {"point": pa.array(points.astype(np.int32)), "n": pa.array(total[points])}

    counts = emit_rows(texts, count, {"point": T.IntegerType(), "n": T.LongType()}).groupBy("point").agg(F.sum("n").alias("n"))
    return Alphabet(sorted(r.point for r in counts.orderBy(F.desc("n"), "point").limit(letters).collect()))


def count_grams(texts: DataFrame, alphabet: Alphabet, flush: int = 4_000_000) -> DataFrame:
    """``(gram, c)``: counts of the five-grams of ``_text``."""
    shipped = texts.sparkSession.sparkContext.broadcast(alphabet)

    def count(batches):
        grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged(more, n):
            both, where = np.unique(np.concatenate([grams, more]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "_text"):
                found, _, _ = shipped.value.grams(part.column("_text"))
                grams, counts = merged(*np.unique(found, return_counts=True))
                if len(grams) > flush:
                    yield {"gram": pa.array(grams.view(np.int64)), "c": pa.array(counts)}
                    grams, counts = grams[:0], counts[:0]
        yield {"gram": pa.array(grams.view(np.int64)), "c": pa.array(counts)}

    return emit_rows(texts, count, {"gram": T.LongType(), "c": T.LongType()}).groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams counted once to four times; 0.5, 1, 1.5 where those are too few."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _suffix(column: str, n: int):
    return F.col(column).bitwiseAND((1 << _WIDTH * n) - 1)


def estimate(counts: DataFrame, alphabet: Alphabet) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order from 1: ``(gram, logp)`` of its n-grams, and ``(context, logg)``, the weights of the next lower order."""
    tables = [stored(counts)]
    for n in range(ORDER - 1, 0, -1):
        tables.insert(0, stored(tables[0].groupBy(_suffix("gram", n).alias("gram")).agg(F.count("*").alias("c"))))
    probabilities: list[DataFrame] = []
    weights: list[DataFrame] = []
    for n, table in enumerate(tables, 1):
        d1, d2, d3 = discounts(list(table.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()))
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = table.withColumn("context", F.shiftright("gram", _WIDTH))
        context = stored(table.groupBy("context").agg(F.sum("c").alias("s"), (F.sum(discount) / F.sum("c")).alias("g")))
        own = table.join(context, "context").select("gram", ((F.col("c") - discount) / F.col("s")).alias("own"), "g")
        if n == 1:
            full = own.select("gram", (F.col("own") + F.col("g") / F.lit(float(alphabet.size))).alias("p"))
        else:
            lower = probabilities[-1].select(F.col("gram").alias("lower"), F.exp("logp").alias("below"))
            full = own.join(lower, _suffix("gram", n - 1) == F.col("lower")).select("gram", (F.col("own") + F.col("g") * F.col("below")).alias("p"))
        probabilities.append(stored(full.select("gram", F.log("p").alias("logp"))))
        weights.append(context.select("context", F.log(F.greatest("g", F.lit(1e-12))).alias("logg")))
    return probabilities, weights


class Model:
    """The estimated tables in memory."""

    def __init__(self, probabilities: list[DataFrame], weights: list[DataFrame], alphabet: Alphabet) -> None:
        self.alphabet = alphabet
        self.probabilities = [self._load(t, "gram", "logp") for t in probabilities]
        self.weights = [self._load(t, "context", "logg") for t in weights]
        self.floor = -math.log(alphabet.size)

    @staticmethod
    def _load(table: DataFrame, key: str, value: str) -> tuple[KeyTable, np.ndarray]:
        rows = table.toArrow()
        return KeyTable(rows.column(key).to_numpy().view(np.uint64)), np.append(rows.column(value).to_numpy(), 0.0)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each packed five-gram."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            own = grams[todo] & np.uint64((1 << _WIDTH * n) - 1)
            table, logp = self.probabilities[n - 1]
            at = table.find(own)
            out[todo] += logp[at]  # position -1 holds zero
            missing = at < 0
            todo, own = todo[missing], own[missing]
            table, logg = self.weights[n - 1]
            out[todo] += logg[table.find(own >> np.uint64(_WIDTH))]
        out[todo] += self.floor
        return out


def _means(logs: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.Array:
    """Mean negative log probability of each text's characters; null without any."""
    total = np.array([logs[s:e].sum() for s, e in zip(rows[:-1], rows[1:], strict=True)])
    return pa.array(np.divide(-total, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)


def resolve(wanted: DataFrame, probabilities: list[DataFrame], weights: list[DataFrame], alphabet: Alphabet, n: int = ORDER) -> DataFrame:
    """``(gram, logp)`` of the different n-grams ``gram``: what an order does not have goes on to the next lower one."""
    found = stored(wanted.join(probabilities[n - 1], "gram", "left"))
    missing = found.where("logp is null").select("gram", F.shiftright("gram", _WIDTH).alias("context"))
    if n == 1:  # the empty context has one weight, and below it all symbols are alike
        weight = weights[0].first()
        return found.select("gram", F.coalesce("logp", F.lit((weight["logg"] if weight else 0.0) - math.log(alphabet.size))).alias("logp"))
    missing = stored(missing.join(weights[n - 1], "context", "left").select("gram", _suffix("gram", n - 1).alias("lower"), F.coalesce("logg", F.lit(0.0)).alias("logg")))
    below = resolve(missing.select(F.col("lower").alias("gram")).distinct(), probabilities, weights, alphabet, n - 1)
    lower = missing.join(below.select(F.col("gram").alias("lower"), "logp"), "lower").select("gram", (F.col("logg") + F.col("logp")).alias("logp"))
    return found.where("logp is not null").unionByName(lower)


def _joined(docs: DataFrame, probabilities: list[DataFrame], weights: list[DataFrame], alphabet: Alphabet, text: str, names: list[str], block_bytes: int) -> DataFrame:
    """``docs`` with ``nats`` with the model in place; see the module's text."""
    importable(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(alphabet)
    source = docs.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(names)], quoted(text).alias("_text"))
    kept = {f.name: f.dataType for f in source.schema}

    def number(batches):
        first, at, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in slices(batch, "_text"):
                yield {**dict(zip(kept, part.columns, strict=True)), "block": pa.array(np.full(len(part), first + at))}
                size += part.column("_text").nbytes
                at, size = (at + 1, 0) if size >= block_bytes else (at, size)

    dealt = stored(emit_rows(source, number, {**kept, "block": T.LongType()}))

    def asked(batches):
        block, grams = None, np.zeros(0, np.uint64)
        row = lambda: {"block": pa.array(np.full(len(grams), block)), "gram": pa.array(grams.view(np.int64))}
        for batch in batches:
            for part in slices(batch, "_text"):
                blocks = part.column("block").to_numpy()
                for own in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                    if blocks[own[0]] != block:
                        if len(grams):
                            yield row()
                        block, grams = blocks[own[0]], grams[:0]
                    grams = np.unique(np.concatenate([grams, shipped.value.grams(part.column("_text").take(pa.array(own)))[0]]))
        if len(grams):
            yield row()

    pairs = stored(emit_rows(dealt.select("block", "_text"), asked, {"block": T.LongType(), "gram": T.LongType()}))
    scored = pairs.join(resolve(pairs.select("gram").distinct(), probabilities, weights, alphabet), "gram").select("block", "gram", "logp")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in source.schema if f.name != "_text"), T.StructField("nats", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def apply(own: pa.Table, known: pa.Table) -> pa.Table:
        grams, logs = known.column("gram").to_numpy().view(np.uint64), known.column("logp").to_numpy()
        order = np.argsort(grams)
        grams, logs = grams[order], logs[order]
        out = []
        for batch in own.to_batches():
            for part in slices(batch, "_text"):
                found, rows, n = shipped.value.grams(part.column("_text"))
                nats = _means(logs[np.searchsorted(grams, found)], rows, n)
                out.append(pa.RecordBatch.from_arrays([*[part.column(f.name).cast(f.type) for f in arrow if f.name != "nats"], nats], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    found = dealt.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(apply, schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], "nats")


def score(
    docs: DataFrame, probabilities: list[DataFrame], weights: list[DataFrame], alphabet: Alphabet, text: str = "text", keep: list[str] | None = None, max_broadcast: int = 6_000_000, block_bytes: int = 64 << 20
) -> DataFrame:
    """``docs`` with ``nats``, the mean negative log probability of a character (null without text)."""
    size = sum(t.count() for t in [*probabilities, *weights])
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != "nats"]
    if size > max_broadcast:
        return _joined(docs, probabilities, weights, alphabet, text, names, block_bytes)
    shipped = docs.sparkSession.sparkContext.broadcast(Model(probabilities, weights, alphabet))

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        model = shipped.value
        grams, rows, n = model.alphabet.grams(part.column("_text"))
        logs = [model.score(grams[at : at + (1 << 18)]) for at in range(0, len(grams), 1 << 18)]
        return {"nats": _means(np.concatenate(logs) if logs else np.zeros(0), rows, n)}

    return add_columns(docs, run, {"nats": T.DoubleType()}, text, names)


def thresholds(scored: DataFrame, lang: str = "lang", quantile: float = 0.99, least: int = 1000) -> dict:
    """The grid step of each language's quantile; ``...`` stands for all languages together.  One row a language reaches the driver."""
    steps = scored.where("nats is not null").groupBy(quoted(lang).alias("_lang"), F.ceil(F.col("nats") * _GRID).alias("step")).agg(F.count("*").alias("n"))
    steps = stored(steps)
    pooled = steps.groupBy("step").agg(F.sum("n").alias("n")).withColumn("_all", F.lit(True)).withColumn("_lang", F.lit(None).cast(scored.schema[lang].dataType))
    both = steps.withColumn("_all", F.lit(False)).unionByName(pooled)
    by = Window.partitionBy("_all", "_lang")
    both = both.withColumn("below", F.sum("n").over(by.orderBy("step"))).withColumn("total", F.sum("n").over(by))
    rows = both.where(F.col("below") >= quantile * F.col("total")).groupBy("_all", "_lang").agg(F.min("step").alias("step"), F.max("total").alias("total")).collect()
    return {(... if r["_all"] else r["_lang"]): r["step"] for r in rows if r["_all"] or r["total"] >= least}


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, quantile: float = 0.99, max_ids: int = 2_000_000, **options
) -> DataFrame:
    """``docs`` with ``perplexity`` and ``kept``.  Trusted documents have labels, all of good quality and none toxic."""
    good = labels.groupBy(F.col("doc_id").alias("_label")).agg((F.min("quality") == 1).alias("_q"), (F.coalesce(F.max("toxic"), F.lit(0)) == 0).alias("_t"))
    good = stored(good.where("_q and _t and _label is not null").select("_label"))
    few = good.count() <= max_ids  # their broadcast takes some 32 MB at most; more are dealt with the texts by id
    trusted = docs.select(quoted(doc_id).alias("_id"), quoted(lang).alias("_lang"), quoted(text).alias("_text")).join(F.broadcast(good) if few else good, F.col("_id") == F.col("_label"), "left_semi")
    trusted = stored(trusted.withColumn("_half", F.pmod(F.xxhash64("_id"), F.lit(2))))
    texts = trusted.where("_half = 0").select("_text")
    alphabet = learn_alphabet(texts)
    probabilities, weights = estimate(count_grams(texts, alphabet), alphabet)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("perplexity", "kept", "nats")]
    scored = score(docs, probabilities, weights, alphabet, text, [*names, *({lang} - set(names))], **options)
    small = stored(score(trusted.where("_half = 1"), probabilities, weights, alphabet, "_text", ["_lang"], **options))
    steps = thresholds(small, "_lang", quantile)
    limit = F.lit(steps.get(..., 1 << 40))
    for name, step in steps.items():
        if name is not ...:
            limit = F.when(quoted(lang).eqNullSafe(F.lit(name)), step).otherwise(limit)
    kept = F.coalesce(F.ceil(F.col("nats") * _GRID) <= limit, F.lit(False))
    return scored.select(*map(quoted, names), F.exp("nats").alias("perplexity"), kept.alias("kept"))
