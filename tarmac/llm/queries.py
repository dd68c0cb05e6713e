"""Queries over the whole tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, contain, html, kneser, langid, lines, mix, negatives, rules, simhash, tokenbin, whiten, windows
from tarmac.llm.frames import stored, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(rules.measure(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"]))
    judged = rules.judge(measured, rules.calibrate(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.remove_repeats(table(spark, sf_dir, "documents"), size=35, keep=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is neither held out nor learned from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    filters = langid.learn(docs.where("not held_out and doc_id is not null"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), filters, keep=["doc_id", "held_out"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenbin.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    stored_ids = tokenbin.records(path, docs)
    return stored_ids.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source in the weights 5, 2, 1; no one more than three times."""
    mix_of = mix.mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mix_of.select("doc_id", "size", "source_size", "target", "taken")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100, against all rows; the label of every seventh id is the next one."""
    label, by = F.col("label").cast("long"), lambda n: F.coalesce(F.col("vec_id") % n == 0, F.lit(False))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(by(7), (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, by(100))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whiten.whitened(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


_ALL = (
    op1_line_dedup, op2_html_text, op3_risk_rules, op4_byte_bpe, op5_kneser_ney, op6_repeated_windows, op7_language_filters, op8_decontamination, op9_simhash, op10_token_shards,
    op11_source_mix, op12_hard_negatives, op13_whitening,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL where SQL can express the query.
ORACLES: dict[str, str] = {
    "op6_repeated_windows": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        spots AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
        win AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM spots JOIN docs USING (r)),
        gone AS (SELECT DISTINCT r, i + k AS i FROM win, range(0, 35) t(k) WHERE n > 1),
        word AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM docs),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)""",
    "op8_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        t AS (SELECT DISTINCT item_id, text, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
        q AS (SELECT item_id, text, len(w) AS n, least(5, len(w)) AS k, w FROM t WHERE len(w) > 0),
        qs AS (SELECT DISTINCT item_id, text, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM q)),
        ds AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
        size AS (SELECT item_id, text, count(*) AS n FROM qs GROUP BY ALL)
        SELECT doc_id, item_id, any_value(size.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*) / any_value(size.n) AS containment
        FROM ds JOIN qs USING (k, s) JOIN size USING (item_id, text) GROUP BY r, doc_id, item_id, text
        HAVING count(*) >= 0.8 * any_value(size.n) - 1e-9""",
    "op12_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) for c in embedding] AS x
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
        a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
        s AS (SELECT a.r, a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM a JOIN v ON a.r <> v.r),
        p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY p.r, positive_id, positive_score ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (r, anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        QUALIFY row_number() OVER (PARTITION BY p.r, positive_id, positive_score ORDER BY s.score DESC, s.vec_id) <= 5""",
}
