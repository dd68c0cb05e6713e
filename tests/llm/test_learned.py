"""Learned operators: Kneser-Ney against a dictionary version, filters on held-out texts, certified cutoffs, page text."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.llm import html, kneser, langid, rules


@pytest.fixture(scope="module")
def labels(spark, corpus):
    ids = sorted({r[0] for r in corpus if r[0] is not None})
    rows = [(i, 0 if i % 5 == 0 else 1, int(i % 33 == 0)) for i in ids[:-3]] + [(ids[1], 1, None), (None, 1, 0), (999_999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def spelled(text, alphabet):
    """Symbols of a text: one for a code point that the alphabet has, else its upper bits and its lower eleven."""
    upper = 0x110000 >> 11
    return [x for c in map(ord, text or "") for x in ([int(alphabet.table[c])] if alphabet.table[c] else [1 + (c >> 11), 1 + upper + (c & 2047)])]


def brute_model(texts, alphabet):
    """Interpolated modified Kneser-Ney by dictionaries; returns log probabilities of packed five-grams."""
    n = kneser.ORDER
    counts = [Counter() for _ in range(n + 1)]
    for text in texts:
        symbols = [0] * (n - 1) + spelled(text, alphabet)
        counts[n].update(tuple(symbols[i : i + n]) for i in range(len(symbols) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds = [None] + [kneser.discounts([sum(1 for c in counts[k].values() if c == x) for x in (1, 2, 3, 4)]) for k in range(1, n + 1)]
    context = [defaultdict(lambda: [0, 0.0]) for _ in range(n + 1)]
    for k in range(1, n + 1):
        for g, c in counts[k].items():
            context[k][g[:-1]][0] += c
            context[k][g[:-1]][1] += ds[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / alphabet.size
        total, mass = context[k].get(gram[:-1], (0, 0.0))
        if not total:
            return p(gram[1:])
        c = counts[k].get(gram, 0)
        return (max(c - ds[k][min(c, 3) - 1], 0) if c else 0) / total + mass / total * p(gram[1:])

    return p


def test_kneser_ney_is_the_model(spark, docs, corpus):
    train = [r[1] for r in corpus[:40]]
    texts = spark.createDataFrame([(t,) for t in train], "_text string")
    alphabet = kneser.learn_alphabet(texts, 12)  # rarer letters are spelled by two symbols
    probabilities, weights = kneser.estimate(kneser.count_grams(texts, alphabet, flush=500), alphabet)
    p = brute_model(train, alphabet)
    keys = ["doc_id", "text"]
    want = {}
    for doc_id, text, *_ in corpus:
        symbols = [0] * 4 + spelled(text, alphabet)
        logs = [math.log(p(tuple(symbols[i : i + 5]))) for i in range(len(symbols) - 4)]
        want[(doc_id, text)] = -sum(logs) / len(text) if logs else None
    for limit in (10**9, 0):  # the model travels to the texts, or the texts' n-grams to the model
        got = kneser.score(docs.withColumn("nats", F.lit(1)), probabilities, weights, alphabet, keep=keys, max_broadcast=limit, block_bytes=5000).collect()
        assert len(got) == len(corpus)
        for r in got:
            assert r.nats == pytest.approx(want[(r.doc_id, r.text)], abs=1e-9) if want[(r.doc_id, r.text)] is not None else r.nats is None
    total = sum(math.exp(x) for x in [math.log(p((0, 0, 0, 0, s))) for s in range(alphabet.size)])
    assert total == pytest.approx(1, abs=1e-6)


def test_classifier_rejects_noise_and_keeps_prose(spark, corpus, labels):
    noise = [(10_000 + i, "".join(chr(33 + (i * 7 + j * j) % 60) for j in range(300)), "en", "src", 300) for i in range(10)]
    docs = spark.createDataFrame(corpus + noise, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("nats", F.lit(0))
    got = {r.doc_id: r for r in kneser.classify(docs, labels).collect()}
    assert not any(got[10_000 + i].kept for i in range(10))
    prose = [r[0] for r in corpus[:60] if r[0] is not None]
    assert sum(got[i].kept for i in prose) >= 0.9 * len(prose)
    assert kneser.classify(docs, labels).count() == len(corpus) + len(noise)


def test_classifier_without_anything(spark, empty, docs, labels):
    assert kneser.classify(empty, labels).count() == 0
    kept = kneser.classify(docs, labels.limit(0))
    assert kept.where("kept and (text is null or text = '')").count() == 0
    assert kept.where("not kept and length(text) > 0").count() == 0


def test_thresholds(spark):
    rows = [("a", i / 1000 - 0.0005) for i in range(1, 1001)] + [("b", 5.0)] + [(None, None)]
    steps = kneser.thresholds(spark.createDataFrame(rows, "lang string, nats double"), quantile=0.9, least=100)
    assert steps == {"a": 900, ...: 901}


def test_key_table():
    from tarmac.llm.chars import KeyTable

    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**62, 5000, np.uint64))
    table = KeyTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(rng.integers(2**62, 2**63, 3000, np.uint64)) == -1).all()
    assert KeyTable(keys[:0]).find(keys[:4]).tolist() == [-1] * 4


def test_languages(docs, corpus, empty):
    clear = docs.where("lang is not null and length(text) > 200")
    filters = langid.learn(clear.where("doc_id % 2 = 0"))
    assert filters.languages == ["de", "en", "fr"]
    got = langid.predict(docs.withColumn("score", F.lit("clash")), filters).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    own = [r for r in got if r.doc_id is not None and r.doc_id < 180 and r.doc_id % 2]
    assert np.mean([r.lang_pred == r.lang for r in own]) > 0.9
    blank = langid.learn(empty)
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, blank).collect()} == {("und", 0.0)}
    assert langid.predict(empty, filters).count() == 0


def brute_languages(rows, share, min_count):
    """Trigrams by language as sets, by the definition."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        grams, _ = langid.trigrams(pa.array([text]))
        counts[lang].update(grams.tolist())
    total = {n: sum(c.values()) for n, c in counts.items()}
    rate = lambda n, g: counts[n][g] / total[n] if counts[n][g] >= min_count else 0.0
    top = {g: max(rate(n, g) for n in counts) for c in counts.values() for g in c}
    return {n: {g for g in c if rate(n, g) > 0 and rate(n, g) >= share * top[g]} for n, c in counts.items() if total[n]}


def test_filters_hold_the_exact_sets_of_many_languages(spark):
    rng = random.Random(11)
    names = [f"l{i:03d}" for i in range(150)]  # three mask words
    own = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèñ") for _ in range(rng.randint(2, 5))) for _ in range(8)] for n in names}
    rows = [(" ".join(rng.choice(own[n]) for _ in range(60)), n) for n in names for _ in range(3)] + [(None, names[0]), ("", names[1]), ("none learns this", None)]
    filters = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    exact = brute_languages([r for r in rows if r[1] is not None], 0.25, 2)
    assert filters.languages == names and filters.masks.shape[0] == 3
    every = np.array(sorted({g for s in exact.values() for g in s}), np.uint64)
    found = filters.containing(every)
    extra = 0
    for i, n in enumerate(names):
        hit = (found[i // 63] >> np.uint64(i % 63) & np.uint64(1)).astype(bool)
        want = np.isin(every, np.array(sorted(exact[n]), np.uint64))
        assert not (want & ~hit).any()  # Bloom filters lose nothing
        extra += int((hit & ~want).sum())
    assert extra <= 0.001 * len(every) * len(names)
    texts = [" ".join(rng.choice(own[n]) for _ in range(40)) for n in names]
    for text, name, score in zip(texts, *filters.decide(*langid.trigrams(pa.array(texts))), strict=True):
        grams = langid.trigrams(pa.array([text]))[0].tolist()
        shares = {n: sum(g in s for g in grams) / len(grams) for n, s in exact.items()}
        assert shares[name] >= max(shares.values()) - 0.01 and score == pytest.approx(shares[name], abs=0.02)


def test_trigrams():
    grams, rows = langid.trigrams(pa.array(["Ab c", None, "é"]))
    assert len(grams) == 4 and rows.tolist() == [0, 3, 3, 4]
    assert grams[0] == (ord("a") << 21 | ord("b"))


def slow_counts(text):
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    lines = [x for x in text.split(b"\n") if x.strip()]
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(bytes([c])) for c in b"#*$%&|<>"), repeated, len(covered), len(lines)


def test_rule_counts(docs, corpus):
    want = Counter((d, *slow_counts((t or "").encode())) for d, t, *_ in corpus)
    got = Counter(tuple(r) for r in rules.measure(docs.withColumn("n_words", F.lit("x"))).select("doc_id", *rules._COUNTS).collect())
    assert got == want


def test_exact_binomial():
    for n, k, p in ((20, 3, 0.2), (50, 0, 0.05), (7, 7, 0.5), (300, 2, 0.0125)):
        assert rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert rules.choose([(3.0, 1000, 0), (2.0, 1000, 2), (1.0, 1000, 40), (0.5, 1000, 0)], 0.0125, 0.003) == 2.0  # a failure ends the series
    assert rules.choose([(3.0, 10, 0)], 0.0125, 0.003) is None


def test_risk_is_controlled(spark):
    rows = [(i, "good words in a row that differ by number " * 1 + " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(2000)]
    rows += [(10_000 + i, " ".join(f"w{i}y{j}###" for j in range(60)), "en") for i in range(200)] + [(20_000, " ".join(f"z{j}$$$" for j in range(60)), "xx"), (20_001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)] + [(10_000 + i, 0, 0) for i in range(100)] + [(20_000, 1, 0)], "doc_id bigint, quality int, toxic int")
    measured = rules.measure(docs, keep=["doc_id", "lang"])
    cutoffs = rules.calibrate(measured, labels)
    assert cutoffs["symbols_per_word"] == {"en": 0.1}
    kept = {r.doc_id: r.kept for r in rules.judge(measured, cutoffs).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[10_000 + i] for i in range(200))
    assert kept[20_000] and not kept[20_001]  # too few labels to reject by; no words
    assert rules.judge(measured.limit(0), rules.calibrate(measured, labels.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1><ul><li><a href=x>Menu one</a></ul></header><div id="cookie-notice">We use cookies. Accept, please.</div>
<div class="wrap"><div class="sidebar"><p>Side text, more text.</p></div><!-- <p>hidden, text.</p> -->
<div class="post-content"><h2>The title</h2><p>First&nbsp;paragraph, with <b>bold</b> text;
and more &eacute; &amp; &lt;tag&gt;.</p><p>Short.<p>Unclosed, one.<ul><li>Item one, here.</li><li>Item two.</ul><form><input><label>Mail</label></form><br></div>
<div id="comments"><p>I like this article, it is very good. Really.</p></div></div><nav><p>Not, this.</p></nav><footer><p>Copyright 2020, all rights reserved.</p></footer></body></html>"""


def test_page_text(spark):
    want = "The title\nFirst paragraph, with bold text; and more é & <tag>.\nShort.\nUnclosed, one.\nItem one, here.\nItem two."
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain words, no markup."), (None, "u", PAGE), (1, "u", PAGE), (5, "u", "<p>" * 2000 + "deep, text." + "<a href='"), (6, "u", "<div><p>" + "long text, yes. " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = html.extract(pages).collect()
    assert Counter((r.page_id, r.text) for r in got if r.page_id in (1, 2, 3, 4, None)) == Counter({(1, want): 2, (None, want): 1, (2, ""): 1, (3, ""): 1, (4, "plain words, no markup."): 1})
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[6] == len(("long text, yes. " * 20_000).strip())
    assert html.extract(pages.limit(0)).count() == 0


def test_page_names_count_whole():
    long = "A long paragraph of the article, with commas, and full stops. It goes on, and on, for a while. " * 4
    kept = [f"<div class='share-price'><p>{long}</p></div>", f"<section id='form-of-government'><p>{long}</p></section>", f"<div class='hidden-figures search-results'><p>{long}</p></div>", f"<p class='related-work'>{long}</p>"]
    gone = [f"<div class='{c}'><p>{long}</p></div>" for c in ("comment-list", "site-sidebar", "x ad-slot-2", "cookieNotice", "share", "related-posts", "advert-300x250", "newsletter_signup", "nav")]
    for page in ("<body><div class='story'>{}</div></body>", "<article>{}</article>"):
        assert html.main_text(page.format("".join(kept))).split("\n") == [long.strip()] * 4
        assert html.main_text(page.format(f"<p>{long}</p>" + "".join(gone))) == long.strip()


def test_page_reading_is_linear():
    hostile = ["<div a='" * 40_000, '<a href="x ' * 30_000, "<div>t" * 50_000, "<b>" * 100_000 + "x</b>", "<svg>" * 60_000, "<li>x" * 60_000, "<" * 300_000, "<!--" * 80_000, "<b>" * 500 + "</i>" * 70_000, "<div " + 'a="b ' * 60_000 + ">", "".join(f"<p class=c{i}>t" for i in range(20_000))]
    for page in hostile:
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 5, page[:20]
    text = "Words of the article, and more of them. " * 5
    assert html.main_text(f"<p>{text}</p><p>{text}</p><p title='open>{text}</p><p>{text}</p>").split("\n") == [text.strip()] * 4
    assert html.main_text(f"<p>{text}</p><p class='a>b' title=\"c>d\">{text}</p>").split("\n") == [text.strip()] * 2


def slow_ratios(blocks, threshold):
    """The paths that tag-path ratios choose, by loops over the definition."""
    paths = list(dict.fromkeys(b.path for b in blocks))
    own = {p: [b for b in blocks if b.path == p] for p in paths}
    mean = lambda f: {p: sum(map(f, own[p])) / len(own[p]) for p in paths}
    length, marks, linked = mean(lambda b: len(b.text)), mean(lambda b: sum(c in ".,;:!?…。、，！？；：¿¡" for c in b.text)), mean(lambda b: min(b.linked, len(b.text)))

    def smooth(of):
        v = [of[b.path] for b in blocks]
        return [(v[max(i - 1, 0)] + 2 * v[i] + v[min(i + 1, len(v) - 1)]) / 4 for i in range(len(v))]

    text, punctuation = smooth(length), smooth(marks)
    fused = [(t / max(text) + (p / max(punctuation) if max(punctuation) else 0)) * (1 - linked[b.path] / length[b.path]) for b, t, p in zip(blocks, text, punctuation, strict=True)]
    value = {p: sum(f for b, f in zip(blocks, fused, strict=True) if b.path == p) / len(own[p]) for p in paths}
    size = {p: sum(len(b.text) for b in own[p]) for p in paths}
    bar = threshold * sum(value[p] * size[p] for p in paths) / sum(size.values())
    return {p for p in paths if value[p] >= bar - 1e-12 and value[p] > 0}


def test_page_paths_are_chosen_by_the_ratios():
    rng = random.Random(2)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(2, 14)):
            tag, words = rng.choice(["p", "div", "h2", "li", "td"]), rng.randint(1, 60)
            body = " ".join(rng.choice(["word", "and,", "more.", "text"]) for _ in range(words))
            parts.append(f"<{tag} class=k{rng.randint(0, 2)}>" + (f"<a href=x>{body}</a>" if rng.random() < 0.3 else body) + f"</{tag}>")
        blocks = html.blocks_of("<body><div class=all>" + "".join(parts) + "</div></body>")
        chosen = slow_ratios(blocks, 0.5)
        got = html.select(blocks, 0.5)
        assert {b.path for b in got} >= chosen
        assert [b for b in blocks if b.path in chosen] == [b for b in got if b.path in chosen]
        parents = {p[:-1] for p in chosen}
        assert all(b.path in chosen or any(b.path[:n] in parents for n in range(len(b.path))) for b in got)


def test_page_text_of_lists_tables_and_captions():
    long = "A long paragraph of the article, with commas, and full stops. It goes on, and on, for a while. " * 4
    inner = (
        f"<p>{long}</p><ul><li>Tea</li><li>Milk</li></ul><table><tr><th>City</th><td>Kyoto</td></tr></table><dl><dt>Term</dt><dd>Sense</dd></dl>"
        f"<figure><figcaption>A caption</figcaption></figure><p>{long}</p><ul><li><a href=x>Linked elsewhere</a></li></ul>"
    )
    want = [long.strip(), "Tea", "Milk", "City", "Kyoto", "Term", "Sense", "A caption", long.strip()]
    for page in (f"<article>{inner}</article>", f"<body><div class='story'>{inner}</div></body>", f"<body>{inner}</body>"):
        assert html.main_text(page).split("\n") == want
    # containers of other classes have ratios of their own
    page = f"<body><div class='story'><p>{long}</p><p>{long}</p></div><div class='box'><p>Short</p></div><div class='box'><p>Words</p></div></body>"
    assert html.main_text(page).split("\n") == [long.strip()] * 2
    assert {b.path for b in html.blocks_of("<div class='b a'><p>text</p></div>")} == {("div.a.b", "p")}
