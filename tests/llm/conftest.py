import random

import pytest

LANGS = {"en": "the of and ing tion er thing only", "de": "und sch ung der keit lich zu über", "fr": "le eau é tion que ment è du"}


def prose(rng, lang, words):
    parts = LANGS[lang].split()
    out = []
    for i in range(words):
        out.append("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + (". " if i % 9 == 8 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): prose, copies, near copies, shared passages, and odd texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice(list(LANGS)), rng.randint(60, 240)) for _ in range(60)]
    passage = "\n" + prose(rng, "en", 55) + "\n"
    for i in range(0, 30, 3):
        texts[i] = texts[i][:200] + passage + texts[i][200:]
    lines = [prose(rng, "de", 14) for _ in range(8)]
    texts += ["\n".join(lines), "\n".join([*lines[:3], "etwas anderes steht hier jetzt ganz neu", *lines[4:]]), "\n".join(lines)]
    texts += [texts[1], texts[2], texts[2].replace(" ", "  ", 1), " ".join(texts[4].split()[:-1])]
    texts += [None, "", " \n\t ", "one", "two words", "漢字 and\x1fodd space 🙂", "wort " * 400, "x" * 5000, "<|endoftext|> is text"]
    rows = [(i * 3, t, next((n for n in LANGS if t and any(w in t for w in LANGS[n].split()[-2:])), None), "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], "en", None, 1), (None, None, None, None, None), (rows[8][0], "another text under a used id " * 12, "en", "src", 1)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
