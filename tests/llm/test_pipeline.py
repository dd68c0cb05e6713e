"""The pipeline's stages on the fixture, each on its predecessor's output, against what they must keep."""

from collections import Counter

import pytest

import corpus_pipeline
from tarmac.llm import contain, kneser, lines
from tests.llm.test_exact import fingerprint, grouped


@pytest.fixture(scope="module")
def sf_dir(spark, docs, corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{at}/documents.parquet")
    ids = sorted({r[0] for r in corpus if r[0] is not None})
    spark.createDataFrame([(i, 1, 0) for i in ids if i % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    item = " ".join(corpus[20][1].split()[10:40])
    spark.createDataFrame([(1, item), (2, "not in any of the texts at all")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item


def test_stages(spark, sf_dir, corpus):
    path, item = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = corpus_pipeline.stored(stage(spark, docs, path))
        seen.append((name, before, docs.collect()))
    for _, _, after in seen[:-1]:
        assert set(after[0].asDict()) == set(corpus_pipeline.COLUMNS)
        assert all(r.n_chars == len(r.text) for r in seen[1][2])
    kept = kneser.classify(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).where("kept")
    assert Counter((r.doc_id, r.text) for r in seen[0][2]) == Counter((r.doc_id, r.text) for r in kept.collect())
    cut = {(r.doc_id, r.text) for r in lines.remove_lines(kept.select("doc_id", "text")).collect() if r.text.strip() or not r.n_lines_removed}
    assert {(r.doc_id, r.text) for r in seen[1][2]} == cut
    before = list({(r.doc_id, r.text) for r in seen[1][2]})
    groups = grouped([fingerprint(t) for _, t in before])
    assert len(seen[2][2]) == len(set(groups))
    place = dict(zip(before, groups, strict=True))
    assert len({place[(r.doc_id, r.text)] for r in seen[2][2]}) == len(seen[2][2])
    own = contain.shingles(item.encode().lower().split(), 5)
    share = lambda t: len(own & contain.shingles(t.encode().lower().split(), 5)) / len(own)
    assert Counter((r.doc_id, r.text) for r in seen[3][2]) == Counter((r.doc_id, r.text) for r in seen[2][2] if share(r.text) < 0.8)
    assert len(seen[3][2]) < len(seen[2][2])
    assert len(seen[4][2]) == len(seen[3][2])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, path).collect()) == Counter(r.doc_id for r in seen[4][2])
