"""The pipeline's stages on a small corpus, each against a plain version of what it must leave."""

import random
import re
from collections import Counter

import corpus_pipeline as pipeline
import pytest

from test_operators import plain_groups, plain_spans, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(160):
        text, bad = "\n".join(prose(rng, 20) for _ in range(3)), i % 5 == 0
        if bad:
            text += "\n" + " ".join(w + "###" for w in prose(rng, 150).split())
        if i % 7 == 3 and i > 20:
            text = docs[i - 20][1].replace("the", "the", 1) + " tail"
        if i % 11 == 2:
            text += ' token = "a1b2c3d4e5f6"'
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int("###" not in text), 0))
    docs += [(900, None, None, None, None), (901, "", "en", None, 0), docs[8]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, {i: q for i, q, _ in labels}


def test_stages(spark, corpus, tmp_path):
    at, docs, good = corpus
    df = spark.read.parquet(f"{at}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        res = stage(spark, df, at)
        if name != "packing":
            assert res.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        res.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = df.collect()
    first, second, third, fourth, last = (out[n] for n, _ in pipeline.STAGES)
    assert {r.doc_id for r in first} == {i for i, q in good.items() if q}
    groups = plain_groups([(r.doc_id, r.text) for r in first], 5, 80, 100)
    assert sorted(r.doc_id for r in second) == sorted(i for i, (_, c) in groups.items() if c == i) and len(second) < len({r.doc_id for r in first})
    before = {r.doc_id: r.text for r in second}
    assert len(third) == len(second)
    for r in third:
        assert (r.text == before[r.doc_id]) == (not plain_spans(before[r.doc_id])) and "a1b2c3" not in r.text and r.n_chars == len(r.text)
    text = {r.doc_id: r.text for r in third}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(text[r.doc_id].startswith(r.text) for r in fourth) and max(Counter(r.doc_id for r in fourth).values()) <= 3
    assert abs(sum(size(r.text) for r in fourth) - sum(size(t) for t in text.values())) <= 3
    assert sum(r.doc_tokens for r in last if r.start == 0) == sum(r.length for r in last) and {r.doc_id for r in last} == {r.doc_id for r in fourth}
    assert pipeline.run(spark, at).count() > 0
