"""Language identification: accuracy on rows that were not learned from, edge cases."""

import zlib

import numpy as np
import pytest
from helpers import clashing, docs

from quire.llm.language import features, held_out, identify, train

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = identify(table.withColumn("held_out", held_out()), train(table)).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert len(out) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97


def corpus(spark):
    kinds = {"en": "the cat and the dog with them", "de": "die katze und der hund mit ihnen", "fr": "le chat et le chien avec eux", "qq": "жук жаба жар"}
    texts = [f"{t} {t[i % 7:]}" for i in range(60) for t in kinds.values()]
    return docs(spark, texts, langs=[c for _ in range(60) for c in kinds])


def test_edges(spark):
    model = train(clashing(corpus(spark)))
    odd = [None, "", "12 34 !", "the dog", "жаба", "und der hund " * 300_000, "\x00", "die katze"]
    out = {r.doc_id: r for r in identify(clashing(docs(spark, odd, langs=[None] * len(odd))), model).collect()}
    assert [out[i].lang_pred for i in range(len(odd))] == ["und", "und", "und", "en", "qq", "de", "und", "de"]
    assert out[0].score == 0.0
    again = train(corpus(spark))
    assert np.array_equal(again.top.weights, model.top.weights)
    assert identify(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("langs", [[None, None], ["en", "en"]])
def test_little_to_learn(spark, langs):
    table = docs(spark, ["abc", "abd"], langs=langs, ids=[0, 0])
    out = identify(table, train(table)).collect()
    want = "und" if langs[0] is None else "en"
    assert [r.lang_pred for r in out] == [want, want]
    assert train(docs(spark, [])) is None


def test_blocks_do_not_matter(monkeypatch):
    text = "Der Hund, die Katze 12 und das Pferd. " * 40
    whole, _ = features([text])
    monkeypatch.setattr("quire.llm.language.BLOCK", 97)
    parts, _ = features([text])
    assert np.allclose(whole, parts, atol=0.02)
