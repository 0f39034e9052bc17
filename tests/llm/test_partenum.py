"""Similarity join: signatures by their guarantee, components against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from helpers import clashing, docs

import quire.llm.partenum as pe
from quire.llm.partenum import differences, signatures, similar_documents
from quire.llm.shingles import shingle_set, word_hashes


def brute(texts, ids, words=3, percent=90):
    sets = []
    for t in texts:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(texts)))


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ÀB", "Aa"]
    out = [None, "", " \t\n", "a", "A", "a b", "a B", "a\tb c", "x " * 5000, "x " * 4000]
    while len(out) < n:
        base = rng.choices(vocab, k=rng.choice([3, 9, 12, 13, 14, 25, 60, 150, 400]))
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3)])
def test_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pe, "BLOCK", block)
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    got = similar_documents(clashing(docs(spark, texts, ids=ids)), bucket=2000)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(texts, ids)


def test_repeats_and_empty(spark):
    got = similar_documents(docs(spark, ["a b c d", "a b c d", "a b c d", None, None], ids=[3, 3, None, 7, None])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [
        ("3", 2, "3"), ("3", 2, "3"), ("7", 0, "7"), ("None", 0, "None"), ("None", 2, "3")]
    assert similar_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("size", [1, 5, 9, 10, 19, 40, 77, 150, 600, 3000])
def test_similar_sets_share_a_signature(size, percent):
    rng = np.random.default_rng(size)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, size, np.uint64))
        k = rng.integers(0, differences(int(size * 100 / percent) + 1, percent) + 1)
        drop = rng.integers(0, k + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, k - drop, np.uint64))))
        inner = len(np.intersect1d(a, b))
        if len(b) and 100 * inner >= percent * (len(a) + len(b) - inner):
            assert len(np.intersect1d(signatures(a, percent), signatures(b, percent)))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (900, 1000, 1030, 4000)]
    sets += [np.unique(np.concatenate((s[40:], rng.integers(0, 2**64, 60, np.uint64)))) for s in sets]
    for a in sets:
        for b in sets:
            x, y = pd.Series([pe.sketch(a)]), pd.Series([pe.sketch(b)])
            apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
            assert pe._distance(x, y)[0] <= apart and (pe._distance(x, y)[0] + apart) % 2 == 0


def test_words():
    assert len(word_hashes(" a  bc\x0bd\x85e ")) == 3
    assert list(word_hashes("xa Bc")) == list(word_hashes("  xa\n bC"))
    assert word_hashes("abc abc")[0] == word_hashes("zz abc")[1]
    assert len(shingle_set("a b c d a b c", 3)) == 4
