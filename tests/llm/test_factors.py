"""Repeated passages against a plain count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, docs

from quire.llm.factors import WORDS, Block, factors, parsed, without_repeated_passages


def words_of(text):
    return (text or "").encode().split()


def plain(texts, words=WORDS):
    own = [words_of(t) for t in texts]
    count = Counter(tuple(w[i : i + words]) for w in own for i in range(len(w) - words + 1))
    out = []
    for w in own:
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if count[tuple(w[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        out.append((b" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "Word", "word", "中", "x" * 40]
    some = lambda n: rng.choice([" ", "  ", "\n", "\t "]).join(rng.choices(vocabulary, k=n))
    shared = [some(rng.choice([20, 34, 35, 36, 50, 70, 200])) for _ in range(14)]
    out = [None, "", " \n ", "a " * 34, "a " * 35, "a " * 36, "one two " * 60, "b " * 34 + "é"]
    for _ in range(150):
        out.append(" ".join(rng.choice([some(rng.randint(1, 60)), rng.choice(shared), " ".join(rng.choice(shared).split()[3:-4])]) for _ in range(rng.randint(1, 7))))
    for _ in range(40):  # near copies
        t = " ".join(out[20:24]).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        out.append(" ".join(t))
    return out + [out[30]] * 5


@pytest.mark.parametrize("passes, block, window_range", [(3, 3000, 500), (1, 10**7, 10**6)])
def test_documents(spark, passes, block, window_range):
    texts = corpus(passes)
    got = without_repeated_passages(clashing(docs(spark, texts)), passes=passes, block=block, window_range=window_range).collect()
    want = dict(enumerate(plain(texts)))
    assert {r.doc_id: (bytes(r.kept), r.n_words, r.n_removed) for r in got} == want and len(got) == len(texts)
    assert all(sum(s.n for s in r.spans) == r.n_removed for r in got)
    assert 2000 < sum(w[2] for w in want.values()) < sum(w[1] for w in want.values()) - 1000


def test_factors_are_where_they_say(spark):
    texts = corpus(9)
    seen = 0
    for r in factors(docs(spark, texts), block=4000).collect():
        for start, n, of, at in zip(r.starts, r.sizes, r.of, r.ats):
            a, b = words_of(texts[r.id]), words_of(texts[of])
            assert a[start : start + n + WORDS - 1] == b[at : at + n + WORDS - 1] and len(a) >= start + n + WORDS - 1
            assert (r.id, start) != (of, at)
            seen += n
    assert seen > 1000


def test_greedy_factors():
    i = lambda *x: np.array(x, np.int32)
    got = parsed(i(1, 1, 1, 1, 2), i(5, 4, 6, 7, 8), i(0, 0, 0, 3, 3), i(11, 10, 12, 2, 3))
    assert got.tolist() == [(1, 4, 3, 0, 10), (1, 7, 1, 3, 2), (2, 8, 1, 3, 3)]


def test_blocks_know_their_documents():
    texts = ["", "a b", " c", "", "d\te f ", ""]
    b = Block([t.encode() for t in texts])
    assert b.doc.tolist() == [1, 1, 2, 4, 4, 4] and b.pos.tolist() == [0, 1, 0, 0, 1, 2]
    one, two = Block([b"x y z"]), Block([b"q x", b"x  y\nz"])
    assert (one.words == two.words[2:]).all() and one.words[0] == two.words[1]


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = text + " tail"
    got = without_repeated_passages(docs(spark, [text, text, other, text, None], ids=[5, 5, 5, None, None])).collect()
    assert sorted((r.doc_id or -1, bytes(r.kept), r.n_removed) for r in got) == [(-1, b"", 0), (-1, b"", 80), (5, b"", 80), (5, b"", 80), (5, b"tail", 80)]
    alone = without_repeated_passages(docs(spark, [text, None, None], ids=[1, None, None])).collect()
    assert sorted(r.n_removed for r in alone) == [0, 0, 0]
    for tasks in (1, 4):  # rows that repeat as a whole, in one task or in several
        twice = docs(spark, [text, text], ids=[1, 1]).coalesce(1).repartition(tasks)
        assert [r.n_removed for r in without_repeated_passages(twice).collect()] == [80, 80]
    assert without_repeated_passages(docs(spark, [])).count() == 0
    long = " ".join(f"v{i}" for i in range(400_000))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in without_repeated_passages(docs(spark, [long, "x " + text + " " + long[:2_000]])).collect()}
    assert got[0][0] == 400_000 and got[0][1] == got[1][1] == len(long[:2_000].rsplit(" ", 1)[0].split())
    with pytest.raises(ValueError):
        factors(docs(spark, []), words=5)
