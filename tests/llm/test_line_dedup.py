"""Line dedup: alignment against its definition, documents against a plain version."""

import random
from collections import defaultdict

from helpers import clashing, docs
from pyspark.sql import functions as F

from quire.llm.line_dedup import MIN_CHARS, align, blocks, without_common_blocks


def test_align():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 15))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 15))]
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert align(a, a) == [(i, i) for i in range(len(a))]
    assert align([1, 2, 3, 4, 5], [9, 2, 3, 7, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert align([1, 2, 3], [3, 1, 2]) == [(0, 1), (1, 2)]


def plain(texts):
    """Each document aligned with every earlier one, over the lines that several documents hold."""
    lines = [None if t is None else t.split("\n") for t in texts]
    where = defaultdict(set)
    for d, ls in enumerate(lines):
        for x in ls or []:
            where[x].add(d)
    own = [[(p, x, len(x)) for p, x in enumerate(ls or []) if len(where[x]) > 1] for ls in lines]
    out = {}
    for d, ls in enumerate(lines):
        gone = {p for a in range(d) for first, last in blocks(own[a], own[d], MIN_CHARS) for p in range(first, last + 1)}
        out[d] = ("\n".join(x for p, x in enumerate(ls or []) if p not in gone), len(ls or []), len(gone))
    return out


def corpus():
    rng = random.Random(7)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 40))) for _ in range(150)] + ["", " ", "Share this page"]
    out = [None, "", "\n\n", "one"]
    for _ in range(120):
        ls = rng.choices(pool, k=rng.randint(1, 12)) + [f"own {rng.random()}"]
        if out and rng.random() < 0.6:
            src = (rng.choice(out) or "").split("\n")
            at = rng.randrange(len(src))
            ls[rng.randrange(len(ls)) :][:0] = src[at : at + 9]
            ls = ls[:4] + src[at : at + 9] + ls[4:]
        out.append("\n".join(ls))
    return out + [out[20]] * 30


def test_documents(spark):
    texts = corpus()
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in without_common_blocks(clashing(docs(spark, texts))).collect()}
    want = plain(texts)
    assert got == want
    assert sum(x[2] for x in want.values()) > 100


def test_edges(spark):
    text = "\n".join(f"line number {i} of a text" for i in range(12))
    got = without_common_blocks(docs(spark, [text, text, text, None], ids=[5, 5, None, None]))
    assert got.filter("doc_id = 5 and n_removed = 0").count() == 2 and got.filter("doc_id is null and n_removed = 12 and text = ''").count() == 1
    assert without_common_blocks(docs(spark, [])).count() == 0
    long = "\n".join(f"row {i}" for i in range(60_000))
    assert without_common_blocks(docs(spark, [long, "x\n" + long])).agg(F.sum("n_removed")).first()[0] == 60_000
