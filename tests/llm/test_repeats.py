"""Repeated strings against a plain dictionary of all strings."""

import hashlib
import random

import numpy as np
from helpers import clashing, docs
from pyspark.sql import functions as F

from quire.llm.repeats import LENGTH, _merge, _minus, without_repeats
from quire.llm.suffixes import COVER, PERIOD, Block


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def plain(texts, order):
    seen, out = set(), {}
    for d in order:
        raw = (texts[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            s = raw[i : i + LENGTH]
            if s in seen:
                gone[i : i + LENGTH] = True
            seen.add(s)
        runs = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdeé ", k=n))
    shared = [word(rng.choice([60, 99, 100, 101, 150, 300, 1000])) for _ in range(12)]
    out = [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, "x" * 350]
    for _ in range(120):
        out.append("".join(rng.choice([word(rng.randint(0, 120)), rng.choice(shared), rng.choice(shared)[7:-9]]) for _ in range(rng.randint(1, 7))))
    for _ in range(25):  # near copies
        t = list(out[10] + out[11] + shared[11])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 2)] = list(word(rng.randint(0, 3)))
        out.append("".join(t))
    return out + [out[9]] * 6


def test_documents(spark):
    texts = corpus(1)
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    want = plain(texts, sorted(range(len(texts)), key=ids.__getitem__))
    got = without_repeats(clashing(docs(spark, texts, ids=ids)), bucket=3000)
    rows = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {ids[d]: w for d, w in want.items()}
    assert sum(w[1] for w in want.values()) > 20_000


def test_edges(spark):
    text = "".join(random.Random(3).choices("abcdefgh ", k=400))
    got = without_repeats(docs(spark, [text, text, text, None], ids=[5, 5, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in got) == [("5", 0, 0), ("5", 0, 0), ("None", 0, 0), ("None", 400, 1)]
    assert without_repeats(docs(spark, [])).count() == 0
    long = "".join(random.Random(4).choices("abcdefgh ", k=300_000))
    assert {r.doc_id: r.n_removed for r in without_repeats(docs(spark, [long, long[1000:]])).collect()} == {0: 0, 1: 299_000}


def test_repeated_rows_in_one_task(spark):
    rng = random.Random(5)
    text, other, passage = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(3))
    texts, ids = [text, text, text, None, other, other, passage + other, passage, passage], [5, 5, None, None, None, None, 9, 3, 3]
    want = [("3", 0), ("3", 0), ("5", 0), ("5", 0), ("9", 400), ("None", 0), ("None", 400), ("None", 400), ("None", 400)]
    for table in (docs(spark, texts, ids=ids).coalesce(1), docs(spark, texts, ids=ids).repartition(9)):
        assert sorted((str(r.doc_id), r.n_removed) for r in without_repeats(table).collect()) == want


def test_block_reads_what_is_there():
    texts = [b"a" * 100, b"", bytes(range(250)) * 3, b"z" * 150]
    block = Block(texts, 100)
    doc, place, name = block.samples()
    assert {(d, p) for d, p in zip(doc.tolist(), place.tolist())} == {
        (d, p) for d, t in enumerate(texts) for p in range(len(t)) if p % PERIOD in COVER and p + 28 <= len(t) and len(t) >= 100}
    assert len({n for d, p, n in zip(doc, place, name) if d == 0}) == 1


def test_ranges():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (sorted((lambda x: (x, x + rng.randint(0, 6)))(rng.randint(0, 60)) for _ in range(rng.randint(0, 6))) for _ in "ab")
        ranges = [_merge(*(np.array([r[k] for r in x], np.int32) for k in (0, 1))) for x in (a, b)]
        got = {i for f, t in _minus(*ranges).tolist() for i in range(f, t + 1)}
        cells = [{i for f, t in x for i in range(f, t + 1)} for x in (a, b)]
        assert got == cells[0] - cells[1]
