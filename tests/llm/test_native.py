"""Exact duplicates and mixing: brute force, edge cases."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from helpers import clashing, docs, rows
from pyspark.sql import functions as F

from quire.llm.exact_dedup import exact_duplicates
from quire.llm.mixing import mix, targets

LONG = " ".join(f"word{i}y and" for i in range(3000))
TEXTS = ["a b", "a  b", "a\tb", "", None, "a b", LONG, LONG + " x", LONG, " a b", "é ퟿", "   ", " "]


def same_texts(ids, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    by = defaultdict(list)
    for i, t in zip(ids, norm):
        by[t].append(i)
    return sorted(
        ((i, min(by[t]), len(by[t]), i == min(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, norm)), key=repr
    )


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    # with the length as fingerprint, many contents share one and must be told apart
    kind = {"fingerprint": lambda c: F.length(c).cast("long")} if weak else {}
    texts = TEXTS + ["b a", "c a", "b a"]
    got = rows(exact_duplicates(clashing(docs(spark, texts)), **kind), *COLS)
    assert got == same_texts(range(len(texts)), texts)


def test_exact_repeats_and_empty(spark):
    got = exact_duplicates(docs(spark, ["x", "x", "x", "y"], ids=[5, 5, None, None]))
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got.filter("text_sha256 = sha2('x', 256)").collect()) == [
        (5, 3, False), (5, 3, False), (5, 3, True)]
    assert got.filter("doc_id is null and kept").count() == 1
    assert exact_duplicates(docs(spark, [])).count() == 0


def water(sizes, weights, most=3):
    """Shares reshared step by step until none is above its limit."""
    total, out = sum(sizes), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 5, 0], [7], [3, 900, 2, 40, 40, 1]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i}" if i else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in targets(table).collect()}
    order = [*range(1, len(sizes)), 0]  # null comes last
    want = water([sizes[i] for i in order], [1 + k % 3 for k in range(len(sizes))])
    for i, t in zip(order, want):
        assert math.isclose(got[f"s{i}" if i else None], t, abs_tol=1e-6)


def test_mix(spark):
    texts = [" ".join(["w"] * (1 + i * 7 % 40)) for i in range(300)] + [None, "", "  ", LONG]
    src = ["big" if i % 3 else f"s{i % 4}" for i in range(300)] + [None, None, "s1", None]
    df = docs(spark, texts, sources=src)
    out = mix(clashing(df)).collect()
    assert len(out) == len(texts) and [tuple(r) for r in sorted(out)] == [tuple(r) for r in sorted(mix(clashing(df)).collect())]
    sums = defaultdict(int)
    for r in out:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 3 * r.size
        sums[r.source] += r.taken
    for r in out:
        assert abs(sums[r.source] - r.target) <= 1
    for r in mix(df, whole_documents=True).collect():
        assert r.size == 0 or r.taken % r.size == 0
    assert mix(docs(spark, [])).count() == 0
    assert mix(docs(spark, ["a b", "a b", "a b"], ids=[1, 1, None])).count() == 3
