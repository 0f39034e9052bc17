"""Merkle manifest against a plain tree, at several fanouts and block depths."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import DOCS, clashing, docs
from pyspark.sql import functions as F

from quire.llm.merkle import audited, fold, manifest, proof


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    doc_id, text, lang, source, n = r
    n = None if n is None else n + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def tree(level, fanout):
    """(root, path of each leaf)."""
    paths, where = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for p, at in zip(paths, where):
            run = range(at // fanout * fanout, min(len(level), at // fanout * fanout + fanout))
            p.append(("".join(level[i] for i in run if i < at), "".join(level[i] for i in run if i > at)))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        where = [at // fanout for at in where]
    return level[0], paths


def folded(start, path):
    for left, right in path:
        start = h(left, start, right)
    return start


def plain(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, roots, paths = [], [], {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths[g] = tree([leaf(r) for r in groups[g]], fanout)
        roots.append(root)
    top, ups = tree(roots, fanout)
    for g, sub, up in zip(names, roots, ups):
        for r, path in zip(groups[g], paths[g]):
            start = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            end = folded(start, path + up)
            out.append((r[0], leaf(r), sub, top, h(*[a + b for a, b in path + up]), end, end == top))
    return sorted(out, key=repr)


def found(df, **how):
    got = audited(df, **how).withColumn("path", proof(F.col("path")))
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "path", "folded_root", "verified").collect()), key=repr)


def table(seed, n):
    rng = random.Random(seed)
    langs = ["en"] * 12 + ["de", "é", "zh", None, "", "a", "only"]
    rows = [(rng.choice([None, rng.randrange(10**6)]) if rng.random() < 0.2 else i, rng.choice([None, "", f"text {i} é", "same"]), rng.choice(langs[:-1]), rng.choice([None, "", "s:1", "s"]), rng.choice([None, 0, 12, 2**63 - 1])) for i in range(n)]
    return rows + rows[:9] + rows[:1] * 5 + [(7, "x", "only", "s", 1)]


@pytest.mark.parametrize("fanout, depth", [(2, 3), (16, 1)])
def test_against_plain(spark, fanout, depth):
    rows = table(fanout, 220)
    assert found(clashing(spark.createDataFrame(rows, DOCS)).repartition(5), fanout=fanout, depth=depth) == plain(rows, fanout)


def test_edges(spark):
    assert audited(docs(spark, [])).count() == 0
    one = found(docs(spark, ["x" * 3_000_000]))
    assert one == plain([(0, "x" * 3_000_000, "en", "s0", 3_000_000)], 2) and one[0][2] == one[0][1] == one[0][3]
    with pytest.raises(ValueError):
        manifest(docs(spark, ["a"]), fanout=1)


def test_tampering_is_seen(spark):
    got = audited(docs(spark, [f"t {i}" for i in range(300)])).cache()
    bad = {r[0] for r in got.filter("not verified").collect()}
    assert bad == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0} and 20 < len(bad) < 80
    # any other leaf with a row's siblings fails too
    assert got.filter(fold(F.sha2(F.lit("other").cast("binary"), 256), F.col("path")) == F.col("root")).count() == 0
