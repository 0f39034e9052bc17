"""Vector codes against plain loops over all entries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.codes import Slices, bounds, compressed, reconstructed, report

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(4096 * x)) for x in r[1]]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    q = [[int(np.floor(4096 * x)) for x in r[1]] for r in kept]
    cut = bounds(len(q[0]), parts)
    books = [[v[a:b] for v in q[:entries]] for a, b in zip(cut, cut[1:])]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            own = [near(v[a:b], books[p])[1] for v in q]
            for e in range(len(books[p])):
                mine = [v[a:b] for v, o in zip(q, own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for r, v in zip(kept, q):
        best = [near(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
        error = sum(d for d, _ in best)
        total[r[2]] = total.get(r[2], 0) + error
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), error, r[2]))
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in report(df).collect()), key=repr)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(int(i), (centres[i % 5] + rng.normal(scale=0.3, size=dim)).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[7][1], None), (None, rows[8][1], 2)]
    rows += [(-9, None, 1), (-8, [None] * dim, 1), (-7, [float("nan")] * dim, 1), (-6, [float("inf")] + [0.0] * (dim - 1), 1)]
    return rows + [(1000, [0.1] * (dim + 1), 1), (1001, [], 1)]


@pytest.mark.parametrize("n, dim", [(120, 16), (40, 8), (9, 24), (60, 11)])
def test_against_plain(spark, n, dim):
    rows = vectors(n, dim, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    names = ("q", "part", "entry", "codes", "error", "of", "Label")
    assert found(df.select("*", *[F.lit("x").alias(c) for c in names])) == plain(rows)


def test_slices_are_exact():
    rng = np.random.default_rng(5)
    for k, w, top in ((1, 3, 9), (16, 8, 40), (64, 4, 6), (16, 1, 5), (7, 5, 2**27)):
        s = Slices(rng.integers(-top, top, (k, w)))
        x = rng.integers(-top, top, (500, w))
        d = ((x[:, None, :] - s.entries[None]) ** 2).sum(2)
        entry, least = s.nearest(x)
        assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()
        mask = s.candidates(x)
        assert ((mask >> entry.astype(np.uint64)) & np.uint64(1)).all()
    # near their entries, vectors have few candidates
    s = Slices(rng.integers(-4000, 4000, (16, 8)))
    close = np.repeat(s.entries, 20, 0) + rng.integers(-300, 300, (320, 8))
    assert np.bitwise_count(s.candidates(close)).mean() < 4


def test_edges(spark):
    assert report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert report(spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA)).count() == 0
    empty = report(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in empty) == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    huge = compressed(spark.createDataFrame([(i, [1e300, -1e300, 0.0, float(i)] * 4, 1) for i in range(20)], SCHEMA))[0]
    assert huge.count() == 20
    with pytest.raises(ValueError):
        compressed(spark.createDataFrame([], SCHEMA), entries=65)


def test_reconstruction(spark):
    rows = [(i, [float(i % 4), 0.5, -1.0, 2.0] * 4, 1) for i in range(50)]
    coded, books = compressed(spark.createDataFrame(rows, SCHEMA))
    got = {r.vec_id: r.vector for r in reconstructed(coded, books).collect()}
    assert {i: v for i, v, _ in rows} == got and coded.filter("error <> 0").count() == 0
