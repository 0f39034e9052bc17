"""Near-duplicate vectors: recall against all pairs, components, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.forest import near_vectors

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(float)
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]):
                a, b = good[i], good[j]
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    return links


def components(rows, links):
    out, seen = {}, set()
    for k in links:
        if k not in seen:
            todo, own = [k], {k}
            while todo:
                new = links[todo.pop()] - own
                own |= new
                todo += new
            ids = [rows[i][0] for i in own if rows[i][0] is not None]
            for i in own:
                out[i] = min(ids) if ids else None
            seen |= own
    return out


def data(seed, n=1200, dim=64):
    rng = np.random.default_rng(seed)
    out, hot = [], rng.standard_normal(dim)
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and out:
            base = np.array(out[rng.integers(len(out))][1])
            v = base + rng.standard_normal(dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.choice([0.05, 0.3, 0.38, 0.5])
        elif kind < 0.5:
            v = hot + rng.standard_normal(dim) * 0.2
        else:
            v = rng.standard_normal(dim)
        out.append((i * 3 % n if n % 3 else i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if rng.random() < 0.7 else 0))
    return out


@pytest.mark.parametrize("settings", [{}, {"group": 150, "leaf": 40}])
def test_recall(spark, settings):
    rows = data(5)
    links = brute(rows)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, KIND).repartition(4), **settings).collect()}
    want = sum(map(len, links.values()))
    found = sum(got[rows[k][0]].n_links for k in links)
    assert found <= want and found >= 0.97 * want
    assert all(got[rows[k][0]].n_links <= len(links[k]) for k in links)
    comp = components(rows, links)
    assert np.mean([got[rows[k][0]].component_id == comp[k] for k in links]) > 0.97
    if not settings:
        again = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, KIND)).collect()}
        assert again == got


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [2.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1),
        (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [float("inf"), 0.0], 1),
        (None, [1e30, 1e29], 1), (0, [1e-30, 0.0], 2), (13, [-0.0, 5.0], 1), (13, [0.0, 5.0], 1),
    ]
    table = spark.createDataFrame(rows, KIND).select("*", *[F.lit("x").alias(c) for c in ("row", "cid", "dim", "raw", "LABEL", "size")])
    got = near_vectors(table).collect()
    links, comp = brute(rows), components(rows, brute(rows))
    want = sorted((str(rows[k][0]), len(links[k]), comp[k]) for k in links)
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors(spark.createDataFrame([], KIND)).count() == 0
