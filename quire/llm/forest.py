"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors of a label at the median along a random direction, again and again;
vectors near the boundary go to both sides. Neighbours that one tree separates meet in another.
The upper splits come from a bounded sample and deal the vectors out to groups of some thousands;
each group goes on splitting by itself until its leaves are small, or so tight that a split would
not part them. Within a leaf all pairs are compared in double precision and those below the
threshold are dropped; links are united to components.

Equal vectors of a label are one class and travel once per tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import Scratch, numbered, pick
from quire.operators.graphs import connected_components

COSINE = 0.93
TREES = 8
#: Vectors that the upper splits are made from, at most.
SAMPLE = 20_000
#: Vectors per group and tree that the upper splits aim at, and vectors that a leaf compares at most unless they are tight.
GROUP, LEAF = 4096, 192
#: Width of the overlap on either side of a split, in standard deviations of how far linked vectors lie apart along a direction.
SPILL = 0.8
#: A node is a leaf too if its larger side keeps more than this share.
TIGHT = 0.9
_ROWS = 512


def direction(dim: int, *place: int) -> np.ndarray:
    """The random direction of a node, the same wherever it is asked for."""
    return np.random.default_rng([7, *(p % 2**63 for p in place)]).standard_normal(dim) / np.sqrt(dim)


def overlap(cosine: float, dim: int) -> float:
    """Half the width of the overlap along a ``direction`` of that many dimensions."""
    return SPILL * np.sqrt(2 * (1 - cosine)) / np.sqrt(dim)


def unit(raw: list, kind: str, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def split(x: np.ndarray, rows: np.ndarray, place: tuple[int, ...], margin: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Both sides of a node and its boundary; None if the split would not part enough."""
    along = x[rows] @ direction(x.shape[1], *place)
    middle = float(np.median(along))
    low, high = rows[along <= middle + margin], rows[along >= middle - margin]
    return None if max(len(low), len(high)) > TIGHT * len(rows) else (low, high, middle)


def upper_splits(x: np.ndarray, labels: np.ndarray, scale: float, cosine: float, trees: int, group: int) -> dict:
    """{(label, tree): {node: boundary}} from a sample of which each row stands for ``scale`` rows."""
    out, margin = {}, overlap(cosine, x.shape[1])
    for label in np.unique(labels).tolist():
        mine = np.flatnonzero(labels == label)
        for tree in range(trees):
            todo, nodes = [(1, mine)], {}
            while todo:
                node, rows = todo.pop()
                sides = split(x, rows, (tree, node), margin) if len(rows) * scale > group and len(rows) >= 16 else None
                if sides:
                    nodes[node] = sides[2]
                    todo += [(2 * node, sides[0]), (2 * node + 1, sides[1])]
            if nodes:
                out[label, tree] = nodes
    return out


def _groups(x: np.ndarray, nodes: dict, tree: int, margin: float) -> list[tuple[int, np.ndarray]]:
    """(node, rows) of the groups that the upper splits of one tree deal some rows out to."""
    todo, out = [(1, np.arange(len(x)))], []
    while todo:
        node, rows = todo.pop()
        if node in nodes and len(rows):
            along = x[rows] @ direction(x.shape[1], tree, node)
            todo += [(2 * node, rows[along <= nodes[node] + margin]), (2 * node + 1, rows[along >= nodes[node] - margin])]
        elif len(rows):
            out.append((node, rows))
    return out


def _deal(packed: bytes, kind: str, cosine: float, trees: int, buckets: int):
    """(cid, label, dim, raw) -> the same with tree, node and bucket, once per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for batch in batches:
            labels, dims = (batch.column(k).to_numpy() for k in (1, 2))
            raw = [v.as_buffer().to_pybytes() for v in batch.column(3)]
            rows, tree_of, node_of = [], [], []
            for label, dim in set(zip(labels.tolist(), dims.tolist())):
                mine = np.flatnonzero((labels == label) & (dims == dim))
                x = unit([raw[i] for i in mine], kind, dim)
                for tree in range(trees):
                    for node, own in _groups(x, model.get((label, dim, tree), {}), tree, overlap(cosine, dim)):
                        rows.append(mine[own])
                        tree_of.append(np.full(len(own), tree))
                        node_of.append(np.full(len(own), node))
            if not rows:
                continue
            rows, tree_of, node_of = map(np.concatenate, (rows, tree_of, node_of))
            h = (labels[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (tree_of * 2**40 + node_of).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(tree_of.astype(np.int32)), pa.array(node_of.astype(np.int64)), *taken.columns],
                names=["bucket", "tree", "node", "cid", "label", "dim", "raw"],
            )

    return run


def leaves(x: np.ndarray, place: tuple[int, ...], margin: float, leaf: int) -> Iterator[np.ndarray]:
    """Rows of each leaf of a group that goes on splitting."""
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        sides = split(x, rows, (*place, node), margin) if len(rows) > leaf else None
        if sides:
            todo += [(2 * node, sides[0]), (2 * node + 1, sides[1])]
        else:
            yield rows


def linked(x: np.ndarray, rows: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at or above the threshold, block by block."""
    for a in range(0, len(rows), _ROWS):
        for b in range(a, len(rows), _ROWS):
            i, j = np.nonzero(x[rows[a : a + _ROWS]] @ x[rows[b : b + _ROWS]].T >= cosine)
            i, j = i + a, j + b
            ok = i < j
            yield rows[i[ok]], rows[j[ok]]


def _compare(kind: str, cosine: float, leaf: int):
    def run(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("tree", "node", "cid", "label", "dim")}
        raw = group.column("raw").combine_chunks()
        order = np.lexsort((cols["node"], cols["tree"], cols["dim"], cols["label"]))
        key = np.stack([cols[c][order] for c in ("label", "dim", "tree", "node")], 1)
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(heads, [*heads[1:], len(order)]):
            label, dim, tree, node = key[a].tolist()
            if b - a < 2 or (tree and node == 1 and b - a <= leaf):
                continue  # such a group is one leaf, and the first tree's is the same
            own = order[a:b]
            x = unit([raw[i].as_buffer().to_pybytes() for i in own.tolist()], kind, dim)
            for rows in leaves(x, (tree, node), overlap(cosine, dim), leaf):
                for i, j in linked(x, rows, cosine):
                    p, q = cols["cid"][own[i]], cols["cid"][own[j]]
                    found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_vectors(
    vectors: DataFrame, *, cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE, group: int = GROUP, leaf: int = LEAF
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and their cosine is ``cosine`` or more. Vectors that are
    null, empty, zero or hold null or non-finite numbers, and rows without a label, link with
    nothing; vectors of different length never link. Every pair that is found is verified; pairs
    within a leaf are found surely, others with high probability (measured in the tests), and equal
    vectors always. ``component_id`` is the smallest vec_id that links reach. Repeated rows are
    rows of their own; among null vec_ids there is no smallest, so it is null only if all are.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    own = pick(vectors, "vec_id", "embedding", "label")
    kind = "<f4" if own.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    own = own.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                     F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"), F.xxhash64("label").alias("label"), F.col("label").isNull().alias("bare"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws = [], []
            for v, bare in zip(batch.column(2), batch.column(4).to_pylist()):
                x = None if bare or not v.is_valid or not len(v) or v.values.null_count else v.values.to_numpy().astype(kind)
                good = x is not None and np.isfinite(x).all() and x.any()
                dims.append(len(x) if good else 0)
                raws.append((x + 0).tobytes() if good else b"")  # minus zero becomes zero
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["row", "vec_id", "label", "dim", "raw"])

    rows = scratch.write(numbered(own).mapInArrow(describe, "row long, vec_id long, label long, dim int, raw binary"), "rows")
    classes = rows.filter("dim > 0").groupBy("label", "dim", "raw").agg(F.min("row").alias("cid"), F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = scratch.write(classes, "classes")
    n = classes.count()
    share = min(1.0, sample / max(n, 1))
    drawn = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(2**40)) < F.lit(int(share * 2**40))).select("label", "dim", "raw").limit(2 * sample).toArrow()
    model = {}
    for dim in set(drawn["dim"].to_pylist()):
        mine = drawn.filter(pa.compute.equal(drawn["dim"], dim))
        x = unit(mine["raw"].to_pylist(), kind, dim)
        for (label, tree), nodes in upper_splits(x, mine["label"].to_numpy(), 1 / share, cosine, trees, group).items():
            model[label, dim, tree] = nodes
    buckets = max(8, n * trees // (2 * group) + 1)
    dealt = numbered(classes.select("cid", "label", "dim", "raw")).mapInArrow(
        _deal(pickle.dumps(model), kind, cosine, trees, buckets), "bucket int, tree int, node long, cid long, label long, dim int, raw binary"
    )
    links = scratch.write(dealt.groupBy("bucket").applyInArrow(_compare(kind, cosine, leaf), "a long, b long").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("cid").alias("b"), "size")
    degree = both.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("others"))
    comp = connected_components(links, "a", "b").select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    state = scratch.write(
        classes.join(comp, "cid", "left").join(degree, F.col("cid") == F.col("a"), "left")
        .select("label", "dim", "raw", "least", "size", F.coalesce("comp", "cid").alias("comp"), F.coalesce("others", F.lit(0)).alias("others")), "state"
    )
    least = state.groupBy("comp").agg(F.min("least").alias("component"))
    named = state.join(least, "comp").select("label", "dim", "raw", (F.col("size") - 1 + F.col("others")).alias("n"), "component")
    out = rows.join(named, ["label", "dim", "raw"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )


#: All pairs; the forest finds the same links where its recall is complete.
NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN d ON d.a = e.vec_id
"""
