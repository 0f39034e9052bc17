"""Line-level duplicates by pairwise alignment: what a later document repeats of an earlier one goes.

Overlapping documents are found through what they share: each repeated line, and each shortest run
of repeated lines that has enough characters to be deleted, points to the first document that holds
it. A document is compared with the documents that its rarest repeated lines and all its runs point
to, so every block that it repeats from an earlier document has a partner that holds the run through
each of its lines. Pairs are aligned with patience diff over the repeated lines; aligned blocks of
enough characters are deleted from the later document. A line opens one run and closes one, so a
document names at most three partners per line and copies of any number make no more pairs than that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.base import Scratch, numbered, pick, whole
from quire.llm.shingles import U, mix, powers

#: A line is rare in a document if it is at most so many times as frequent as the document's rarest repeated line.
#: Only rare lines name a partner by themselves; runs of ``MIN_CHARS`` do so at any frequency.
RARE = 8
#: Characters, line ends included, from which an aligned block is deleted.
MIN_CHARS = 100


def key() -> Column:
    """Order and identity of a document: doc_id (null last), then its text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of lines that both lists hold once, in an order that both share and that is as long as possible."""
    once = Counter(a)
    where = {h: i for i, h in enumerate(a) if once[h] == 1}
    count = Counter(b)
    pairs = [(where[h], j) for j, h in enumerate(b) if count[h] == 1 and h in where]
    tops, ends, back = [], [], []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        back.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [i], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_run(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of the longest run that both lists hold; of equally long ones one in the middle, so that the rest halves.

    The length is searched by bisection over hashes of all runs, so lists of one line repeated stay cheap.
    """
    number = {v: k for k, v in enumerate(dict.fromkeys(a))}
    if number.keys().isdisjoint(b):
        return []
    up, down = powers(max(len(a), len(b)) + 1)
    total = []
    for v in (a, b):
        total.append(np.zeros(len(v) + 1, np.uint64))
        np.cumsum(mix(np.array([number.get(x, len(a)) for x in v], np.uint64)) * up[: len(v)], out=total[-1][1:])
    runs = lambda n: [(t[n:] - t[: len(t) - n]) * down[: len(t) - n] for t in total]
    low, high = 1, min(len(a), len(b))
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if len(np.intersect1d(*runs(n))) else (low, n - 1)
    in_a, in_b = runs(low)
    js = np.flatnonzero(np.isin(in_b, in_a))
    j = int(js[len(js) // 2])
    starts = np.flatnonzero(in_a == in_b[j])
    i = int(starts[len(starts) // 2])
    return [(i + k, j + k) for k in range(low) if a[i + k] == b[j + k]]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: matched places of two lists, in order; between anchors the search is repeated.

    Where no line is unique on both sides, the longest common run is the anchor.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        i0, j0 = a0, b0
        found = [(a0 + i, b0 + j) for i, j in anchors(a[a0:a1], b[b0:b1]) or common_run(a[a0:a1], b[b0:b1])]
        for i, j in [*found, (a1, b1)] if found else []:
            todo.append((i0, i, j0, j))
            if i < a1 and j < b1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def blocks(a: list[tuple], b: list[tuple], min_chars: int) -> list[tuple[int, int]]:
    """(first line, last line) of ``b`` for the aligned blocks; both list (pos, hash, characters)."""
    out, run = [], []
    for i, j in [*align([x[1] for x in a], [x[1] for x in b]), (None, None)]:
        if run and (i is None or a[i][0] != a[run[-1][0]][0] + 1 or b[j][0] != b[run[-1][1]][0] + 1):
            if sum(b[y][2] + 1 for _, y in run) >= min_chars:
                out.append((b[run[0][1]][0], b[run[-1][1]][0]))
            run = []
        if i is not None:
            run.append((i, j))
    return out


def run_hashes(pos: np.ndarray, h: np.ndarray, chars: np.ndarray, ink: np.ndarray, doc: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shortest run of adjacent lines with ``min_chars``, from its first line and to its last.

    Any block that two documents share holds for each of its lines such a run with that line.
    """
    n = len(pos)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    part = np.cumsum(new)
    size, inked = (np.concatenate(([0], np.cumsum(v))) for v in (chars.astype(np.int64) + 1, ink.astype(np.int64)))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h.astype(np.int64).view(np.uint64)) * up[:n], out=total[1:])
    from_, to = np.arange(n), np.arange(1, n + 1)
    first = np.concatenate([from_, np.searchsorted(size, size[to] - min_chars, "right") - 1])
    end = np.concatenate([np.searchsorted(size, size[from_] + min_chars, "left"), to])
    ok = (first >= 0) & (end <= n)
    first, end = first[ok], end[ok]
    ok = (part[first] == part[end - 1]) & (inked[end] > inked[first])
    first, end = first[ok], end[ok]
    return doc[first], mix((total[end] - total[first]) * down[first], 3).view(np.int64)


def _runs(min_chars: int):
    """(k, lines) -> (r, k), once per document and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            pos, h, chars, ink = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            doc, r = np.unique(np.stack(run_hashes(pos, h, chars, ink, doc, min_chars), 1), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)), batch.column(0).take(pa.array(np.ascontiguousarray(doc)))], names=["r", "k"])

    return run


def _aligned(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    a, b = ([(v["pos"], v["h"], v["chars"]) for v in z] for z in (x, y))
                    made.append([{"first": f, "last": t} for f, t in blocks(a, b, min_chars)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, kind)], names=["k", "gone"])

    return run


def common_blocks(docs: DataFrame, *, rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k, gone, partners): per document with aligned blocks, the line ranges that repeat an earlier one.

    ``k`` is the document's key (doc_id, hash of its text). Lines are compared whole, as they are.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = pick(docs, "doc_id", "text").filter("text IS NOT NULL")
    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = own.select(key().alias("k"), line).select("k", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("chars"), F.length(F.trim("line")).alias("ink"))
    # documents and first document per line; both combine map-side, so common lines shrink first
    within = lines.groupBy("h", "k").agg(F.max("ink").alias("ink"))
    held = scratch.write(
        within.groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("ink").alias("ink")).filter("n > 1"), "held"
    )
    kept = lines.select("k", "pos", "h", "chars").join(held, "h")
    entry = F.struct("pos", "h", "chars", (F.col("ink") > 0).alias("inked"))
    points = F.when((F.col("ink") > 0) & (F.col("first") < F.col("k")), F.struct("n", "first"))
    listed = scratch.write(
        kept.groupBy("k").agg(F.array_sort(F.collect_set(entry)).alias("lines"), F.collect_set(points).alias("points")), "listed"
    )
    least = F.array_min(F.transform("points", lambda p: p["n"]))
    pairs = listed.filter(F.size("points") > 0).withColumn("least", least).select(
        "k", F.explode(F.array_distinct(F.transform(F.filter("points", lambda p: p["n"] <= rare * F.col("least")), lambda p: p["first"]))).alias("a")
    )
    # the first document of every run that is long enough to be deleted; combines map-side as well
    runs = numbered(listed.select("k", "lines")).mapInArrow(_runs(min_chars), "r long, k struct<none:boolean,id:long,text:long>")
    of_run = runs.groupBy("r").agg(F.min("k").alias("a"), F.max("k").alias("z")).filter(F.col("a") < F.col("z")).select("r", "a")
    by_run = runs.join(of_run.hint("merge"), "r").filter(F.col("a") < F.col("k")).select("k", "a")
    pairs = pairs.union(by_run).distinct()
    mine = listed.select(F.col("k").alias("b"), F.col("lines").alias("own"))
    theirs = listed.select(F.col("k").alias("a"), F.col("lines").alias("earlier"))
    both = pairs.withColumnRenamed("k", "b").join(theirs, "a").join(mine, "b").select("b", "earlier", "own")
    kind = "k struct<none:boolean,id:long,text:long>, gone array<struct<first:int,last:int>>"
    found = both.mapInArrow(_aligned(min_chars), kind).filter(F.size("gone") > 0)
    return scratch.write(found.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.count("*").alias("partners")), "gone")


def without_common_blocks(docs: DataFrame, *, rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_partners) for every row of ``docs(doc_id, text)``.

    ``text`` is what remains of the row's text, line by line. The document with the smaller doc_id
    is the earlier one (null last; of equal ids, the one whose text has the smaller hash); rows equal
    in doc_id and text count as one document and come out alike. A null text counts as empty and
    has no lines; blank lines bring no documents together. An empty table gives no rows.
    """
    found = common_blocks(docs, rare=rare, min_chars=min_chars)
    own = pick(docs, "doc_id", "text").select("doc_id", "text", key().alias("k"))
    lines = F.split(whole(), "\n", -1)
    stay = F.filter(lines, lambda line, i: ~F.exists("gone", lambda g: (g["first"] <= i) & (i <= g["last"])))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    # never broadcast: what was found grows with the documents, and texts move once at every size
    return own.join(found.hint("merge"), "k", "left").select(
        "doc_id", F.when(F.col("gone").isNull(), whole()).otherwise(F.array_join(stay, "\n")).alias("text"), n.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(n - F.size(stay)).cast("long").alias("n_removed"),
        F.coalesce("partners", F.lit(0)).cast("long").alias("n_partners"),
    )
