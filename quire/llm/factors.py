"""Repeated passages by relative Lempel-Ziv factors: every document is parsed against the whole corpus.

The reference is the corpus itself, in blocks. A block's index holds, in the order of their
fingerprints, all windows of 35 words that start in it. Parsing goes greedily: a factor begins at a
word whose window the index holds elsewhere, and goes on as long as the next window follows in the
same reference; there the parse looks the next window up again (*the factor boundary*, where a
repeated window may lie across two factors), so no repeated window is missed. Factors have at least
35 words; the words they cover are the duplicate spans.

A task first parses documents against its own block of a few MB. What has no other place there
goes on to the blocks of everyone else, whose indexes are merged by ranges of fingerprints; of
equal windows a task sends the first only, so neither a frequent passage nor a group of copies
fills a range, however many documents hold it. The corpus is parsed in passes: a window belongs to
the pass of the least word run inside it, so neighbouring windows mostly share a pass, and each
pass returns whole factors instead of single windows. A pass moves a fixed share of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import Scratch, pick, whole
from quire.llm.shingles import _BYTE, _SPACE, U, mix, powers

#: Words of a window; words of the runs whose least decides on the pass.
WORDS, RUN = 35, 12
#: Passes over the text, windows that a range holds on average, and bytes of text that a task indexes at once.
PASSES, RANGE, BLOCK = 5, 1_000_000, 8_000_000
#: Bytes of text that are hashed at once.
PIECE = 500_000
#: Ranges by document in which factors meet hold so many bytes of text on average.
DOC_BYTES = 16_000_000
LAST = 2**63 - 1
#: Of a window that its block holds again, ``pos`` is inverted.
ITEM = np.dtype([("key", "<u8"), ("more", "<u4"), ("doc", "<u4"), ("pos", "<i4")])
FACTOR = np.dtype([("doc", "<u4"), ("pos", "<i4"), ("n", "<i4"), ("of", "<u4"), ("at", "<i4")])
DOC = np.dtype([("id", "<i8"), ("text", "<i8")])
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("items", pa.binary())])
SCHEMA = "bucket int, kind int, docs binary, items binary"
#: Kinds of rows: windows to be looked up, and factors that are known.
LOOK, KNOWN = 0, 1


class Block:
    """Words of many documents in one row of hashes, with the documents they belong to."""

    def __init__(self, texts: list) -> None:
        """``texts``: buffers of UTF-8 bytes."""
        parts, own, at = [], [], 0
        while at < len(texts):
            # so many documents at a time that what hashing needs for each byte stays small
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) < PIECE):
                held += len(texts[to]) + 1
                to += 1
            # a space between documents ends words; it belongs to none
            raw = np.frombuffer(b" ".join(bytes(t) for t in texts[at:to]) + b" ", np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
            edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8)))
            start, end = edge[::2], edge[1::2]
            up, down = powers(len(raw))
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
            parts.append(mix((total[end] - total[start]) * down[start], 3))
            own.append((np.searchsorted(ends, start, "right") + at).astype(np.uint32))
            at = to
        self.words = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.doc = np.concatenate([np.zeros(0, np.uint32), *own])
        first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.pos = (np.arange(len(self.doc)) - first[self.doc]).astype(np.int32)

    def runs(self, size: int, salt: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, by start; those over the end of a document stand for nothing."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.words))
        total = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(mix(self.words, salt) * up[: len(self.words)], out=total[1:])
        return mix((total[size:] - total[:-size]) * down[:n], salt + 1)

    def windows(self, words: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, fingerprint, 32 more bits of it, least run) of every window inside a document."""
        key, more, least = self.runs(words, 51), self.runs(words, 61), self.runs(run, 71)
        # the least of all runs in a window, by powers of two and one overlap
        width = words - run + 1
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        own = np.flatnonzero(self.doc[: len(key)] == self.doc[words - 1 :]) if len(key) else np.zeros(0, np.int64)
        # the least of many is small; mixed, it is spread evenly again
        return own, key[own], (more[own] >> U(32)).astype(np.uint32), mix(least[own], 81)


def _pack(docs: np.ndarray, items: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple]:
    """Rows (bucket, kind, documents, items); items name documents by their place among those of the row."""
    order = np.argsort(bucket, kind="stable")
    items, bucket = items[order], bucket[order]
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    names = [c for c in ("doc", "of") if c in items.dtype.names]
    for a, b in zip(heads, [*heads[1:], len(bucket)]):
        part = items[a:b].copy()
        used, at = np.unique(np.concatenate([part[c] for c in names]), return_inverse=True)
        for k, c in enumerate(names):
            part[c] = at[k * len(part) : (k + 1) * len(part)]
        yield int(bucket[a]), kind, docs[used].tobytes(), part.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, PACKED)], schema=PACKED)


def _unpack(group: pa.Table, kind: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(documents, items) of all rows of a kind, items naming documents of the whole list; equal documents are one."""
    docs, items, n = [np.zeros(0, DOC)], [np.zeros(0, dtype)], 0
    for k, d, i in zip(*(group.column(c).to_pylist() for c in ("kind", "docs", "items"))):
        if k == kind:
            own, part = np.frombuffer(d, DOC), np.frombuffer(i, dtype).copy()
            for c in ("doc", "of"):
                if c in dtype.names:
                    part[c] += n
            docs.append(own)
            items.append(part)
            n += len(own)
    docs, items = np.concatenate(docs), np.concatenate(items)
    if len(docs):
        docs, at = np.unique(docs, return_inverse=True)
        for c in ("doc", "of"):
            if c in dtype.names:
                items[c] = at[items[c]]
    return docs, items


def _spread(docs: np.ndarray, buckets: int) -> np.ndarray:
    """The range by document of each document."""
    h = mix(docs["id"].view(np.uint64) ^ mix(docs["text"].view(np.uint64), 5), 9)
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)


def parsed(doc: np.ndarray, pos: np.ndarray, of: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Greedy factors from repeated windows or shorter factors, each with one place where it stands too.

    A factor goes on while the next start continues in the same reference, and else ends there.
    """
    size = np.ones(len(doc), np.int32) if n is None else n
    order = np.lexsort((pos, doc))
    doc, pos, of, at, size = (x[order] for x in (doc, pos, of, at, size))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (pos[1:] != pos[:-1] + size[:-1]) | (at[1:] != at[:-1] + size[:-1])
    head = np.flatnonzero(new)
    out = np.zeros(len(head), FACTOR)
    for c, v in (("doc", doc), ("pos", pos), ("of", of), ("at", at)):
        out[c] = v[head]
    out["n"] = np.add.reduceat(size, head) if len(head) else 0
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows (id, text hash, text) gathered until they hold enough bytes."""
    held, got = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(3))):
            held.append((row[0].as_py(), row[1].as_py(), row[2].as_buffer()))
            got += len(held[-1][2])
            if got >= size:
                yield held
                held, got = [], 0
    if held:
        yield held


def _alike(key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by fingerprint, number of the group of each in that order, where groups begin)."""
    order = np.lexsort((more, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _index(words: int, run: int, block: int, part: int, passes: int, ranges: int, by_doc: int):
    """(id, text hash, text) -> windows to be looked up by range, and the factors found in the own block."""
    step = 2**64 // passes

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            docs = np.array([r[:2] for r in rows], DOC)
            text = Block([r[2] for r in rows])
            start, key, more, least = text.windows(words, run)
            inside = least >= U(part * step)
            if part < passes - 1:
                inside &= least < U((part + 1) * step)
            start, key, more = start[inside], key[inside], more[inside]
            order, group, head = _alike(key, more)
            size = np.bincount(group, minlength=len(head))
            first = order[head]
            items = np.zeros(len(first), ITEM)
            items["key"], items["more"], items["doc"] = key[first], more[first], text.doc[start[first]]
            items["pos"] = np.where(size > 1, ~text.pos[start[first]], text.pos[start[first]])
            packed = list(_pack(docs, items, ((items["key"] >> U(32)) * U(ranges) >> U(32)).astype(np.int32), LOOK))
            # of windows that the block holds again, the first refers to the second and all others to the first
            many = size[group] > 1
            member = order[many]
            other = first[group][many]
            is_first = member == other
            other[is_first] = order[head + 1 - (size < 2)][group][many][is_first]
            p, o = start[member], start[other]
            found = parsed(text.doc[p], text.pos[p], text.doc[o], text.pos[o])
            packed += _pack(docs, found, _spread(docs, by_doc)[found["doc"]], KNOWN)
            yield _batch(packed)

    return go


def _look_up(by_doc: int):
    """Within one range of all indexes: factors of the windows that only other blocks hold; known ones pass by."""

    def run(group: pa.Table) -> pa.Table:
        docs, items = _unpack(group, LOOK, ITEM)
        order, number, head = _alike(items["key"], items["more"])
        size = np.bincount(number, minlength=len(head))
        again = items["pos"] < 0
        items["pos"] = np.where(again, ~items["pos"], items["pos"])
        wanted = (size[number] > 1) & ~again[order]
        member, other = order[wanted], order[head][number][wanted]
        own = member == other
        other[own] = order[head + 1 - (size < 2)][number][wanted][own]
        found = parsed(items["doc"][member], items["pos"][member], items["doc"][other], items["pos"][other])
        rows = list(_pack(docs, found, _spread(docs, by_doc)[found["doc"]], KNOWN)) if len(found) else []
        known = group.filter(pa.compute.equal(group.column("kind"), KNOWN)).select(PACKED.names).cast(PACKED)
        return pa.concat_tables([pa.Table.from_batches([_batch(rows)]), known])

    return run


FOUND = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("of", pa.list_(pa.int64())), ("ats", pa.list_(pa.int32()))])


def _by_document(group: pa.Table) -> pa.Table:
    """Per document, its factors (first window, windows, reference document, place there), as long as they go."""
    docs, items = _unpack(group, KNOWN, FACTOR)
    # rows that repeat as a whole report the same start more than once
    keep = np.ones(len(items), bool)
    items = items[np.lexsort((-items["n"], items["pos"], items["doc"]))]
    keep[1:] = (items["doc"][1:] != items["doc"][:-1]) | (items["pos"][1:] != items["pos"][:-1])
    items = items[keep]
    found = parsed(items["doc"], items["pos"], items["of"], items["at"], items["n"])
    cut = np.flatnonzero(np.diff(found["doc"], prepend=-1)) if len(found) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(cut, len(found)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (found["pos"], found["n"], docs["id"][found["of"]] if len(docs) else np.zeros(0, np.int64), found["at"])]
    own = docs[found["doc"][cut]] if len(docs) else docs
    return pa.table([pa.array(own["id"]), pa.array(own["text"]), *lists], schema=FOUND)


def _spans(starts: np.ndarray, sizes: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges [first word, end) that factors cover; ``sizes`` count windows."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], (starts + sizes)[order] + words - 1
    if not len(low):
        return []
    reach = np.maximum.accumulate(high)
    new = np.concatenate(([True], low[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return list(zip(low[at].tolist(), reach[np.append(at[1:] - 1, len(low) - 1)].tolist()))


def _cut(words: int):
    """(doc_id, text, factors of each pass) -> what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for text, starts, sizes in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    own = text.as_buffer().to_pybytes().split()
                    spans = _spans(np.array(starts or [], np.int64), np.array(sizes or [], np.int64), words)
                    kept, last = [], 0
                    for a, b in spans:
                        kept += own[last:a]
                        last = b
                    kept += own[last:]
                    out.append((b" ".join(kept), len(own), len(own) - len(kept), [{"first": a, "n": b - a} for a, b in spans]))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["doc_id", "kept", "n_words", "n_removed", "spans"]
                )

    return run


def _own(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("hash"), F.encode(whole(), "UTF-8").alias("raw")
    )


def factors(docs: DataFrame, *, words: int = WORDS, passes: int = PASSES, window_range: int = RANGE, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(id, hash, starts, sizes, of, ats): the factors of every document that has any, one list per pass.

    ``hash`` is xxhash64 of the text, as rows with one id may differ; factor k begins at word
    ``starts[k]``, covers ``sizes[k] + words - 1`` words and stands also in document ``of[k]`` from
    word ``ats[k]`` on. A null doc_id counts as the largest number.
    """
    if words < RUN:
        raise ValueError(f"windows have at least {RUN} words")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "factors")
    own = _own(docs)
    size = own.agg(F.sum(F.octet_length("raw")).alias("n")).first()["n"] or 0
    by_doc, ranges = max(8, int(size / DOC_BYTES) + 1), max(8, int(size / 6 / passes / window_range) + 1)
    long = own.filter(F.octet_length("raw") >= 2 * words - 1).select("id", "hash", "raw")
    names = []
    for part in range(passes):
        packed = long.mapInArrow(_index(words, RUN, block, part, passes, ranges, by_doc), SCHEMA)
        # the counts are those of the ranges, so that a task has one range at any size of the session's default
        looked = packed.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(_look_up(by_doc), SCHEMA)
        found = looked.repartition(by_doc, "bucket").groupBy("bucket").applyInArrow(
            _by_document, "id long, hash long, starts array<int>, sizes array<int>, of array<long>, ats array<int>"
        )
        names.append(f"found{part}")
        out = scratch.write(found, names[-1])
        del packed, looked, found
        scratch.release()
    return spark.read.schema(out.schema).parquet(*[scratch.paths[n] for n in names])


def without_repeated_passages(docs: DataFrame, *, words: int = WORDS, passes: int = PASSES, window_range: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, kept, n_words, n_removed, spans) for every row of ``docs(doc_id, text)``.

    Removed is every word that lies in a window of ``words`` consecutive words whose sequence starts
    anywhere else too, in the same document or another, so no occurrence of it stays. Words are runs
    without ASCII white space, unchanged; ``kept`` has the remaining ones with single spaces between
    (UTF-8), ``spans`` the removed stretches (first word, words). A null text counts as empty; rows
    that repeat are documents of their own and so copies of each other; texts of fewer than ``words``
    words stay whole. Very long texts are indexed whole, as one block. Windows are equal when 96 bits
    of two hashes agree. Other columns are not looked at; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    own = _own(docs)
    found = factors(docs, words=words, passes=passes, window_range=window_range, block=block, scratch=scratch)
    gone = found.groupBy("id", "hash").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))
    joined = own.join(gone.hint("merge"), ["id", "hash"], "left").select("doc_id", "raw", "starts", "sizes")
    kind = dict(pick(docs, "doc_id").dtypes)["doc_id"]
    return joined.mapInArrow(_cut(words), f"doc_id {kind}, kept binary, n_words long, n_removed long, spans array<struct<first:int,n:int>>")
