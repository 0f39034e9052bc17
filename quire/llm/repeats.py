"""Repeated byte strings by blockwise suffix sorting with a difference cover.

Removed is every byte covered by a string of 100 bytes that also starts earlier. Suffixes only
matter to that depth, and they are sorted one bucket at a time:

1. *Cover samples.* Positions that are cover members modulo 73 are samples. Two equal strings of
   100 bytes share one: at some distance below 73 both have a sample with the same 28 bytes. The
   samples are sorted in several passes, each over one range of names. Samples alone with their
   name are done. Of equal names, those whose whole surroundings (all bytes that a string through
   the sample can hold) also occur earlier settle all strings through them at once; what is left
   are ties between different surroundings.
2. *Suffixes.* Only strings through such a tie, and not settled by another sample, are sorted
   themselves, again one range of hashes per pass. All but the first of equal ones are repeats.

Samples and suffixes travel as packed arrays, a few MB for each task and bucket, and of equal ones
a map task sends the first only, so neither a frequent passage nor a large group of copies fills a
bucket. A pass moves a fixed fraction of the text, so its share of the disk is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import Scratch, pick, whole
from quire.llm.shingles import U
from quire.llm.suffixes import PERIOD, Block, windows

LENGTH = 100
#: Passes over the text for samples and for suffixes, items that one bucket holds on average, bytes of text a task works on at once.
PASSES, SUFFIX_PASSES, BUCKET, FLUSH = 4, 3, 1_000_000, 8_000_000
#: Buckets by document in which results meet hold so many bytes of text on average.
DOC_BYTES = 16_000_000
LAST = 2**63 - 1
SAMPLE = np.dtype([("key", "<u8"), ("context", "<u8"), ("doc", "<u4"), ("pos", "<i4")])
SUFFIX = np.dtype([("key", "<u8"), ("doc", "<u4"), ("pos", "<i4")])
PLACE = np.dtype([("doc", "<u4"), ("pos", "<i4")])
DOC = np.dtype([("id", "<i8"), ("text", "<i8")])
#: What a place stands for: a sample with a tie, a sample that is settled, the start of a repeat.
TIE, SETTLED, REPEAT = 0, 1, 2
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("items", pa.binary())])
SCHEMA = "bucket int, kind int, docs binary, items binary"
#: Kind of rows that hold items to sort; places that a map task has found pass by.
SORT = -1


def _pack(docs: np.ndarray, items: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple]:
    """Rows (bucket, kind, documents, items) with the documents that each bucket's items name."""
    order = np.argsort(bucket, kind="stable")
    items, bucket = items[order], bucket[order]
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(heads, [*heads[1:], len(bucket)]):
        part = items[a:b].copy()
        used, part["doc"] = np.unique(part["doc"], return_inverse=True)
        yield int(bucket[a]), kind, docs[used].tobytes(), part.tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, PACKED)], schema=PACKED)


def _unpack(group: pa.Table, kinds: set[int], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, items, kind of each item) of a bucket, items naming documents of the whole table."""
    docs, items, kind, n = [np.zeros(0, DOC)], [np.zeros(0, dtype)], [np.zeros(0, np.int8)], 0
    for k, d, i in zip(*(group.column(c).to_pylist() for c in ("kind", "docs", "items"))):
        if k in kinds:
            own, part = np.frombuffer(d, DOC), np.frombuffer(i, dtype).copy()
            part["doc"] += n
            docs.append(own)
            items.append(part)
            kind.append(np.full(len(part), k, np.int8))
            n += len(own)
    return np.concatenate(docs), np.concatenate(items), np.concatenate(kind)


def _spread(docs: np.ndarray, doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket by document of each place."""
    h = (docs["id"].view(np.uint64) * U(0x9E3779B97F4A7C15) ^ docs["text"].view(np.uint64)) * U(0xBF58476D1CE4E5B9)
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)[doc]


def _places(docs: np.ndarray, items: np.ndarray, buckets: int, kind: int) -> Iterator[tuple]:
    out = np.zeros(len(items), PLACE)
    out["doc"], out["pos"] = items["doc"], items["pos"]
    return _pack(docs, out, _spread(docs, out["doc"], buckets), kind)


def _emit(docs: np.ndarray, items: np.ndarray, same: np.ndarray, part: int, passes: int, buckets: int, by_doc: int, found: int) -> pa.RecordBatch:
    """Of items in the order of documents and positions, the first of each equal run in ``same`` goes to be sorted."""
    order = np.argsort(same, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = same[order][1:] != same[order][:-1]
    keep = np.sort(order[first])
    again = np.sort(order[~first])
    # the key's place within the range of this pass
    inner = items["key"][keep] - U(part * (2**64 // passes))
    bucket = np.minimum((inner >> U(32)) // U(max(1, 2**32 // passes // buckets)), U(buckets - 1)).astype(np.int32)
    rows = list(_pack(docs, items[keep], bucket, SORT))
    rows += _places(docs, items[again], by_doc, found)
    return _rows(rows)


def _in_pass(key: np.ndarray, part: int, passes: int) -> np.ndarray:
    step = 2**64 // passes
    low = key >= U(part * step)
    return low if part == passes - 1 else low & (key < U((part + 1) * step))


def _documents(rows: list[tuple]) -> list[tuple]:
    """Rows in the order of documents; of rows of one document the first, as it is no repeat of itself."""
    rows = sorted(rows, key=lambda r: r[:2])
    return [r for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (id, text hash, bytes, ...) gathered until they hold enough bytes, one of a document, in the order of documents."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
            row = (row[0].as_py(), row[1].as_py(), row[2].as_buffer(), *row[3:])
            held.append(row)
            size += len(row[2])
            if size >= FLUSH:
                yield _documents(held)
                held, size = [], 0
    if held:
        yield _documents(held)


def _samples(length: int, part: int, passes: int, buckets: int, by_doc: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _flushes(batches):
            docs = np.array([r[:2] for r in rows], DOC)
            block = Block([r[2] for r in rows], length)
            doc, pos, name = block.samples()
            own = np.flatnonzero(_in_pass(name, part, passes))
            items = np.zeros(len(own), SAMPLE)
            items["doc"], items["pos"], items["key"] = doc[own], pos[own], name[own]
            items["context"] = block.contexts(doc[own], pos[own])
            yield _emit(docs, items, items["key"] ^ (items["context"] * U(3)), part, passes, buckets, by_doc, SETTLED)

    return run


def _ranks(docs: np.ndarray) -> np.ndarray:
    """The order of each document by (id, text hash); equal documents have equal ranks."""
    return np.unique(docs, return_inverse=True)[1] if len(docs) else np.zeros(0, np.int64)


def _sort_samples(by_doc: int):
    def run(group: pa.Table) -> pa.Table:
        docs, items, _ = _unpack(group, {SORT}, SAMPLE)
        _, inverse, count = np.unique(items["key"], return_inverse=True, return_counts=True)
        items = items[count[inverse] > 1]
        rank = _ranks(docs)[items["doc"]]
        order = np.lexsort((items["pos"], rank, items["context"], items["key"]))
        items, rank = items[order], rank[order]
        name = np.ones(len(items), bool)
        name[1:] = items["key"][1:] != items["key"][:-1]
        around = name.copy()
        around[1:] |= items["context"][1:] != items["context"][:-1]
        head = np.maximum.accumulate(np.where(around, np.arange(len(items)), 0)) if len(items) else around.astype(int)
        settled = (rank != rank[head]) | (items["pos"] != items["pos"][head])
        number = np.cumsum(name) - 1
        kinds = np.bincount(number, weights=around) if len(items) else np.zeros(0)
        tie = ~settled & (kinds[number] > 1)
        rows = [*_places(docs, items[tie], by_doc, TIE), *_places(docs, items[settled], by_doc, SETTLED)]
        return _passed(group, rows)

    return run


def _passed(group: pa.Table, rows: list[tuple]) -> pa.Table:
    other = group.filter(pa.compute.not_equal(group.column("kind"), SORT)).select(PACKED.names).cast(PACKED)
    return pa.concat_tables([pa.Table.from_batches([_rows(rows)]), other])


def _sort_suffixes(by_doc: int):
    def run(group: pa.Table) -> pa.Table:
        docs, items, _ = _unpack(group, {SORT}, SUFFIX)
        _, inverse, count = np.unique(items["key"], return_inverse=True, return_counts=True)
        items = items[count[inverse] > 1]
        rank = _ranks(docs)[items["doc"]]
        order = np.lexsort((items["pos"], rank, items["key"]))
        items, rank = items[order], rank[order]
        new = np.ones(len(items), bool)
        new[1:] = items["key"][1:] != items["key"][:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(items)), 0)) if len(items) else new.astype(int)
        later = (rank != rank[head]) | (items["pos"] != items["pos"][head])
        return _passed(group, list(_places(docs, items[later], by_doc, REPEAT)))

    return run


def _merge(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, non-touching ranges (first, last) from ranges sorted by their first."""
    if not len(first):
        return np.zeros((0, 2), np.int32)
    reach = np.maximum.accumulate(last)
    new = np.concatenate(([True], first[1:] > reach[:-1] + 1))
    at = np.flatnonzero(new)
    return np.stack([first[at], reach[np.append(at[1:] - 1, len(first) - 1)]], 1).astype(np.int32)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranges ``a`` without what ranges ``b`` hold; both sorted and disjoint."""
    if not len(a) or not len(b):
        return a
    edge = np.concatenate([a[:, 0], a[:, 1] + 1, b[:, 0], b[:, 1] + 1]).astype(np.int64)
    step = np.concatenate([np.full(len(a), 1), np.full(len(a), -1), np.full(len(b), -2), np.full(len(b), 2)])
    order = np.argsort(edge, kind="stable")
    edge, level = edge[order], np.cumsum(step[order])
    ends = np.append(np.flatnonzero(edge[1:] != edge[:-1]), len(edge) - 1)
    edge, level = edge[ends], level[ends]
    on = np.flatnonzero(level[:-1] == 1)
    return _merge(edge[on], edge[on + 1] - 1)


def _by_document(group: pa.Table) -> pa.Table:
    """Per document, ranges of string starts: settled or found to repeat, and still to be sorted."""
    docs, items, kind = _unpack(group, {TIE, SETTLED, REPEAT}, PLACE)
    rank = _ranks(docs)[items["doc"]]
    order = np.lexsort((items["pos"], rank))
    items, kind, rank = items[order], kind[order], rank[order]
    heads = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(rank) else np.zeros(0, int)
    out = []
    for a, b in zip(heads, [*heads[1:], len(rank)]):
        pos, k = items["pos"][a:b], kind[a:b]
        low = np.maximum(pos - np.where(k == REPEAT, 0, PERIOD - 1), 0)
        by = np.argsort(low, kind="stable")
        low, pos, k = low[by], pos[by], k[by]
        sure = _merge(low[k != TIE], pos[k != TIE])
        test = _minus(_merge(low[k == TIE], pos[k == TIE]), sure)
        own = docs[items["doc"][a]]
        out.append((int(own["id"]), int(own["text"]), sure.tobytes(), test.tobytes()))
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "hash", "sure", "test"), cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))})


def _suffixes(length: int, part: int, passes: int, buckets: int, by_doc: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _flushes(batches):
            docs = np.array([r[:2] for r in rows], DOC)
            parts = []
            for d, r in enumerate(rows):
                raw = np.frombuffer(r[2], np.uint8)
                key = windows(raw, length)
                ranges = np.frombuffer(r[3].as_buffer(), np.int32).reshape(-1, 2)
                wanted = np.zeros(len(key) + 1, np.int8)
                ends = np.minimum(ranges[:, 1] + 1, len(key))
                ok = ranges[:, 0] < ends
                np.add.at(wanted, ranges[ok, 0], 1)
                np.add.at(wanted, ends[ok], -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1], dtype=np.int8))
                at = at[_in_pass(key[at], part, passes)]
                item = np.zeros(len(at), SUFFIX)
                item["key"], item["doc"], item["pos"] = key[at], d, at
                parts.append(item)
            items = np.concatenate(parts)
            yield _emit(docs, items, items["key"], part, passes, buckets, by_doc, REPEAT)

    return run


def _cut(length: int):
    """(doc_id, bytes, two lists of ranges of starts) -> what remains, and how much was removed in how many runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                kept, sizes, removed, spans = [], [], [], []
                for text, *ranges in zip(part.column(1), part.column(2), part.column(3)):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    gone = np.concatenate([np.frombuffer(r.as_buffer() if r.is_valid else b"", np.int32).reshape(-1, 2) for r in ranges])
                    gone = gone[np.argsort(gone[:, 0], kind="stable")]
                    low, high = gone[:, 0], np.minimum(gone[:, 1], len(raw) - length)
                    ok = low <= high
                    runs = _merge(low[ok], high[ok] + length - 1)
                    out, from_ = [], 0
                    for a, b in runs.tolist():
                        out.append(raw[from_:a])
                        from_ = b + 1
                    kept.append(b"".join([*out, raw[from_:]]))
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(kept[-1]))
                    spans.append(len(runs))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans))],
                    names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
                )

    return run


def without_repeats(docs: DataFrame, *, length: int = LENGTH, passes: int = PASSES, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for every row of ``docs(doc_id, text)``.

    ``kept`` are the text's UTF-8 bytes without those covered by a ``length``-byte string (at least
    81) that also starts earlier: in a document with a smaller doc_id, or earlier in the same one.
    A null doc_id counts as the largest; of equal ids the text with the smaller hash comes first,
    and rows equal in both count as one document and come out alike. A null text counts as empty.
    Cuts are made in bytes, so ``kept`` need not be valid UTF-8. An empty table gives no rows.
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    own = pick(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("hash"), F.encode(whole(), "UTF-8").alias("raw")
    )
    size = own.agg(F.sum(F.octet_length("raw")).alias("n")).first()["n"] or 0
    by_doc = max(8, int(size / DOC_BYTES) + 1)
    long = own.filter(F.octet_length("raw") >= length).select("id", "hash", "raw")

    def sorted_passes(rows: DataFrame, spread, sort, name: str, passes: int) -> list[str]:
        names, buckets = [], max(8, int(size * 0.125 / passes / bucket) + 1)
        for part in range(passes):
            names.append(f"{name}{part}")
            packed = rows.mapInArrow(spread(length, part, passes, buckets, by_doc), SCHEMA)
            scratch.write(packed.groupBy("bucket").applyInArrow(sort(by_doc), SCHEMA), names[-1])
            del packed
            scratch.release()
        return names

    def read(names: list[str]) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(*[scratch.paths[n] for n in names])

    marks = "id long, hash long, sure binary, test binary"
    first = sorted_passes(long, _samples, _sort_samples, "samples", passes)
    state = scratch.write(read(first).groupBy("bucket").applyInArrow(_by_document, marks), "state")
    scratch.drop(*first)
    scratch.release()
    open_ = state.filter(F.octet_length("test") > 0).select("id", "hash", "test")
    ties = scratch.write(long.join(open_.hint("merge"), ["id", "hash"]).select("id", "hash", "raw", "test"), "ties")
    scratch.release()
    second = sorted_passes(ties, _suffixes, _sort_suffixes, "suffixes", max(1, passes * SUFFIX_PASSES // PASSES))
    scratch.drop("ties")
    found = read(second).groupBy("bucket").applyInArrow(_by_document, marks).select("id", "hash", F.col("sure").alias("found"))
    gone = scratch.write(state.select("id", "hash", "sure").join(found.hint("merge"), ["id", "hash"], "full"), "gone")
    scratch.drop(*second)
    joined = own.join(gone.hint("merge"), ["id", "hash"], "left").select("doc_id", "raw", "sure", "found")
    kinds = f"doc_id {pick(docs, 'doc_id').dtypes[0][1]}, kept binary, n_bytes long, n_removed long, n_spans long"
    return joined.mapInArrow(_cut(length), kinds)
