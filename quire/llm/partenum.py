"""Set-similarity join by PartEnum signatures: documents whose word shingles have a Jaccard of 0.9 or more.

Sizes are cut into bands whose ends are in the ratio of the threshold, so similar sets lie in the
same band or in neighbouring ones. Within a band a Jaccard of at least 0.9 bounds the number k of
elements in which two sets differ. The element domain is partitioned, and partitions (for small k
subsets of partitions) are enumerated so that k differences cannot touch all of them: similar sets
share at least one signature, the hash of their elements in such a subset.

Documents with equal sets are one class and travel once. Who shares a signature is not paired at
large: each member is compared with the first member, components are formed, and only members of
a signature that are still in different components are looked at again, by bit sketches that bound
the difference from below, in blocks. Every link that decides a component is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import Scratch, give_back, numbered, pick
from quire.llm.shingles import U, mix, shingle_set
from quire.operators.graphs import connected_components

#: Similarity threshold in percent, and words of a shingle.
PERCENT, WORDS = 90, 3
#: Where partitions hold fewer elements on average, subsets of two of three of them are enumerated, else single ones.
SUBSETS_BELOW = 8
#: Bits of the sketch that holds, for each cell, whether an odd number of elements falls into it.
SKETCH = 1024
#: Sets of SKETCH elements and more have so many times as many cells; eight, as a byte then folds to one cell.
FINE = 8
#: Signatures that one bucket of the exchange holds on average; members of a signature that are compared as one block.
BUCKET, BLOCK = 500_000, 2048
#: Passes over the text, each for one range of signatures: what is on disk at once is a fixed fraction of the text.
PASSES = 2
#: Ranges of elements; common elements are counted by one range at a time, so that only this share of the sets is moved at once.
RANGES = 4


@cache
def band(n: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(number, last size of the band of size n, last size of the band after it)."""
    low, number = 1, 0
    while True:
        high = low * 100 // percent
        if n <= high:
            return number, high, (high + 1) * 100 // percent
        low, number = high + 1, number + 1


def differences(top: int, percent: int = PERCENT) -> int:
    """The most elements in which two similar sets of at most ``top`` elements differ."""
    return 2 * top * (100 - percent) // (100 + percent)


def signatures(u: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a sorted set: of its own band, and of the next, where it meets larger sets."""
    number, top, above = band(len(u), percent)
    total = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(mix(u, 7), out=total[1:])
    high = (u >> U(32)).astype(np.int64)
    out = []
    for instance, last in ((number, top), (number + 1, above)):
        k = differences(last, percent)
        # a partition is a range of hashes, so it is a stretch of the sorted set; k differences leave
        # at least ``spare + 1`` partitions (or threes of them with at most one difference) alike
        few = 0 < k and last < SUBSETS_BELOW * (k + 2)
        least = 1 if k == 0 else k // 2 + 1 if few else k + 1
        spare = 0 if k == 0 else 2 + least // 40
        parts = (least + spare) * (3 if few else 1)
        cut = np.searchsorted(high * parts >> 32, np.arange(parts + 1))
        sums, full = total[cut[1:]] - total[cut[:-1]], cut[1:] > cut[:-1]
        if few:  # of such a three, two partitions agree
            a, f = sums.reshape(-1, 3), full.reshape(-1, 3)
            sums = np.stack([a[:, 0] + a[:, 1] * U(3), a[:, 0] + a[:, 2] * U(5), a[:, 1] + a[:, 2] * U(7)], 1).ravel()
            full = np.stack([f[:, 0] | f[:, 1], f[:, 0] | f[:, 2], f[:, 1] | f[:, 2]], 1)
            bare = int((~full.all(1)).sum())
            full = full.ravel()
        else:
            bare = int((~full).sum())
        # what is empty in so few places need not be shared: another alike place is not empty
        own = np.flatnonzero(full) if bare <= spare else np.arange(len(sums))
        sums = sums[own]
        out.append(mix(mix(sums, 11) + own.astype(np.uint64), instance + 13))
    return np.concatenate(out)


def sketch(u: np.ndarray) -> bytes:
    """Parities of SKETCH cells, or of FINE times as many for a large set; a fine cell lies within a coarse one."""
    bits = SKETCH if len(u) < SKETCH else SKETCH * FINE
    cells = np.bincount((mix(u, 5) >> U(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def _parities(sketches: list[bytes], coarse: bool) -> np.ndarray:
    """Sketches as rows of numbers; ``coarse`` brings large ones down to SKETCH cells."""
    if coarse:
        sketches = [s if len(s) == SKETCH // 8 else np.packbits(np.bitwise_count(np.frombuffer(s, np.uint8)) & 1).tobytes() for s in sketches]
    width = len(sketches[0]) // 8 if sketches else SKETCH // 64
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), width)


DOCS = "row long, doc_id long, text_hash long, text_more long, n long, cid long, cid2 long, sketch binary"
_DOC = pa.schema([*[(c, pa.int64()) for c in ("row", "doc_id", "text_hash", "text_more", "n", "cid", "cid2")], ("sketch", pa.binary())])
SETS = ", ".join(["cid long", *[f"u{k} binary" for k in range(RANGES)]])
COMMON = "a long, b long, na long, nb long, inner long"
SIGNED = "bucket int, packed binary"
MEMBERS = "sig long, cid long, first long, members long"
#: Class numbers that may stand for several sets.
MOST_SPLIT = 10_000


def class_of(u: np.ndarray, salt: int = 21) -> int:
    """64 bits that stand for a set; a second salt gives 64 more."""
    return int(mix(u, salt).sum().view(np.int64))


def name_of(u: np.ndarray, split: frozenset[int]) -> int:
    """The class number of a set; 64 bits more are mixed in where one number came up for several sets."""
    cid = class_of(u)
    return cid ^ class_of(u, 22) if cid in split else cid


def _describe(words: int):
    """(row, doc_id, text_hash, text_more, text) -> what is known of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(4).to_pylist():
                u = shingle_set(text or "", words)
                made.append((len(u), class_of(u), class_of(u, 22), sketch(u)) if len(u) else (0, None, None, None))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * 4, list(_DOC)[4:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], schema=_DOC)
        give_back()

    return run


def _sign(words: int, percent: int, part: int, passes: int, buckets: int, split: frozenset[int]):
    """(text) -> packed (signature, class) pairs by bucket, for one range of signatures."""
    low, step = part * (2**64 // passes), 2**64 // passes

    def packed(sig: list[np.ndarray], cid: list[int]) -> pa.RecordBatch:
        s = np.concatenate(sig)
        both = np.stack([s, np.repeat(np.array(cid, np.int64).view(np.uint64), [len(x) for x in sig])], 1)
        at = np.minimum(((s - U(low)) >> U(32)) // U(max(1, (step >> 32) // buckets)), U(buckets - 1))
        if buckets < 2**16:  # numbers this short are sorted by their digits
            at = at.astype(np.uint16)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(buckets + 1))
        own = [k for k in range(buckets) if ends[k] < ends[k + 1]]
        blobs = [both[order[ends[k] : ends[k + 1]]].tobytes() for k in own]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # signatures gather until a few MB are together; a class gives them once in that time
        sig, cids, seen, held = [], [], set(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    u = shingle_set(text or "", words)
                    cid = name_of(u, split)
                    if not len(u) or cid in seen:
                        continue
                    seen.add(cid)
                    own = signatures(u, percent)
                    own = own[(own >= U(low)) & (own - U(low) < U(step) if part < passes - 1 else True)]
                    sig.append(own)
                    cids.append(cid)
                    held += len(own)
                if held >= 500_000:
                    yield packed(sig, cids)
                    sig, cids, seen, held = [], [], set(), 0
        if sig:
            yield packed(sig, cids)
        sig, cids, seen = [], [], set()
        give_back()

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Of one bucket: the (signature, class, members) whose signature two classes or more have."""
    pairs = np.frombuffer(b"".join(group.column("packed").to_pylist()), np.uint64).reshape(-1, 2)
    # most signatures come once: those go before the pairs are put in order
    order = np.argsort(pairs[:, 0])
    sig = pairs[order, 0]
    twice = np.zeros(len(sig) + 1, bool)
    twice[1:-1] = sig[1:] == sig[:-1]
    pairs = pairs[order[twice[1:] | twice[:-1]]]
    pairs = pairs[np.lexsort((pairs[:, 1].view(np.int64), pairs[:, 0]))]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]).any(1)
    pairs = pairs[fresh]
    head = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0])))
    size = np.diff(np.append(head, len(pairs)))
    many = np.repeat(size, size) > 1
    sig, cid = pairs[many, 0].view(np.int64), pairs[many, 1].view(np.int64)
    first = np.repeat(pairs[head, 1].view(np.int64), size)[many]
    del order, twice, pairs, fresh
    give_back()
    return pa.table({"sig": sig, "cid": cid, "first": first, "members": np.repeat(size, size)[many].astype(np.int64)})


def _ranges(u: np.ndarray) -> list[bytes]:
    """A sorted set, cut at fixed numbers into RANGES stretches."""
    cut = np.searchsorted(u, np.arange(1, RANGES).astype(np.uint64) * U(2**64 // RANGES))
    return [x.tobytes() for x in np.split(u, cut)]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set, set) -> the sizes of both and of what they share."""
    for batch in batches:
        counts = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            counts.append((len(p), len(q), len(p) + len(q) - len(np.unique(np.concatenate((p, q))))))
        cols = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * 3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["a", "b", "na", "nb", "inner"])
    give_back()


def _compare(percent: int, nearest: bool):
    """Within one block pair: pairs of different components that the sketches don't rule out.

    With ``nearest``, a class names only its nearest such class of each other component.
    """

    def run(group: pa.Table) -> pa.Table:
        cid, comp, n, side = (group.column(c).to_numpy() for c in ("cid", "comp", "n", "side"))
        sketches = group.column("sketch").to_pylist()
        bits = _parities(sketches, len(set(map(len, sketches))) > 1)
        left = np.flatnonzero(side <= 0)
        right = np.flatnonzero(side >= 0)
        a, b = [], []
        for i in left:
            far = np.bitwise_count(bits[right] ^ bits[i]).sum(1)
            ok = (comp[right] != comp[i]) & ((100 + percent) * far.astype(np.int64) <= (100 - percent) * (n[right] + n[i]))
            at = right[ok]
            if nearest and len(at):
                at = at[np.lexsort((cid[at], far[ok], comp[at]))]
                at = at[np.concatenate(([True], comp[at][1:] != comp[at][:-1]))]
            a.append(np.minimum(cid[at], cid[i]))
            b.append(np.maximum(cid[at], cid[i]))
        a, b = np.concatenate(a or [cid[:0]]), np.concatenate(b or [cid[:0]])
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cells whose parity differs: the sets differ in at least so many elements."""
    fine = ((a.str.len() > SKETCH // 8) & (b.str.len() > SKETCH // 8)).to_numpy()
    out = np.zeros(len(a), np.int64)
    for own, coarse in ((fine, False), (~fine, True)):
        x, y = (_parities(s[own].tolist(), coarse) for s in (a, b))
        out[own] = np.bitwise_count(x ^ y).sum(1)
    return pd.Series(out)


def similar_documents(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, passes: int = PASSES, bucket: int = BUCKET) -> DataFrame:
    """(row, doc_id, text_hash, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Two documents link when their sets of distinct ``words``-word shingles (A-Z lower-cased; the
    whole sequence as one if it is shorter) have a Jaccard similarity of ``percent`` percent or
    more. ``component_id`` is the smallest doc_id that links reach, the document's own without
    links; it is null only where no reachable doc_id is there. Null, empty and blank texts have
    no shingles and link with nothing. Repeated rows are documents of their own and equal sets
    always link. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    own = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = own.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    # signatures per byte, about: one for each difference and band, half as many again in subsets, a word in six bytes
    rate = 2 * (100 - percent) / (100 + percent)
    share = 2.5 * rate * (1.5 if rate * SUBSETS_BELOW > 1 else 1) / 6
    buckets = max(8, int(size * share / passes / bucket) + 1)
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(1), "text").alias("text_more"), "text")
    described = scratch.write(numbered(rows).mapInArrow(_describe(words), DOCS), "described")

    def classed() -> DataFrame:
        return described.filter("n > 0").groupBy("cid").agg(
            F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "text_more")).alias("one"), F.min("cid2").alias("lo"), F.max("cid2").alias("hi"), F.min("n").alias("n"), F.first("sketch").alias("sketch"),
        )

    classes = scratch.write(classed(), "classes")
    # one number for several sets: about n * n / 2**65 of n sets, so this list stays short at any size
    twice = classes.filter("lo <> hi").select("cid").limit(MOST_SPLIT + 1).collect()
    if len(twice) > MOST_SPLIT:
        raise ArithmeticError("far too many shingle sets share a 64-bit class number; give the hash another salt")
    split = frozenset(r["cid"] for r in twice)
    if split:
        described = described.withColumn("cid", F.when(F.col("cid").isin(*split), F.col("cid").bitwiseXOR(F.col("cid2"))).otherwise(F.col("cid")))
        classes = scratch.write(classed(), "split-classes")
    names = []
    for part in range(passes):
        names.append(f"members{part}")
        signed = own.select("text").mapInArrow(_sign(words, percent, part, passes, buckets, split), SIGNED)
        scratch.write(signed.groupBy("bucket").applyInArrow(_shared, MEMBERS), names[-1])
        del signed
        scratch.release()
    members = spark.read.schema(MEMBERS).parquet(*[scratch.paths[n] for n in names])
    touched = members.select("cid").distinct()
    meet = scratch.write(classes.join(touched, "cid", "left_semi").select("cid", "least", "one", "n", "sketch"), "meet")
    needed = meet.select(F.col("one.doc_id").alias("d"), F.col("one.text_hash").alias("t1"), F.col("one.text_more").alias("t2")).distinct()
    # never broadcast: the ids grow with the documents, and the text of one member of each class moves once at every size
    texts = own.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text").join(
        needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left_semi"
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                us = [shingle_set(t or "", words) for t in batch.slice(at, 512).column(0).to_pylist()]
                cols = [pa.array(c, pa.binary()) for c in zip(*map(_ranges, us))]
                cid = pa.array([name_of(u, split) for u in us], pa.int64())
                yield pa.RecordBatch.from_arrays([cid, *cols], names=["cid", *[f"u{k}" for k in range(RANGES)]])
        give_back()

    kept = scratch.write(texts.select("text").mapInArrow(sets, SETS), "sets")
    scratch.release()
    left = meet.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = meet.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.write(pairs.distinct(), f"{name}-pairs")
        counts = []
        for k in range(RANGES):
            ua, ub = (kept.select(F.col("cid").alias(end), F.col(f"u{k}").alias(f"u{end}")) for end in "ab")
            both = pairs.join(ua, "a").join(ub, "b").select("a", "b", "ua", "ub")
            counts.append(scratch.write(both.mapInArrow(_common, COMMON), f"{name}-{k}").withColumn("range", F.lit(k)))
            del ua, ub, both
            scratch.release()
        # repeated rows may have given a set twice: each range counts once
        once = reduce(DataFrame.unionByName, counts).groupBy("a", "b", "range").agg(*[F.max(c).alias(c) for c in ("na", "nb", "inner")])
        whole = once.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("na", "nb", "inner")])
        alike = F.col("inner") * 100 >= (F.col("na") + F.col("nb") - F.col("inner")) * percent
        found = scratch.write(whole.filter(alike).select("a", "b"), name)
        scratch.drop(f"{name}-pairs", *[f"{name}-{k}" for k in range(RANGES)])
        return found

    def apart(pairs: DataFrame, state: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        for end in "ab":
            pairs = pairs.join(state.select(F.col("cid").alias(end), F.col("comp").alias(f"c{end}")), end)
        return pairs.filter("ca <> cb").select("a", "b")

    def components(links: DataFrame) -> DataFrame:
        found = connected_components(links, "a", "b").select(F.col("id").alias("cid"), F.col("component").alias("comp"))
        if "components" in scratch.paths:  # of the links so far; all that read it is written
            scratch.drop("components")
        return scratch.write(meet.select("cid", "n", "sketch").join(found, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "components")

    # every member against the first of its signatures: the first that looks nearest, then those of other components
    star = members.filter("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct().join(left, "a").join(right, "b")
    star = star.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).withColumn("far", F.pandas_udf(_distance, "long")("sa", "sb"))
    star = scratch.write(star.filter(F.col("far") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b", "far"), "star")
    links = verified(star.groupBy("b").agg(F.min(F.struct("far", "a")).alias("near")).select(F.col("near.a").alias("a"), "b"), "near-first")
    state = components(links)
    links = links.unionByName(verified(apart(star.select("a", "b"), state), "other-firsts"))
    state = components(links)
    for step in ("nearest", "rest"):
        # which signatures are still open takes components only; sketches join the members of those alone
        seen = members.filter("members > 2").select("sig", "cid", "members").join(state.select("cid", "comp"), "cid")
        mixed = seen.groupBy("sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("sig")
        still = scratch.write(seen.join(mixed, "sig", "left_semi"), f"{step}-open")
        scratch.release()
        open_ = still.join(state.select("cid", "n", "sketch"), "cid").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        open_ = open_.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "sig", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1).alias("side"),
            "cid", "comp", "n", "sketch",
        )
        pairs = dealt.groupBy("sig", "lo", "hi").applyInArrow(_compare(percent, step == "nearest"), "a long, b long")
        found = verified(pairs, step)
        scratch.drop(f"{step}-open")
        links = links.unionByName(found)
        if not found.isEmpty():
            state = components(links)
    scratch.drop("sets", "star", "meet", *names)
    named = state.join(classes.select("cid", "least"), "cid")
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    place = named.join(least, "comp").select("cid", "component")
    place = classes.select("cid", "least").join(place, "cid", "left").select(F.col("cid").alias("c"), F.coalesce("component", "least").alias("component"))
    return described.join(place, F.col("cid") == F.col("c"), "left").select(
        "row", "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )
