"""Product-quantisation codes of vectors, with the nearest codebook entry found by slices and bitmasks.

Vectors are cut into parts; each part position has a codebook of at most 64 entries, refined in
rounds. The nearest entry of a part is found by *slice and intersect*: in every dimension the
entries' coordinates are sorted, and a prefix mask says which entries come before each place. The
distance to a first guess is the initial radius; the coordinates within it are one slice of every
dimension, two prefix masks give its entries as a uint64, and the AND over all dimensions is what
can be as near as the guess. Only those are measured, in integers, so assignments are exact.

A codebook is a model of fixed size (entries x dimension) and the one thing that passes through the
driver. Tasks send sums per entry, which add up in Spark; vectors stay where they are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import Scratch, pick

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components count as at most this much, so that squared distances of wide vectors stay exact in 64 bits.
CLAMP = 2**26


class Slices:
    """One codebook, sorted by each dimension, with prefix masks of its entries."""

    def __init__(self, entries: np.ndarray) -> None:
        if len(entries) > 64:
            raise ValueError("a mask holds at most 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        bits = np.uint64(1) << order.astype(np.uint64)
        # row i: the entries of the first i places
        self.prefix = np.concatenate([np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, 0)])
        self.order = order
        # guesses come from where entries lie furthest apart
        spread = self.sorted[-1] - self.sorted[0]
        self.wide = np.argsort(-spread, kind="stable")[:2]

    def distance(self, x: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        d = x - self.entries[at]
        return (d * d).sum(1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """Squared distance to the better of two guesses: the next entries along the widest dimensions."""
        best = None
        for d in self.wide:
            right = np.clip(np.searchsorted(self.sorted[:, d], x[:, d]), 0, len(self.entries) - 1)
            left = np.maximum(right - 1, 0)
            nearer = np.abs(x[:, d] - self.sorted[left, d]) <= np.abs(x[:, d] - self.sorted[right, d])
            found = self.distance(x, self.order[np.where(nearer, left, right), d])
            best = found if best is None else np.minimum(best, found)
        return np.zeros(len(x), np.int64) if best is None else best

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks of the entries that may be as near as the guess; never empty."""
        reach = np.sqrt(self.radius(x).astype(np.float64)).astype(np.int64) + 1
        mask = np.full(len(x), (1 << len(self.entries)) - 1, np.uint64)
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - reach, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + reach, "right")
            mask &= self.prefix[high, d] & ~self.prefix[low, d]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance); of equally near entries the first."""
        mask = self.candidates(x)
        entry, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for e in range(len(self.entries)):
            at = np.flatnonzero(mask >> np.uint64(e) & np.uint64(1))
            d = self.distance(x[at], e)
            better = d < least[at]
            entry[at[better]], least[at[better]] = e, d[better]
        return entry, least


def bounds(dim: int, parts: int) -> list[int]:
    """Where parts begin and end; equal ones where the dimension allows."""
    return [k * dim // parts for k in range(parts + 1)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _sums(books: list[np.ndarray], dim: int):
    """(q) -> per task (part, entry, n, sums) of the parts assigned to each entry."""
    cut = bounds(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            q = _matrix(batch.column(0), dim)
            for p, s in enumerate(slices):
                x = q[:, cut[p] : cut[p + 1]]
                entry, _ = s.nearest(x)
                n[p] += np.bincount(entry, minlength=len(n[p]))
                np.add.at(total[p], entry, x)
        rows = [(p, e, int(n[p][e]), total[p][e].tolist()) for p in range(len(books)) for e in range(len(n[p])) if n[p][e]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", "sums"])

    return run


def _assign(books: list[np.ndarray], dim: int):
    """(row, q) -> (row, codes, error)."""
    cut = bounds(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            q = _matrix(batch.column(2), dim)
            got = [s.nearest(q[:, cut[p] : cut[p + 1]]) for p, s in enumerate(slices)]
            codes = np.stack([g[0] for g in got], 1).astype(np.uint8) if len(q) else np.zeros((0, len(books)), np.uint8)
            error = np.sum([g[1] for g in got], 0) if len(q) else np.zeros(0, np.int64)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    return run


def compressed(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, label: str = "label"
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes binary, error) of every kept row of ``vectors(vec_id, embedding, label)``, and the codebooks.

    Components become ``floor(scale * x)``. Rows whose vector is null or holds null or non-finite
    components are dropped, as are those of another length than the first kept vector's, since no
    codebook fits them; components beyond 2^26 / scale count as that much. Each codebook starts as
    the parts of the ``entries`` (at most 64) smallest vec_ids, nulls last and equal ids in the order
    of their components; with fewer vectors it has fewer entries. In each round every part goes to
    the nearest entry, of equally near ones to the first, and entries become the rounded-down means
    of their parts; entries without parts stay. A length that ``parts`` does not divide gives parts
    that differ by one component. Repeated rows each count; empty vectors have error 0; other columns are not
    looked at, and an empty table gives no rows and no codebooks.
    """
    if not 1 <= entries <= 64:
        raise ValueError("entries must be between 1 and 64")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    own = pick(vectors, "vec_id", "embedding", label).toDF("vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(CLAMP))), F.lit(float(CLAMP)))).cast("int"))
    kept = own.filter(F.col("embedding").isNotNull() & fine).select("vec_id", "label", whole.alias("q"))
    kinds = dict(own.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long"
    kept = scratch.write(kept, "kept")
    first = kept.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema), []
    dim = len(first[0]["q"])
    kept = kept.filter(F.size("q") == dim)
    start = kept.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    cut = bounds(dim, parts)
    begin = np.array([r["q"] for r in start], np.int64).reshape(len(start), dim)
    books = [begin[:, a:b].copy() for a, b in zip(cut, cut[1:])]
    for _ in range(rounds):
        sums = kept.select("q").mapInArrow(_sums(books, dim), "part int, entry int, n long, sums array<long>")
        mean = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        # entries x dimension rows at most
        for r in mean.collect():
            books[r["part"]][r["entry"], r["at"]] = r["v"] // r["n"]
    return scratch.write(kept.select("vec_id", "label", "q").mapInArrow(_assign(books, dim), schema), "coded"), books


def reconstructed(coded: DataFrame, books: list[np.ndarray], *, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``vector``: the components that each row's codes stand for."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) if len(e) else F.array().cast("array<double>") for e in b]) for b in books])
    picked = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(F.get(flat, p), F.conv(F.hex(F.substring("codes", p + 1, F.lit(1))), 16, 10).cast("int"))))
    return coded.withColumn("vector", picked)


def digest(books: list[np.ndarray]) -> str:
    """All components of the codebooks by part, entry and place, comma-joined."""
    return ",".join(str(v) for b in books for v in b.ravel().tolist())


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code hex, error, label_error, codebooks_sha256) of every kept row; label_error sums the errors of equal labels, nulls together."""
    coded, books = compressed(vectors)
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.sha2(F.lit(digest(books)).cast("binary"), 256).alias("codebooks_sha256")
    )


def _codes_sql() -> str:
    """The same rounds over parts as lists, one after the other."""
    steps = [
        f"""q AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS place, vec_id, label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (
  SELECT rid, place, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] AS v FROM q, range({PARTS}) t(part))""",
        f"c0 AS MATERIALIZED (SELECT part, place AS entry, v FROM p WHERE place < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT p.rid, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := c.entry)) AS best
  FROM p JOIN c{k} c ON p.part = c.part GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT part, entry, list(floor_mean ORDER BY i) AS v FROM (
    SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS floor_mean FROM (
      SELECT a.part, a.best.e AS entry, i, sum(p.v[i])::BIGINT AS s, count(*) AS n
      FROM a{k} a JOIN p ON a.rid = p.rid AND a.part = p.part, range(1, len(p.v) + 1) t(i) GROUP BY ALL)) GROUP BY ALL)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)")
    steps.append(f"""r AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT q.vec_id, code, error, (sum(error) OVER (PARTITION BY q.label))::BIGINT AS label_error,
  sha256((SELECT string_agg(array_to_string(v, ','), ',' ORDER BY part, entry) FROM c{ROUNDS})) AS codebooks_sha256
FROM r JOIN q ON r.rid = q.rid"""


CODES_SQL = _codes_sql()
