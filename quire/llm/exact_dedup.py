"""Exact duplicates by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own wording says so, each chunk becomes an identifier, and texts are
equal exactly when their ordered identifier lists are. Identifiers are 64-bit fingerprints
that a check over the chunk contents has verified: every distinct chunk leaves a map task
once, contents that share a fingerprint get different numbers, and from then on only lists
of numbers move, however long the documents are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.base import SPACE, Scratch, pick, whole

#: Chunks hold 512 to 4096 characters and end after a word in d, g or y before one in a or w;
#: where no such place comes they end at 4096 characters, and the rest of a text is one chunk.
CHUNK = r"(?s)(?:.{512,4096}?(?:[dgy] (?=[aw])|\z)|.{1,4096}+)"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole(text), SPACE, " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), 0)


def exact_duplicates(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs(doc_id, text)``.

    Texts are compared whole after each run of white space became one space; null counts as
    empty, empty texts equal each other. The smallest doc_id of a group stays (a null doc_id
    only if there is no other); of rows that repeat it as well, one stays. An empty table
    gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = normalised()
    own = pick(docs, "doc_id", "text")
    described = (
        "doc_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
        F.transform(chunks(text), lambda c: fingerprint(c)).alias("recipe"),
    )
    rows = scratch.write(own.select(F.monotonically_increasing_id().alias("row"), *described), "recipes")
    pieces = own.select(F.explode(chunks(text)).alias("chunk")).select(fingerprint(F.col("chunk")).alias("fp"), "chunk")
    contents = pieces.distinct()
    shared = scratch.write(contents.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "shared")
    key = ["recipe"]
    if not shared.isEmpty():
        own = scratch.write(own.withColumn("row", F.monotonically_increasing_id()), "texts")
        number = _numbers(contents, shared, scratch)
        rows, key = own.select("row", *described).join(_spots(own, number, text, fingerprint), "row", "left"), ["recipe", "numbers"]
        rows = scratch.write(rows, "numbered")

    # count and least row are combined map-side; only groups of two or more are joined back
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = rows.groupBy(*key).agg(F.count("*").alias("group_size"), first).filter("group_size > 1")
    named = groups.select(*[F.col(k).alias(f"g_{k}") for k in key], "group_size", "first")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    return rows.join(named, same, "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def _numbers(contents: DataFrame, shared: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, chunk, number): contents that share a fingerprint, numbered in their order."""
    met = contents.join(shared, "fp", "left_semi")
    ahead = met.select("fp", F.col("chunk").alias("other"))
    number = met.join(ahead, "fp").filter("other <= chunk").groupBy("fp", "chunk").agg(F.count("*").alias("number"))
    return scratch.write(number, "numbers")


def _spots(own: DataFrame, number: DataFrame, text: Column, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """(row, numbers): where a text holds such contents, and their numbers."""
    return (
        own.select("row", F.posexplode(chunks(text)).alias("at", "chunk"))
        .withColumn("fp", fingerprint(F.col("chunk")))
        .join(number, ["fp", "chunk"])
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("numbers"))
    )


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
"""
