"""Mixing sources to target weights by weighted sampling without replacement (DataFrame functions only).

Efraimidis-Spirakis keys: a document of weight w draws ``-ln(u) / w``; taking the smallest keys
first samples without replacement in proportion to the weights. Within a source the sizes are
summed in key order up to the source's budget, after whole epochs have used up what they can.

No source is ever sorted in one task: keys fall into buckets of roughly equal row counts, sums
per bucket are combined map-side, and only the one bucket per source in which the budget ends
is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.base import WORD, Scratch, pick, whole

#: Rows that one key bucket holds on average.
BUCKET_ROWS = 4096
#: No source gives more than this many times its own words.
MAX_EPOCHS = 3


def quality(text: str = "text") -> Column:
    """Quality weight of a text, 1 to 2: the share of Latin letters among its characters, plus one."""
    t = whole(text)
    letters = F.length(F.regexp_replace(t, r"[^A-Za-z]+", ""))
    return F.lit(1.0) + letters / F.greatest(F.length(t), F.lit(1))


def draw(seed: int) -> Column:
    """A number in (0, 1) fixed by the doc_id and the seed."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from ``sources(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target ends at ``max_epochs`` times the source's size and what is above is shared
    again by weight. That settles where every source has min(limit, level * weight), so the
    sources that end at their limit are found by one running sum over limit / weight.
    The window holds one row per source, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(listed, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("above", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("below", F.sum("limit").over(upto) - F.col("limit"))
        # the level if this source and all later ones stay under their limits
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("above"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    settled = F.max(F.when(F.col("free"), F.col("level"))).over(everything)
    return s.select(
        "source", "source_size",
        F.least(F.col("limit"), F.coalesce(settled * F.col("weight"), F.col("limit"))).alias("target"),
    )


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = 7, weight: Column | None = None,
    whole_documents: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(row, doc_id, tie, source, size, source_size, target, taken) for every row of ``docs(doc_id, text, source)``.

    Columns named in ``carry`` come along from the same row.

    ``taken`` counts the words that the mix takes: ``floor(target / source_size)`` whole epochs,
    then documents in key order until the rest of the target is used; the last of them gives the
    words that still fit or, with ``whole_documents``, all of them if its middle lies inside.
    A null text has size 0 and is never taken; a null source is a source of its own. Key ties
    (a doc_id that repeats) are put in the order of the texts' hashes; rows equal in both are
    exchangeable. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = pick(docs, *dict.fromkeys(("doc_id", "text", "source", *carry)))
    rows = scratch.write(
        own.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "source",
            F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("tie"),
            (-F.log(draw(seed)) / (quality() if weight is None else weight)).alias("key"), *[F.col(c).alias(f"own_{c}") for c in carry],
        ),
        "rows",
    )
    sums = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    goal = targets(sums.select("source", "source_size"), weights, max_epochs).join(
        sums.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))
    )
    goal = goal.select(
        F.col("source").alias("of"), "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).alias("epochs"),
        # as many buckets as the source needs for BUCKET_ROWS rows each
        F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"),
    ).withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    goal = scratch.write(goal, "goal")
    # exp(-key) spreads keys evenly enough over (0, 1), and keeps their order
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("buckets"))
    )
    per = placed.groupBy("of", "bucket", "rest").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        per.withColumn("before", F.sum("words").over(so_far) - F.col("words"))
        .filter("before < rest AND before + words >= rest")
        .select(F.col("of").alias("e_of"), F.col("bucket").alias("last"), "before")
    )
    ends = scratch.write(ends, "ends")
    state = placed.join(ends, F.col("of").eqNullSafe(F.col("e_of")), "left")
    inside = state.filter("bucket = last")
    in_order = Window.partitionBy("of").orderBy("key", "tie", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.col("before") + F.sum("size").over(in_order) - F.col("size")
    if whole_documents:
        part = F.when(ahead + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(F.lit(0))
    else:
        part = F.least(F.greatest(F.col("rest") - ahead, F.lit(0)), F.col("size"))
    full = state.filter("last IS NULL OR bucket <> last").withColumn(
        "part", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(F.lit(0))
    )
    return full.unionByName(inside.withColumn("part", part)).select(
        "row", "doc_id", "tie", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        *[F.col(f"own_{c}").alias(c) for c in carry if c not in ("doc_id", "source")],
    )


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (1.0 + length(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, 1.0 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS lim, sum(source_size) OVER () AS total FROM s),
w AS (
  SELECT *, sum(weight) OVER () - sum(weight) OVER up + weight AS above, sum(lim) OVER up - lim AS below FROM r
  WINDOW up AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, max(CASE WHEN (total - below) / above * weight <= lim THEN (total - below) / above END) OVER () AS level FROM w),
g AS (SELECT source, source_size, least(lim, coalesce(level * weight, lim)) AS target FROM v),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs FROM g),
o AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target) - e.epochs * e.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (epochs * size + least(greatest(rest - ahead, 0), size))::BIGINT AS taken
FROM o
"""
