"""Ranks and folds over groups that may be arbitrarily large."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import appended
from quire.session import materialize

#: Rows of one group that a task streams at most; only how the work is dealt out depends on it.
SLICE_ROWS = 100_000


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """0-based position of each row inside its group, without one task per group.

    Rows are range-partitioned on (keys, order), ranked inside (keys, partition), and
    shifted by the sizes of the earlier partitions. A group holding a third of all rows
    is spread over a third of the partitions.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in keys + order])
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ordinal")
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(local) - 1)
        .join(shift, [*keys, "_part"])
        .withColumn(out, F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )


def fold_texts(
    df: DataFrame, keys: list[str], order: str, text: str, max_chars: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Ordered description merge per group -> (keys, text), equal to one pass from left to right.

    Merging is not associative, so a group's texts stay in their order, repeats included. Each
    task streams sorted rows and carries one running text of at most ``max_chars``. A group of
    more than ``slice_rows`` rows is cut into slices; the text after a slice opens the next
    one, so no task ever sees more of a hot group than one slice.
    """
    rows = df.filter(F.col(text) != "").select(*keys, F.col(order).alias("_ord"), F.col(text).alias("_text"))
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    slices = -(-largest // slice_rows)
    if slices > 1:
        rows = ordinal(rows, keys, ["_ord", "_text"], "_at").withColumn("_slice", F.floor(F.col("_at") / slice_rows)).drop("_at")
        rows = materialize(rows, "fold-rows")
    carried = None
    for turn in range(max(slices, 1)):
        here = (rows.filter(F.col("_slice") == turn).drop("_slice") if slices > 1 else rows).withColumn("_late", F.lit(True))
        if carried is not None:
            none = F.lit(None).cast(here.schema["_ord"].dataType)
            opened = carried.select(*keys, none.alias("_ord"), F.col(text).alias("_text"), F.lit(False).alias("_late"))
            here = here.unionByName(opened.join(here.select(*keys).distinct(), keys, "left_semi"))
        merged = _stream_fold(here, keys, text, max_chars)
        if slices > 1:
            if carried is not None:
                merged = merged.unionByName(carried.join(merged.select(*keys), keys, "left_anti"))
            merged = materialize(merged, "fold")
        carried = merged
    return carried


def _stream_fold(rows: DataFrame, keys: list[str], text: str, max_chars: int) -> DataFrame:
    """One running text per group over rows sorted by (keys, _late, _ord)."""
    # Equal orders are put in the order of their texts, so reruns agree.
    flat = rows.select(F.struct(*keys).alias("k"), "_late", "_ord", "_text")
    dealt = flat.repartition("k").sortWithinPartitions("k", "_late", "_ord", "_text").select("k", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, said = None, ""
        for batch in batches:
            ks, out = batch.column(0), []
            for k, part in zip(ks.to_pylist(), batch.column(1).to_pylist()):
                if last is not None and k == last:
                    said = appended(said, part, max_chars)
                    continue
                if last is not None:
                    out.append((last, said))
                last, said = k, part
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], ks.type), pa.array([t for _, t in out], pa.string())], names=["k", text])
            kind = ks.type
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([said], pa.string())], names=["k", text])

    schema = T.StructType([dealt.schema["k"], T.StructField(text, T.StringType())])
    return dealt.mapInArrow(run, schema).select("k.*", text)


def top_per_group(
    df: DataFrame, keys: list[str], order: list, k: int, out: str = "_n", salts: int = 64
) -> DataFrame:
    """First ``k`` rows per group with their 1-based rank in ``out``.

    Small limits are pruned map-side by the optimizer. Beyond its threshold a salted
    first cut keeps any one task's share of a hot group at 1/salts plus k rows per salt.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_pre", F.row_number().over(pre)).filter(F.col("_pre") <= k).drop("_pre", "_salt")
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(final)).filter(F.col(out) <= k)
