"""Stored tables that are bucketed and sorted by a key: joins and lookups on it read them in place.

Spark takes the partitioning of such a table as it is, so the other side of a join is brought to the
buckets and the table itself never moves. A table is a plain folder; the session's catalogue only
needs a name for it, which is made up from the path and can be made again at any time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a bucket holds on average.
BUCKET_ROWS = 1_000_000


def _name(path: str) -> str:
    return "quire_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _quoted(path: str) -> str:
    return path.replace("\\", "\\\\").replace("'", "\\'")


def bucket_count(rows: int, *, each: int = BUCKET_ROWS) -> int:
    """Buckets for so many rows; they grow with the table and so keep their size."""
    return max(1, -(-rows // each))


def store(df: DataFrame, path: str, key: str | list[str], buckets: int) -> DataFrame:
    """Write ``df`` to a new folder, one sorted file for each bucket of ``key``, and return it as stored."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(_name(path))
    return spark.table(_name(path))


def opened(spark: SparkSession, path: str, key: str | list[str], buckets: int, schema: str) -> DataFrame:
    """A folder that ``store`` has written, also in another session."""
    if not spark.catalog.tableExists(_name(path)):
        keys = ", ".join(f"`{k}`" for k in ([key] if isinstance(key, str) else key))
        spark.sql(
            f"CREATE TABLE {_name(path)} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{_quoted(path)}'"
        )
    return spark.table(_name(path))


def forget(spark: SparkSession, path: str) -> None:
    """Drop the name and the folder."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lookup(wanted: DataFrame, stored: DataFrame, key: str, *value: str) -> DataFrame:
    """``wanted`` with ``found`` and the ``value`` columns of the stored row with its key.

    Every wanted row comes back once, in place of its order column if it has one; a key that is not
    there, or null, has ``found`` false and null values. Only the wanted keys are exchanged.
    """
    kept = stored.select(F.col(key).alias("_key"), F.lit(True).alias("_found"), *value)
    return wanted.join(kept, F.col(key) == F.col("_key"), "left").select(*wanted.columns, F.coalesce("_found", F.lit(False)).alias("found"), *value)
