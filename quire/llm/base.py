"""What the operators of this package share: reading tables, safe column picking, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import work_root

#: The white space of the word rules; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, found by exact name and position.

    Other columns never clash, also when their names differ in case only or repeat.
    """
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def numbered(df: DataFrame) -> DataFrame:
    """Columns under numbers, as a task that reads them by position needs no names."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def added(df: DataFrame, names: list[str], *fields: T.StructField) -> T.StructType:
    """Schema of the named columns followed by new fields."""
    kinds = {f.name: f for f in reversed(df.schema.fields)}
    return T.StructType([kinds[n] for n in names] + list(fields))


def whole(text: str | Column = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def give_back() -> None:
    """Return memory that a Python task no longer needs: workers live on, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


class Scratch:
    """Tables in the shared folder that one operator call needs; ``drop`` frees a table early.

    A table cuts lineage at files that every executor reads, so lost executors cost only
    their running tasks. What is not dropped goes with the application's work folder.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let go of the shuffle files of plans that nothing refers to any more.

        Spark deletes them when its driver collects garbage; between passes that move much, that
        is asked for instead of left to chance.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
