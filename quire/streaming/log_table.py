"""An upsert table as a log: batches only append, reads merge, compaction folds the log into the base.

The base is bucketed and sorted by key. A batch writes its own rows into a folder named by its
number and nothing else, so a replayed batch overwrites just itself, and a batch that compaction
has taken in already is left alone. A read brings the log's newest row of each key to the base's
buckets; the base does not move. Manifests are never changed: the one with the highest number
counts, and it names the base and the last batch in it, so readers see a whole table at any moment.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import StageError
from quire.sources import buckets


class LogTable:
    """Rows by ``key``; the newest batch wins, and a replaced row keeps its first place (batch, pos).

    Rows need a key: null ones are refused. Within a batch the row with the highest ``pos`` wins.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, *, bucket_rows: int = buckets.BUCKET_ROWS) -> None:
        self.spark, self.folder, self.key, self.bucket_rows = spark, folder.rstrip("/"), key, bucket_rows

    # ---- files -------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.folder}/{name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self) -> dict[str, Any]:
        """The newest complete manifest; an interrupted one has its temporary name still."""
        found = [n for n in self._children("manifests") if n.endswith(".json")]
        if not found:
            return {"number": 0, "upto": -1, "base": None, "schema": None, "buckets": 1}
        text = self.spark.read.text(f"{self.folder}/manifests/{found[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict[str, Any]) -> None:
        name = f"{manifest['number']:012d}"
        fs, draft = self._fs(f"{self.folder}/manifests/{name}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.folder}/manifests/{name}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise StageError(f"manifest {name} of {self.folder} was published by another compaction")

    # ---- rows --------------------------------------------------------------------------------

    def append(self, rows: DataFrame, batch: int) -> None:
        """Store a batch of ``rows(key, pos, ...)``; the same batch again changes nothing."""
        if batch <= self._manifest()["upto"]:
            return
        cols = [c for c in rows.columns if c not in (self.key, "pos", "batch")]
        key = F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"a row has no {self.key}"))).otherwise(F.col(self.key))
        newest = rows.withColumn(self.key, key).groupBy(self.key).agg(F.max_by(F.struct(*cols), "pos").alias("v"), F.min("pos").alias("pos"))
        newest.select(self.key, *[F.col(f"v.{c}").alias(c) for c in cols], "pos").write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")

    def _log(self, after: int) -> DataFrame | None:
        own = [n for n in self._children("log") if n.startswith("batch=") and int(n[6:]) > after]
        if not own:
            return None
        paths = [f"{self.folder}/log/{n}" for n in own]
        rows = self.spark.read.option("basePath", f"{self.folder}/log").option("mergeSchema", "true").parquet(*paths)
        cols = [c for c in rows.columns if c not in (self.key, "pos", "batch")]
        place = F.struct(F.col("batch").cast("bigint").alias("batch"), F.col("pos").cast("bigint").alias("pos"))
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*cols), "batch").alias("v"), F.min(place).alias("first"))

    def read(self) -> DataFrame:
        """The table now: (key, columns, batch, pos)."""
        m = self._manifest()
        log, base = self._log(m["upto"]), None
        if m["base"]:
            base = buckets.opened(self.spark, f"{self.folder}/{m['base']}", self.key, m["buckets"], m["schema"])
        if log is None:
            if base is None:
                raise StageError(f"nothing was stored in {self.folder} yet")
            return base
        if base is None:
            return log.select(self.key, "v.*", "first.batch", "first.pos")
        cols = [c for c in base.columns if c not in (self.key, "batch", "pos")]
        fresh = log.select(F.col(self.key).alias("_key"), "v", "first")
        new = [c for c in log.schema["v"].dataType.names if c not in cols]
        has = F.col("_key").isNotNull()
        value = [F.when(has, F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) if c in log.schema["v"].dataType.names else F.col(c) for c in cols]
        old = F.col(self.key).isNotNull()
        return base.join(fresh, F.col(self.key) == F.col("_key"), "full").select(
            F.coalesce(self.key, "_key").alias(self.key), *value, *[F.col(f"v.{c}").alias(c) for c in new],
            F.when(old, F.col("batch")).otherwise(F.col("first.batch")).alias("batch"), F.when(old, F.col("pos")).otherwise(F.col("first.pos")).alias("pos"),
        )

    def compact(self) -> None:
        """Fold all batches so far into a new base; readers of the one before still finish."""
        m = self._manifest()
        done = [int(n[6:]) for n in self._children("log") if n.startswith("batch=")]
        upto = max(done, default=-1)
        if upto <= m["upto"]:
            return
        rows, base = self.read(), f"base-{uuid.uuid4().hex}"
        n = buckets.bucket_count(rows.count(), each=self.bucket_rows)
        stored = buckets.store(rows, f"{self.folder}/{base}", self.key, n)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
        self._publish({"number": m["number"] + 1, "upto": upto, "base": base, "schema": schema, "buckets": n, "before": m["base"]})
        for batch in done:
            fs, p = self._fs(f"{self.folder}/log/batch={batch}")
            fs.delete(p, True)
        # the base before the last one has had a whole compaction's time for its readers
        if m.get("before"):
            buckets.forget(self.spark, f"{self.folder}/{m['before']}")
