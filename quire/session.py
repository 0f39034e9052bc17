"""Session set-up and the one way the engine cuts lineage: tables in a shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT_KEY = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANUP_LOCK = threading.Lock()
#: Writes under way by session, and what the setting was before the first of them.
_CLEANUP: dict[int, tuple[int, str | None]] = {}


def get_session(app: str = "quire", master: str | None = None, **conf: object) -> SparkSession:
    """Build (or reuse) a session with the settings the engine is tuned for.

    Only defaults that hold at any scale are set; partition counts are left to AQE
    unless the caller passes them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **{k: str(v) for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a private temporary folder, since there executors share the machine.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get(_ROOT_KEY, None) or spark.sparkContext.getConf().get(_ROOT_KEY)
    if root:
        return f"{root.rstrip('/')}/quire-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_ROOT_KEY} to a folder every executor can reach")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def drop_work_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call when its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are deleted as soon as each write has ended."""
    key = id(spark)
    with _CLEANUP_LOCK:
        n, was = _CLEANUP.get(key) or (0, spark.conf.get(_CLEANUP_KEY, None))
        _CLEANUP[key] = n + 1, was
        spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        with _CLEANUP_LOCK:
            n, was = _CLEANUP.pop(key)
            if n > 1:
                _CLEANUP[key] = n - 1, was
            elif was is None:
                spark.conf.unset(_CLEANUP_KEY)
            else:
                spark.conf.set(_CLEANUP_KEY, was)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Iterative plans call this once per round: the lineage ends at files that outlive
    any executor, and the next round plans with real sizes. What was shuffled for the
    table is deleted with the end of the write, as nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._work_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete work tables that no plan still to be run reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._work_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
