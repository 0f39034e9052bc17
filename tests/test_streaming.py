"""Log tables under replays and compaction, windows with late events, and state that expires."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import stats
from quire.operators.store import upsert
from quire.sources import buckets
from quire.sources.workspace import Workspace
from quire.streaming import views
from quire.streaming.log_table import LogTable

ROWS = "id string, payload string, n int, pos bigint"


def batches(seed, n=4):
    rng = random.Random(seed)
    return [[(f"k{rng.randrange(30)}", f"b{b} {i}", rng.choice([None, i]), i) for i in range(25)] for b in range(n)]


def once_per_key(rows):
    """A batch as the store sees it: the last version of a key, at its first place."""
    last = {r[0]: r for r in rows}
    first = {}
    for r in rows:
        first.setdefault(r[0], r[3])
    return [(k, r[1], r[2], first[k]) for k, r in last.items()]


def expected(spark, parts):
    out = spark.createDataFrame([], ROWS + ", batch bigint")
    for b, rows in enumerate(parts):
        out = upsert(out, spark.createDataFrame(once_per_key(rows), ROWS).withColumn("batch", F.lit(b).cast("bigint")), "id")
    return sorted(tuple(r) for r in out.select("id", "payload", "n", "batch", "pos").collect())


def content(table):
    return sorted(tuple(r) for r in table.read().select("id", "payload", "n", "batch", "pos").collect())


def test_log_table_equals_batch_upserts(spark, tmp_path):
    parts = batches(1)
    table = LogTable(spark, str(tmp_path / "t"), "id", bucket_rows=8)
    df = lambda b: spark.createDataFrame(parts[b], ROWS)
    for b in range(3):
        table.append(df(b), b)
    want = expected(spark, parts[:3])
    assert content(table) == want
    for b in (1, 0, 2):  # replays overwrite themselves only
        table.append(df(b), b)
    assert content(table) == want
    table.compact()
    assert content(table) == want and not table._children("log")
    table.append(df(1), 1)  # compacted already
    assert not table._children("log")
    table.append(df(3), 3)
    assert table._children("log") == ["batch=3"] and content(table) == expected(spark, parts)
    # the base stays where it is: only the log's rows are exchanged
    plan = table.read()._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    base = [x for x in plan.splitlines() if "FileScan parquet" in x and "Bucketed: true" in x]
    assert base and plan.count("Exchange hashpartitioning") == 1
    table.compact()
    table.compact()
    assert content(table) == expected(spark, parts) and len([n for n in table._children(".") if n.startswith("base-")]) <= 2
    # another session only needs the folder
    m = table._manifest()
    spark.sql(f"DROP TABLE IF EXISTS {buckets._name(table.folder + '/' + m['base'])}")
    assert content(LogTable(spark, table.folder, "id")) == expected(spark, parts)


def test_log_table_edges(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), "id")
    with pytest.raises(Exception, match="nothing was stored"):
        table.read()
    table.append(spark.createDataFrame([("a", None, None, 3), ("a", "x", 1, 9)], ROWS), 0)
    assert content(table) == [("a", "x", 1, 0, 3)]
    with pytest.raises(Exception, match="no id"):
        table.append(spark.createDataFrame([(None, "x", 1, 0)], ROWS), 1)
    table.compact()
    # a later batch may bring a column
    table.append(spark.createDataFrame([("b", "y", 2, 0, "new")], ROWS + ", extra string"), 5)
    assert {r.id: r.extra for r in table.read().collect()} == {"a": None, "b": "new"}


def test_upsert_stream_compacts_on_its_way(spark, tmp_path):
    ws, feed = Workspace(spark, str(tmp_path / "ws")), str(tmp_path / "feed")
    parts = batches(2, 5)
    for rows in parts:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(feed)
        src = spark.readStream.schema(ROWS).json(feed)
        views.upsert_stream(src, ws, "cards", str(tmp_path / "cp"), key="id", compact_every=2).awaitTermination()
    table = views.stored(ws, "cards", key="id")
    assert content(table) == expected(spark, parts) and table._manifest()["upto"] == 3


def test_lookup(spark, tmp_path):
    stored = buckets.store(spark.createDataFrame([(f"k{i}", float(i)) for i in range(50)], "id string, v double"), str(tmp_path / "b"), "id", 4)
    asked = spark.createDataFrame([(0, "k7"), (1, "nobody"), (2, "k7"), (3, None), (4, "k49")], "pos int, id string")
    got = buckets.lookup(asked, stored, "id", "v")
    assert sorted(tuple(r) for r in got.collect()) == [(0, "k7", True, 7.0), (1, "nobody", False, None), (2, "k7", True, 7.0), (3, None, False, None), (4, "k49", True, 49.0)]
    assert buckets.bucket_count(0) == 1 and buckets.bucket_count(1_000_001) == 2


START = datetime(2024, 3, 1, 10)
EVENT = "ts timestamp, stage string, run_id string, elapsed_ms double, ok boolean, total_tokens bigint"


def event(minutes, stage="s", run="r"):
    return (START + timedelta(minutes=minutes), stage, run, float(minutes), minutes % 3 != 0, minutes)


def streamed(spark, folder, files, make, name):
    for rows in files:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    src = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    make(src).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def test_windows_drop_late_events(spark, tmp_path):
    first = [event(m, f"s{m % 2}") for m in range(0, 100, 7)]
    # the newest event is at 98 minutes and the allowance 30, so windows that end by 68 minutes are closed
    second = [event(10, "s0"), event(59, "s1"), event(66, "s0"), event(110, "s1")]
    late = [r for r in second if r[0] < START + timedelta(minutes=60)]
    # what is late is judged by the watermark that the batch before had
    between, flush = [event(97, "s1")], [event(400, "end")]
    rows = [r for r in first + between + second if r not in late]
    for size, slide in (("20 minutes", None), ("20 minutes", "10 minutes")):
        got = streamed(spark, str(tmp_path / f"f{slide}"), [first, between, second, flush], lambda s: views.window_stream(s, size, slide, late="30 minutes"), f"win{bool(slide)}")
        whole = stats.window_rollup(spark.createDataFrame(rows, EVENT), size, slide)
        if slide:  # a late event still counts in a window that is open
            extra = stats.window_rollup(spark.createDataFrame(rows + late, EVENT), size, slide)
            cut = F.col("end") > F.lit(START + timedelta(minutes=68))
            whole = whole.filter(~cut).unionByName(extra.filter(cut))
        assert got == sorted(map(tuple, whole.collect()), key=repr) and len(got) > 8


def test_sessions_in_a_stream(spark, tmp_path):
    first = [event(m, "s", run) for run, ms in (("a", [0, 5, 9, 40, 44]), ("b", [3, 30])) for m in ms]
    second = [event(46, "s", "a"), event(1, "s", "b"), event(55, "s", "b")]
    got = streamed(spark, str(tmp_path / "f"), [first, [event(45, "s", "a")], second, [event(900, "s", "z")]], lambda s: views.session_stream(s, "10 minutes", ["run_id"], late="15 minutes"), "sess")
    kept = first + [event(45, "s", "a"), second[0], second[2]]
    whole = stats.session_rollup(spark.createDataFrame(kept, EVENT), "10 minutes", ["run_id"])
    assert got == sorted(map(tuple, whole.collect()), key=repr) and len(got) == 5


def test_idle_state_expires(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), "doc_id string, page_id bigint, component_id string, round int, seq int, status string, guarded boolean, content_len int, n_nodes int"
    said = []
    # a run over what is there ends only if no batches are made for timers alone
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for k, pause in enumerate((0, 0, 8)):
        time.sleep(pause)
        spark.createDataFrame([("d", 1, "P1", k, 0, "covered", False, 10, 0)], schema).coalesce(1).write.mode("append").json(feed)
        q = views.saturation_stream(spark.readStream.schema(schema).json(feed), ttl_ms=6000).writeStream.outputMode("update")
        q = q.foreachBatch(lambda df, n: said.append((k, [r.decision for r in df.collect()]))).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    by = [sum((d for j, d in said if j == k), []) for k in range(3)]
    assert by[0] == ["saturate"] and by[2] == ["saturate"] and by[1] in ([], ["saturate"])
