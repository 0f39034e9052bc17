"""Incremental forms of the trace roll-up, whole and by event time, the index upsert and the saturation state."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from quire.operators.patch import REOPENING, SATURATING
from quire.operators.stats import TOKENS, session_rollup, window_rollup
from quire.schemas import SPAN, struct
from quire.sources.workspace import Workspace
from quire.streaming.log_table import LogTable


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Spans as they are appended to the trace folder."""
    return spark.readStream.schema(struct(SPAN)).json(folder).filter("type = 'stage_timing'")


def running_rollup(spans: DataFrame) -> DataFrame:
    """Per-stage totals so far; write with output mode ``complete`` or ``update``."""
    return spans.groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum("elapsed_ms").alias("wall_ms"),
        *[F.sum(c).alias(c) for c in TOKENS if c in spans.columns],
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("errors"),
    )


def window_stream(spans: DataFrame, size: str, slide: str | None = None, *, late: str, at: str = "ts") -> DataFrame:
    """Roll-up per event-time window; write with output mode ``append``.

    A window is final once the newest event is ``late`` past its end: what comes for it after
    that is dropped, and its state goes.
    """
    return window_rollup(spans.withWatermark(at, late), size, slide, at=at)


def session_stream(spans: DataFrame, gap: str, by: list[str], *, late: str, at: str = "ts") -> DataFrame:
    """Roll-up per run of events without a pause of ``gap``; late events as in ``window_stream``."""
    return session_rollup(spans.withWatermark(at, late), gap, by, at=at)


def upsert_stream(cards: DataFrame, ws: Workspace, table: str, checkpoint: str, *, key: str = "evidence_id", compact_every: int = 16) -> StreamingQuery:
    """Keep the log table ``table`` up to date with a stream of cards; the newest version of a key wins.

    ``cards`` carries ``pos``, its order inside a batch. A micro-batch writes its own rows only,
    and one that is replayed after a failure just overwrites those. Read with ``stored``.
    """
    log = stored(ws, table, key=key)

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            log.append(batch, number)
        if number % compact_every == compact_every - 1:
            log.compact()

    return cards.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(ws: Workspace, table: str, *, key: str = "evidence_id") -> LogTable:
    return LogTable(ws.spark, ws.path(table), key)


class Saturation(StatefulProcessor):
    """One flag per component; it goes when the component had no review for ``ttl_ms``."""

    def __init__(self, ttl_ms: int | None, min_chars: int, min_nodes: int) -> None:
        self.ttl_ms, self.min_chars, self.min_nodes = ttl_ms, min_chars, min_nodes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flag = handle.getValueState("saturated", "saturated boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        on = bool(self.flag.get()[0]) if self.flag.exists() else False
        # chunks are sorted one by one and merged, so no second copy of a key's rows is made
        use = ["round", "seq", "status", "guarded", "content_len", "n_nodes"]
        chunks = [sorted(c[use].itertuples(index=False, name=None), key=lambda r: r[:2]) for c in rows]
        said: list[tuple[bool, str]] = []
        for _, _, status, guarded, chars, nodes in merge(*chunks, key=lambda r: r[:2]):
            was = on
            if status in SATURATING and guarded and chars > self.min_chars and nodes < self.min_nodes:
                on = False
                said.append((on, "deny_sanity"))
            elif status in SATURATING or status in REOPENING:
                on = status in SATURATING
                if on != was:
                    said.append((on, "saturate" if on else "unsaturate"))
        self.flag.update((on,))
        if said:
            yield pd.DataFrame([(*key, *s) for s in said], columns=["doc_id", "page_id", "component_id", "saturated", "decision"])

    def close(self) -> None:
        pass


def saturation_stream(reviews: DataFrame, *, min_chars: int = 200, min_nodes: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """Saturation state per component, updated with every review; write with output mode ``update``.

    ``reviews(doc_id, page_id, component_id, round, seq, status, guarded boolean,
    content_len, n_nodes)``; emits (doc_id, page_id, component_id, saturated, decision) per
    change or refusal. Reviews of a micro-batch count in the order of (round, seq). With ``ttl_ms``
    a component that is not reviewed for so long starts again as not saturated; such a stream has
    a timer to serve at all times, so run it with a processing-time trigger, or with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off for a run that ends. Needs the RocksDB state
    store, which ``get_session`` sets.
    """
    return reviews.groupBy("doc_id", "page_id", "component_id").transformWithStateInPandas(
        Saturation(ttl_ms, min_chars, min_nodes), "doc_id string, page_id bigint, component_id string, saturated boolean, decision string",
        "Update", "None" if ttl_ms is None else "ProcessingTime",
    )
