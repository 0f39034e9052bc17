"""Stage spans and the run manifest."""

from __future__ import annotations

import platform
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.stats import TOKENS, rollup_trace
from quire.sources.workspace import Workspace


class Tracer:
    """Collects one row per stage and appends them to the trace when the run ends."""

    def __init__(self, ws: Workspace, *, enabled: bool = True):
        self.ws, self.enabled = ws, enabled
        self.run_id = uuid.uuid4().hex[:12]
        self.rows: list[dict[str, Any]] = []
        self._open: list[dict[str, Any]] = []

    @contextmanager
    def stage(self, name: str, **tags: Any) -> Iterator[dict[str, Any]]:
        span = {
            "span_id": uuid.uuid4().hex[:12], "parent_span_id": self._open[-1]["span_id"] if self._open else None,
            "stage": name, "start_ns": time.perf_counter_ns(), "ok": True, "type": "stage_timing",
            "trace_id": self.run_id, "run_id": self.run_id, "tags": {k: str(v) for k, v in tags.items()},
            **dict.fromkeys(TOKENS, 0),
        }
        self._open.append(span)
        try:
            yield span
        except Exception as e:
            span.update(ok=False, error=repr(e))
            raise
        finally:
            self._open.pop()
            span["end_ns"] = time.perf_counter_ns()
            span["elapsed_ms"] = (span["end_ns"] - span["start_ns"]) / 1e6
            self.rows.append(span)

    def record_usage(self, replies: DataFrame) -> None:
        """Add the token usage of a table of model replies to the open stage."""
        if not self._open:
            return
        used = ["prompt_tokens", "completion_tokens", "image_tokens", "total_tokens"]
        sums = replies.agg(*[F.coalesce(F.sum(f"r.{c}"), F.lit(0)).alias(c) for c in used], F.count("*").alias("llm_calls")).first()
        for c in [*used, "llm_calls"]:
            self._open[-1][c] += sums[c]
        self._open[-1]["llm_cache_misses"] += sums["llm_calls"]

    def flush(self) -> None:
        if self.enabled:
            self.ws.append_spans(self.rows)
        self.rows = []

    def totals(self) -> dict[str, Any]:
        return {"total_stages": len(self.rows), "total_wall_ms": sum(r["elapsed_ms"] for r in self.rows)} | {
            c: sum(r[c] for r in self.rows) for c in TOKENS
        } | {"errors": sum(not r["ok"] for r in self.rows)}


def report(ws: Workspace) -> DataFrame:
    """Cumulative roll-up of the trace over all invocations."""
    return rollup_trace(ws.spans())


def write_manifest(ws: Workspace, cfg: Any, tracer: Tracer, started: str, *, status: str, failures: list | None = None) -> None:
    import pyspark

    ws.write_json(
        cfg.obs.manifest_path,
        {
            "run_id": tracer.run_id, "dataset": cfg.dataset.name, "config_hash": cfg.hash(), "started_at": started,
            "ended_at": now(), "status": status, "encoder": cfg.encoder.name, "llm": cfg.generator.llm.model,
            "versions": {"python": platform.python_version(), "spark": pyspark.__version__},
            "totals": tracer.totals(), "failures": failures or [],
        },
    )


def now() -> str:
    return datetime.now(timezone.utc).isoformat()
