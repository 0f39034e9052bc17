"""Run statistics: trace roll-ups, graph distributions, hubs, page ranges, round diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = "prompt_tokens completion_tokens image_tokens total_tokens llm_calls llm_cache_hits llm_cache_misses".split()


def rollup_trace(spans: DataFrame) -> DataFrame:
    """Totals per stage and over all stages (``stage`` null) in one aggregation."""
    have = [c for c in TOKENS if c in spans.columns]
    return spans.rollup("stage").agg(
        F.count("*").alias("calls"),
        F.sum("elapsed_ms").alias("wall_ms"),
        *[F.sum(c).alias(c) for c in have],
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("errors"),
    )


def _totals(spans: DataFrame) -> list[Column]:
    return [
        F.count("*").alias("calls"), F.sum("elapsed_ms").alias("wall_ms"), *[F.sum(c).alias(c) for c in TOKENS if c in spans.columns],
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("errors"),
    ]


def window_rollup(spans: DataFrame, size: str, slide: str | None = None, *, at: str = "ts") -> DataFrame:
    """Totals per stage and window of event time: tumbling, or sliding with ``slide``.

    Spans without a time belong to no window. Windows start at multiples of the slide since 1970.
    """
    span = F.window(at, size, slide) if slide else F.window(at, size)
    out = spans.groupBy(span.alias("w"), "stage").agg(*_totals(spans))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def session_rollup(spans: DataFrame, gap: str, by: list[str], *, at: str = "ts") -> DataFrame:
    """Totals per session: events of the same ``by`` without a pause of ``gap`` or more; it ends ``gap`` after the last."""
    out = spans.groupBy(F.session_window(at, gap).alias("w"), *by).agg(*_totals(spans))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def page_summary(nodes: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct nodes, semantic edges and visual entities on every page."""
    key = ["doc_id", "page_id"]
    n = nodes.select("doc_id", F.explode("source_pages").alias("page_id"), "entity_id", "modality").distinct()
    e = edges.filter("edge_type = 'semantic'").select("doc_id", F.explode("source_pages").alias("page_id"), "edge_id").distinct()
    per_n = n.groupBy(*key).agg(F.count("*").alias("nodes"), F.count_if(F.col("modality") == "visual").alias("visual"))
    per_e = e.groupBy(*key).agg(F.count("*").alias("sem_edges"))
    return pages.select(*key).join(per_n, key, "left").join(per_e, key, "left").fillna(0, ["nodes", "visual", "sem_edges"])


def spread_histogram(nodes: DataFrame) -> DataFrame:
    """How many nodes occur on 1, 2, ... pages, with the share of multi-page nodes."""
    h = nodes.groupBy(F.size("source_pages").alias("n_pages")).agg(F.count("*").alias("nodes"))
    many = F.sum(F.when(F.col("n_pages") > 1, F.col("nodes")).otherwise(0))
    share = h.agg(F.round(100.0 * many / F.greatest(F.sum("nodes"), F.lit(1)), 1))
    return h.withColumn("multi_page_pct", share.scalar())


def distributions(nodes: DataFrame, edges: DataFrame, cards: DataFrame) -> DataFrame:
    """(what, value, n) for entity type, modality, edge type and card type."""

    def count(df: DataFrame, col: str, what: str) -> DataFrame:
        return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")

    parts = [
        count(nodes, "entity_type", "entity_type"), count(nodes, "modality", "modality"),
        count(edges, "edge_type", "edge_type"), count(cards, "evidence_type", "card"),
    ]
    return reduce(DataFrame.unionByName, parts)


def confidence_range(edges: DataFrame) -> DataFrame:
    """Least, mean and greatest confidence of the alignment edges."""
    c = edges.filter("edge_type = 'same_as'")
    return c.agg(F.min("confidence").alias("lo"), F.avg("confidence").alias("mean"), F.max("confidence").alias("hi"), F.count("*").alias("n"))


def document_graph(nodes: DataFrame, edges: DataFrame, *, alignment: bool = True) -> DataFrame:
    """Edges between known nodes; with ``alignment`` off only semantic ones."""
    e = edges if alignment else edges.filter("edge_type = 'semantic'")
    ids = nodes.select("entity_id")
    return e.join(ids.withColumnRenamed("entity_id", "src_id"), "src_id", "left_semi").join(
        ids.withColumnRenamed("entity_id", "tgt_id"), "tgt_id", "left_semi"
    )


def top_hubs(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """Highest-degree nodes of the semantic graph."""
    g = document_graph(nodes, edges, alignment=False)
    ends = g.select(F.col("src_id").alias("entity_id")).unionByName(g.select(F.col("tgt_id").alias("entity_id")))
    top = ends.groupBy("entity_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "entity_id").limit(k)
    return top.join(nodes.select("entity_id", "name"), "entity_id")


def page_ranges(pages: Column) -> Column:
    """``1,4-6`` for [1, 4, 5, 6]: run starts and ends are found inside the array."""
    p = F.array_sort(F.array_distinct(pages))
    has = lambda x, d: F.array_contains(p, x + F.lit(d).cast("bigint"))
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    runs = F.zip_with(
        starts, ends,
        lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))),
    )
    return F.array_join(runs, ",")


def round_diff(snapshots: DataFrame) -> DataFrame:
    """New and preserved nodes and edges of every round against the round before.

    ``snapshots(doc_id, page_id, round_idx, node_ids array, edge_keys array)``.
    """
    run = Window.partitionBy("doc_id", "page_id").orderBy("round_idx")
    out = snapshots
    for col, name in (("node_ids", "nodes"), ("edge_keys", "edges")):
        before = F.coalesce(F.lag(col).over(run), F.array().cast("array<string>"))
        out = out.withColumn(f"_{name}", before)
    for col, name in (("node_ids", "nodes"), ("edge_keys", "edges")):
        out = out.withColumn(f"new_{name}", F.size(F.array_except(col, f"_{name}")).cast("bigint")).withColumn(
            f"kept_{name}", F.size(F.array_intersect(col, f"_{name}")).cast("bigint")
        )
    return out.select("doc_id", "page_id", "round_idx", "new_nodes", "kept_nodes", "new_edges", "kept_edges")
