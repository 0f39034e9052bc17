"""Mutable views of the knowledge graph and of the card index, as table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Replace by key, append new keys; a replaced row keeps its first position.

    Both sides carry ``batch`` and ``pos``; the position of a row is (first_batch,
    first_pos), so appending needs no global counter.
    """
    cols = [c for c in incoming.columns if c not in (key, "batch", "pos")]
    rows = existing.unionByName(incoming, allowMissingColumns=True)
    at = F.struct("batch", "pos")
    merged = rows.groupBy(key).agg(F.max_by(F.struct(*cols), at).alias("v"), F.min(at).alias("first"))
    return merged.select(key, *[F.col(f"v.{c}").alias(c) for c in cols], F.col("first.batch").alias("batch"), F.col("first.pos").alias("pos"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and every edge that touches one of them."""
    ids = doomed.select("entity_id").distinct()
    left = nodes.join(ids, "entity_id", "left_anti")
    for side in ("src_id", "tgt_id"):
        edges = edges.join(ids.withColumnRenamed("entity_id", side), side, "left_anti")
    return left, edges


def delete_edges(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    return edges.join(doomed.select("edge_id").distinct(), "edge_id", "left_anti")


def with_implied_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus a bare row for every endpoint an edge names but no node has."""
    ends = edges.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_id")).distinct()
    return nodes.unionByName(ends.join(nodes, "entity_id", "left_anti"), allowMissingColumns=True)


def neighbours(edges: DataFrame) -> DataFrame:
    """(entity_id, edge_id, neighbour_id): outgoing, then incoming; an edge once per node."""
    out = edges.select(F.col("src_id").alias("entity_id"), "edge_id", F.col("tgt_id").alias("neighbour_id"))
    back = edges.filter("src_id <> tgt_id").select(
        F.col("tgt_id").alias("entity_id"), "edge_id", F.col("src_id").alias("neighbour_id")
    )
    return out.unionByName(back)


def aligned_entities(edges: DataFrame) -> DataFrame:
    """(entity_id, aligned): distinct same_as partners in either direction."""
    return neighbours(edges.filter("edge_type = 'same_as'")).select("entity_id", F.col("neighbour_id").alias("aligned")).distinct()


def relation_meta(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("edge_id"), "edge_id", "left_semi")
