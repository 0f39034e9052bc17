"""Iterative graph operators: components, spanning forest, bounded search, communities.

Every round is one small DataFrame plan; its result is written to the shared folder so
that lineage stays short and lost executors only cost their own tasks. Vertices with a
very large neighbourhood never form one task: minima are combined map-side and the
join back to the edges carries one row per vertex on the other side, which AQE splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.ordering import ordinal, top_per_group
from quire.session import materialize


def _mirror(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex that occurs in an edge; the least id names it.

    Alternating large-star / small-star contraction: O(log n) rounds, and no round emits
    more rows than there are edges.
    """
    state = materialize(
        edges.filter(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "components",
    )
    before = _signature(state)
    while before[0]:
        both = _mirror(state)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            ).alias("e")
        )
        state = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "components")
        after = _signature(state)
        if after == before:
            break
        before = after
    leaves = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def spanning_forest(edges: DataFrame, order: list[str]) -> DataFrame:
    """Minimum spanning forest of ``edges(a, b, ...)`` under a strict total ``order``.

    Boruvka rounds: every component picks its first outgoing edge (a map-side combined
    minimum), chosen edges are contracted, inner edges are dropped. With a total order
    the result is the one an ordered union-find pass would keep.
    """
    cols = edges.columns
    live = materialize(edges.withColumn("u", F.col("a")).withColumn("v", F.col("b")).filter("u <> v"), "forest")
    chosen: list[DataFrame] = []
    while live.limit(1).count():
        pick = F.struct(*order, *[c for c in cols if c not in order], "u", "v")
        ends = live.select(F.col("u").alias("c"), pick.alias("e")).unionByName(
            live.select(F.col("v").alias("c"), pick.alias("e"))
        )
        best = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "forest-pick")
        chosen.append(best.select(*cols))
        comp = connected_components(best.select("u", "v"), "u", "v")
        left = comp.select(F.col("id").alias("u"), F.col("component").alias("cu"))
        right = comp.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        live = materialize(
            live.join(left, "u", "left")
            .join(right, "v", "left")
            .withColumn("u", F.coalesce("cu", "u"))
            .withColumn("v", F.coalesce("cv", "v"))
            .drop("cu", "cv")
            .filter("u <> v"),
            "forest",
        )
    return reduce(DataFrame.unionByName, chosen) if chosen else edges.limit(0)


def bounded_bfs(
    seeds: DataFrame, edges: DataFrame, *, max_depth: int, max_nodes: int
) -> DataFrame:
    """Nodes within ``max_depth`` out-hops of each query's seeds, at most ``max_nodes``.

    ``seeds(qid, node)``, ``edges(src, dst)`` -> (qid, node, depth). Seeds are kept
    whole; when the cap cuts a level, lower node ids win. At most ``max_nodes`` of a
    node's neighbours can be visited already, so its first ``2 * max_nodes`` neighbours
    always contain every one the cap can admit: hubs are pruned map-side, exactly.
    """
    links = edges.select("src", "dst")
    seen = materialize(seeds.select("qid", "node").distinct().withColumn("depth", F.lit(0)), "bfs")
    if max_nodes <= 0:
        return seen.limit(0)
    frontier = seen
    for depth in range(1, max_depth + 1):
        used = materialize(seen.groupBy("qid").agg(F.count("*").alias("used")), "bfs-used")
        # A question that is full takes no node any more, so its frontier is not expanded.
        frontier = frontier.join(used.filter(F.col("used") < max_nodes).select("qid"), "qid", "left_semi")
        # Only links out of the frontier are looked at, and of those only the useful ones.
        fresh = links.join(frontier.select(F.col("node").alias("src")).distinct(), "src", "left_semi").distinct()
        adj = top_per_group(fresh, ["src"], ["dst"], 2 * max_nodes).drop("_n")
        reach = (
            frontier.select("qid", F.col("node").alias("src")).join(adj, "src")
            .select("qid", F.col("dst").alias("node"))
            .distinct()
            .join(seen.select("qid", "node"), ["qid", "node"], "left_anti")
        )
        step = (
            top_per_group(reach, ["qid"], ["node"], max_nodes)
            .join(used, "qid")
            .filter(F.col("_n") + F.col("used") <= max_nodes)
            .select("qid", "node", F.lit(depth).alias("depth"))
        )
        frontier = materialize(step, "bfs-step")
        seen = seen.unionByName(frontier)
    return seen


def label_propagation(edges: DataFrame) -> DataFrame:
    """(id, label) by label propagation on the undirected multigraph, run until nothing moves.

    A vertex keeps its label when it is among the most frequent ones around it, else it wants the
    least of those. Of neighbours that want to move, the one with the smallest priority of the
    round does, so no two neighbours move at once: every move raises the weight of links whose
    ends agree, and the rounds come to an end on every graph.
    """
    both = materialize(
        _mirror(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v"))
        .groupBy("u", "v")
        .agg(F.count("*").alias("w")),
        "labels-edges",
    )
    labels = materialize(both.select(F.col("u").alias("id"), F.col("u").alias("label")).distinct(), "labels")
    turn = 0
    while True:
        votes = both.join(labels, both.v == labels.id).groupBy("u", "label").agg(F.sum("w").alias("w"))
        own = labels.select(F.col("id").alias("u"), F.col("label").alias("own"))
        best = (
            votes.join(own, "u")
            .groupBy("u", "own")
            .agg(F.min(F.struct(-F.col("w"), F.col("label") != F.col("own"), F.col("label"))).alias("b"))
            .filter(F.col("b.label") != F.col("own"))
        )
        wish = materialize(best.select("u", F.col("b.label").alias("new"), F.struct(F.xxhash64("u", F.lit(turn)), "u").alias("turn")), "wishes")
        if wish.isEmpty():
            return labels
        near = both.join(wish.select(F.col("u").alias("v"), F.col("turn").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        moves = wish.join(near, "u", "left").filter(F.col("other").isNull() | (F.col("turn") < F.col("other")))
        labels = materialize(
            labels.join(moves.select(F.col("u").alias("id"), "new"), "id", "left").select("id", F.coalesce("new", "label").alias("label")), "labels"
        )
        turn += 1


def communities(
    edges: DataFrame, *, algorithm: str = "label_propagation", min_size: int = 3
) -> DataFrame:
    """(community_id, id): communities numbered by size before small ones are dropped.

    Only label propagation is offered; asking for another method raises.
    """
    if algorithm != "label_propagation":
        raise ValueError(f"community algorithm {algorithm!r} is not offered; use label_propagation")
    labels = label_propagation(edges)
    sizes = materialize(labels.groupBy("label").agg(F.count("*").alias("n")), "community-sizes")
    one = sizes.withColumn("_all", F.lit(0)).withColumn("_neg", -F.col("n"))
    ranked = ordinal(one, ["_all"], ["_neg", "label"], "at").filter(F.col("n") >= min_size)
    named = ranked.select("label", F.concat(F.lit("C"), F.col("at").cast("string")).alias("community_id"))
    return labels.join(named, "label").select("community_id", "id")
