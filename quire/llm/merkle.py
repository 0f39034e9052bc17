"""Merkle manifest of a table: every row a leaf, one tree for each group, one more over the groups' roots.

Trees are climbed by *slot pivots*: conditional aggregates spread a parent's children into as many
columns as the tree has fanout. All columns concatenated are hashed to the parent; all but a node's
own column are its siblings, which make up its proof.

Levels are taken several at a time. ``depth`` levels above consecutive nodes form a block of
``fanout ** depth`` nodes; a block is one small group, so its levels need one exchange together, and
a group of any size (one language may hold all rows) is many blocks. The tops of blocks are the
nodes of the next tier, which is smaller by that factor. Positions of leaves come from a sort by
ranges and the counts of the ranges before, so no group is ever in one task. Only ids and digests
travel, never texts; sibling digests are read off where they are used and not stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.base import Scratch, pick

#: Children of a node, levels that are climbed with one exchange, and the fields that a leaf is made of.
FANOUT, DEPTH = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tampered are rows whose id has a checksum divisible by this.
EVERY = 7


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values concatenated."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length ahead, so that neighbouring values cannot run into each other; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, from the leaf's level upwards, come to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof(path: Column) -> Column:
    """One digest for all siblings of a path, level by level and from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def placed(scratch: Scratch, rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in the order of their group from 0, and ``n``, the group's size.

    ``order`` must tell all rows of a group apart.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = scratch.write(rows.repartitionByRange(*by).withColumn("chunk", F.spark_partition_id()), "ranged")
    own = ranged.groupBy(group, "chunk").agg(F.count("*").alias("own"))
    before = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = own.select(
        group, "chunk", (F.sum("own").over(before) - F.col("own")).alias("start"), F.sum("own").over(Window.partitionBy(group)).alias("n")
    )
    here = F.row_number().over(Window.partitionBy(group, "chunk").orderBy(*by[1:]))
    counted = ranged.withColumn("here", here).join(starts, [group, "chunk"])
    return scratch.write(counted.withColumn("pos", F.col("start") + F.col("here") - 1).drop("chunk", "here", "start"), "placed")


def _block(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``nodes(g, pos, n, h, ...)`` with ``block``, its ``top`` and each node's ``path`` up to there."""
    out = nodes.withColumn("block", F.expr(f"pos div {fanout**depth}")).repartition("g", "block")
    out = out.withColumns({"node": F.col("pos"), "left_over": F.col("n"), "top": F.col("h")})
    steps = []
    for level in range(depth):
        out = out.withColumns({"slot": F.col("node") % fanout, "parent": F.expr(f"node div {fanout}")})
        family = Window.partitionBy("g", "block", "parent")
        names = [f"slot{k}" for k in range(fanout)]
        out = out.withColumns({c: F.max(F.when(F.col("slot") == k, F.col("top"))).over(family) for k, c in enumerate(names)})
        part = lambda keep: F.concat(*[F.coalesce(F.when(keep(F.lit(k)), F.col(c)), F.lit("")) for k, c in enumerate(names)])  # noqa: E731, B023
        live = F.col("left_over") > 1
        siblings = F.struct(part(lambda k: k < F.col("slot")).alias("left"), part(lambda k: k > F.col("slot")).alias("right"))
        steps.append(f"step{level}")
        out = out.withColumns({
            steps[-1]: F.when(live, siblings),
            "top": F.when(live, digest(*[F.coalesce(c, F.lit("")) for c in names])).otherwise(F.col("top")),
            "left_over": F.expr(f"(left_over + {fanout - 1}) div {fanout}"), "node": F.col("parent"),
        }).drop(*names)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    return out.withColumn("path", F.array_compact(F.array(*steps)) if steps else empty).drop(*steps, "node", "slot", "parent")


def levels(n: int, fanout: int, most: int) -> int:
    """Levels above ``n`` nodes, ``most`` at most."""
    found = 0
    while found < most and fanout**found < n:
        found += 1
    return found


def climbed(scratch: Scratch, nodes: DataFrame, *, fanout: int = FANOUT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``nodes(g, pos, n, h, ...)`` with ``top``, the root of their group's tree, and ``path`` to it; and (g, top)."""
    size = fanout**depth
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [_block(nodes, fanout, levels(most, fanout, depth))]
    while most > size:
        tops = tiers[-1].filter(F.col("pos") % size == 0).select("g", F.col("block").alias("pos"), F.col("left_over").alias("n"), F.col("top").alias("h"))
        most = -(-most // size)
        tiers.append(_block(scratch.write(tops, f"tier{len(tiers)}"), fanout, levels(most, fanout, depth)))
    roots = scratch.write(tiers[-1].filter("pos = 0").select("g", "top"), "roots")
    above = None
    for tier in reversed(tiers):
        if above is not None:
            up = above.select("g", F.col("pos").alias("block"), F.col("top").alias("up_top"), F.col("path").alias("up_path"))
            tier = tier.join(up, ["g", "block"]).withColumns({"path": F.concat("path", "up_path"), "top": F.col("up_top")}).drop("up_top", "up_path")
        above = tier
    return above.drop("block", "left_over"), roots


def manifest(
    leaves: DataFrame, *, group: str = "lang", order: Sequence[str] = ("doc_id",), fanout: int = FANOUT, depth: int = DEPTH
) -> DataFrame:
    """``leaves`` with subroot, root and path (array of (left, right): the siblings on either side at each level).

    ``leaves`` has ``leaf`` (hex), the group and the order columns; names that begin with one of this
    module's own (g, pos, n, h, top, block, row) are not allowed. In each group leaves ascend by
    ``order``, nulls first, then by digest; rows equal in all that are exchangeable. While a level has
    several nodes, each ``fanout`` consecutive ones (the last run may be shorter) become one. The
    groups' roots, in the order of their names (null first, bytewise), are the leaves of the last tree.
    """
    if fanout < 2 or depth < 1:
        raise ValueError("fanout must be at least 2 and depth at least 1")
    scratch = Scratch(leaves.sparkSession, "merkle")
    # a mark ahead of the name keeps null apart, and ahead of all names
    marked = leaves.withColumns({"g": F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")), "row": F.monotonically_increasing_id()})
    stored = scratch.write(marked, "leaves")
    nodes = placed(scratch, stored, "g", [*order, "leaf", "row"]).withColumn("h", F.col("leaf"))
    low, roots = climbed(scratch, nodes, fanout=fanout, depth=depth)
    tops = placed(scratch, roots.select(F.lit("").alias("all"), F.col("g").alias("name"), F.col("top").alias("h")), "all", ["name"])
    high, _ = climbed(scratch, tops.withColumnRenamed("all", "g"), fanout=fanout, depth=depth)
    high = scratch.write(high.select(F.col("name").alias("g"), F.col("top").alias("root"), F.col("path").alias("up_path")), "groups")
    out = low.withColumnRenamed("top", "subroot").join(high, "g").withColumn("path", F.concat("path", "up_path"))
    return out.select(*leaves.columns, "subroot", "root", "path")


def tampered() -> Column:
    """Which rows of ``docs`` the audit tampers with; never those without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0, F.lit(False))


def audited(docs: DataFrame, *, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) for every row of documents.

    Each row's root is computed anew from its leaf, for tampered rows (n_chars one higher) from the
    changed leaf, and the siblings in the manifest; ``verified`` says whether it is the manifest's root.
    A null stands as ``-`` in a leaf, so an empty text and a null text differ; texts of any length are
    hashed whole. A null doc_id comes first in its language, a null lang is a language of its own;
    repeated rows are leaves of their own, a null n_chars stays null when tampered with. Columns other
    than the five of documents are not looked at, and an empty table gives no rows.
    """
    own = pick(docs, *FIELDS)
    changed = {**{c: F.col(c) for c in FIELDS}, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    leaves = own.select(
        "doc_id", "lang", digest(*[field(F.col(c)) for c in FIELDS]).alias("leaf"),
        F.when(tampered(), digest(*[field(changed[c]) for c in FIELDS])).alias("changed"),
    )
    found = manifest(leaves, fanout=fanout, depth=depth).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Bits of the checksum are worked out one by one: each byte, then seven times nothing, before a shift.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
    " lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x:"
    " xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
)
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_EVEN, _ODD = ("max(h) FILTER (pos % 2 = 0) OVER w", "max(h) FILTER (pos % 2 = 1) OVER w")


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(n_chars if c == 'n_chars' else c) for c in FIELDS)})"


MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN {_CRC} % {EVERY} = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS changed
  FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m,
    row_number() OVER () AS r FROM d),
up(r, doc_id, lang, leaf, pos, m, h, proof, folded) AS (
  SELECT r, doc_id, lang, leaf, pos, m, leaf, '', coalesce(changed, leaf) FROM p UNION ALL
  SELECT r, doc_id, lang, leaf, pos // 2, (m + 1) // 2, sha256(concat({_EVEN}, {_ODD})),
    proof || CASE WHEN pos % 2 = 0 THEN coalesce({_ODD}, '') ELSE {_EVEN} END,
    sha256(CASE WHEN pos % 2 = 0 THEN folded || coalesce({_ODD}, '') ELSE {_EVEN} || folded END)
  FROM up WHERE m > 1 WINDOW w AS (PARTITION BY lang, pos // 2)),
low AS (SELECT * FROM up WHERE m = 1),
s AS (
  SELECT lang, min(h) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM low GROUP BY lang),
top(lang, subroot, pos, m, h, sides) AS (
  SELECT lang, subroot, pos, m, subroot, []::STRUCT(l VARCHAR, r VARCHAR)[] FROM s UNION ALL
  SELECT lang, subroot, pos // 2, (m + 1) // 2, sha256(concat({_EVEN}, {_ODD})),
    list_append(sides, CASE WHEN pos % 2 = 0 THEN {{l: '', r: coalesce({_ODD}, '')}}
      ELSE {{l: {_EVEN}, r: ''}} END)
  FROM top WHERE m > 1 WINDOW w AS (PARTITION BY pos // 2)),
f AS (
  SELECT low.*, t.subroot, t.h AS root, low.proof || list_aggregate(list_prepend('', list_transform(t.sides, lambda x: x.l || x.r)), 'string_agg', '') AS all_sides,
    list_reduce(list_prepend(low.folded, list_transform(t.sides, lambda x: CASE WHEN x.l = '' THEN '>' || x.r ELSE '<' || x.l END)),
      lambda a, x: CASE WHEN x[1] = '>' THEN sha256(a || x[2:]) ELSE sha256(x[2:] || a) END) AS folded_root
  FROM low JOIN top t ON low.lang IS NOT DISTINCT FROM t.lang AND t.m = 1)
SELECT doc_id, leaf, subroot, root, sha256(all_sides) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
