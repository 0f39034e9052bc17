"""Deterministic ids as plain column expressions.

A version-5 UUID starts with the raw SHA-1 of namespace + name (version and variant
bits begin at hex digit 13), so its first 12 hex digits need no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 OID namespace.
OID_NAMESPACE_HEX = "6ba7b8129dad11d180b400c04fd430c8"


def _uuid5_prefix(key: Column) -> Column:
    raw = F.concat(F.unhex(F.lit(OID_NAMESPACE_HEX)), F.encode(key, "UTF-8"))
    return F.substring(F.sha1(raw), 1, 12)


def entity_id(doc_id: Column, name: Column) -> Column:
    return F.concat(F.lit("E:"), _uuid5_prefix(F.concat(doc_id, F.lit("::"), F.lower(name))))


def edge_id(doc_id: Column, src_id: Column, tgt_id: Column, relation: Column) -> Column:
    key = F.concat(doc_id, F.lit("::"), src_id, F.lit("->"), tgt_id, F.lit("::"), F.lower(relation))
    return F.concat(F.lit("R:"), _uuid5_prefix(key))


def align_edge_id(src_id: Column, tgt_id: Column, relation: Column) -> Column:
    key = F.concat(F.lit("ALIGN::"), src_id, F.lit("::"), tgt_id, F.lit("::"), relation)
    return F.concat(F.lit("A:"), _uuid5_prefix(key))


def page_evidence_id(doc_id: Column, page_id: Column) -> Column:
    return F.concat(F.lit("page:"), doc_id, F.lit(":"), page_id.cast("string"))


def norm_name(name: Column) -> Column:
    """Name key used to match operations to nodes: trimmed and lower-cased."""
    return F.lower(strip(name))


def strip(text: Column) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def card_hash(*cols: str) -> Column:
    """Content hash of a card: everything but its id, in a canonical JSON form."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)
