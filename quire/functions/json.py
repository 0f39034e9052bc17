"""Forgiving JSON parsing of model replies, on the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _between(text: Column, opener: str, closer: str) -> Column:
    """From the first opener to the last closer, or null."""
    cut = F.regexp_extract(text, rf"(?s)(\{opener}.*\{closer})", 1)
    return F.when(cut != "", cut)


def strict_json(text: Column) -> Column:
    """The text as one JSON value, or null.

    The parser stops at the end of the first value, so trailing text has to be ruled out:
    a lone value, and nothing else, stays valid both as the only item of a list and as a
    member of an object.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(items) == 1) & member.isNotNull(), F.get(items, F.lit(0)))


def loose_json(text: Column) -> Column:
    """Whole text, else the outermost array, else the outermost object, else null."""
    return F.coalesce(
        strict_json(text),
        strict_json(_between(text, "[", "]")),
        strict_json(_between(text, "{", "}")),
    )


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def loose_object(text: Column) -> Column:
    """Like :func:`loose_json` but always an object: a lone object in a list is unwrapped,
    anything else becomes the empty object."""
    doc = loose_json(text)
    items = F.try_variant_get(doc, "$", "array<variant>")
    only = F.when(F.size(items) == 1, F.element_at(items, 1))
    is_object = lambda v: F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_object(doc), doc).when(is_object(only), only).otherwise(F.parse_json(F.lit("{}")))
