"""Answer stage: routes, modes, reply parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.ids import strip
from quire.functions.json import loose_object

ROUTES = ("single", "multi", "document_level")
LEVELS = ("high", "medium", "low")


def confidence(value: Column) -> Column:
    return F.when(value.isin(*LEVELS), value).otherwise("low")


def route(reply: Column) -> Column:
    """Route named by the router's reply; anything unknown becomes ``multi``."""
    said = F.try_variant_get(loose_object(reply), "$.route", "string")
    return F.when(said.isin(*ROUTES), said).otherwise("multi")


def answer_mode(route_col: Column, has_images: Column, configured: str = "auto") -> Column:
    """How to answer: ``auto`` fuses both drafts except for document-level questions, and
    without images only texts remain."""
    wanted = (
        F.when(route_col.isin("single", "multi"), "fusion").otherwise("texts") if configured == "auto" else F.lit(configured)
    )
    return F.when((wanted != "images") & ~has_images, "texts").otherwise(wanted)


def parse_answers(replies: DataFrame) -> DataFrame:
    """``replies(qid, reply, default_pages)`` -> text, cited_pages, confidence, reasoning,
    failure_reason. A JSON answer that again holds a JSON object is unwrapped; a reply
    without JSON is the answer itself, with low confidence."""
    empty = lambda v: F.to_json(v) == "{}"
    get = lambda v, name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    outer = loose_object(F.col("reply"))
    nested_text = get(F.col("_outer"), "answer")
    nested = loose_object(F.when(nested_text.rlike(r"^\s*\{"), nested_text))
    rows = replies.withColumn("_outer", outer).withColumn("_inner", nested)
    rows = rows.withColumn("_obj", F.when(empty(F.col("_inner")), F.col("_outer")).otherwise(F.col("_inner")))
    plain = empty(F.col("_outer"))
    obj = F.col("_obj")
    pages = F.transform(get(obj, "cited_pages", "array<variant>"), lambda v: F.try_variant_get(v, "$", "bigint"))
    cited = F.filter(F.coalesce(pages, F.array().cast("array<bigint>")), lambda p: p.isNotNull())
    return rows.select(
        *[c for c in replies.columns if c not in ("reply", "default_pages")],
        F.when(plain, strip(F.col("reply"))).otherwise(F.coalesce(get(obj, "answer"), F.lit(""))).alias("text"),
        F.when(plain | (F.size(cited) == 0), F.col("default_pages")).otherwise(cited).alias("cited_pages"),
        F.when(plain, "low").otherwise(confidence(get(obj, "confidence"))).alias("confidence"),
        F.when(~plain, get(obj, "reasoning")).alias("reasoning"),
        F.when(~plain, get(obj, "failure_reason")).alias("failure_reason"),
    )
