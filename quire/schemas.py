"""Column contracts of the stage tables and a helper to complete partial rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = "struct<component_id:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,page_id:bigint>"

PAGES = (
    "doc_id string, page_id bigint, text string, page_image_path string, "
    "figure_image_paths array<string>, page_summary string, metadata map<string,string>"
)
NODES = (
    "entity_id string, doc_id string, name string, entity_type string, modality string, "
    "description string, visual_description string, visual_type string, "
    f"source_components array<string>, bboxes array<{BBOX}>, source_pages array<bigint>, "
    "source_chunks array<string>, metadata map<string,string>"
)
EDGES = (
    "edge_id string, doc_id string, src_id string, tgt_id string, relation string, "
    "edge_type string, description string, visual_evidence_hint string, confidence double, "
    f"source_components array<string>, bboxes array<{BBOX}>, source_pages array<bigint>, "
    "source_chunks array<string>, metadata map<string,string>"
)
CARDS = (
    "evidence_id string, evidence_type string, doc_id string, page_ids array<bigint>, "
    "text_payload string, image_payload string, metadata map<string,string>, graph_refs map<string,string>"
)
COMPONENTS = (
    "doc_id string, page_id bigint, component_id string, block_ids array<int>, type string, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>, score double, text_full string, "
    "html string, image_path string, caption string, role_hint string, position string, "
    "neighbours map<string,string>, merged boolean, ord int"
)
SPAN = (
    "span_id string, parent_span_id string, stage string, start_ns bigint, end_ns bigint, "
    "elapsed_ms double, ok boolean, error string, prompt_tokens bigint, completion_tokens bigint, "
    "image_tokens bigint, total_tokens bigint, llm_calls bigint, llm_cache_hits bigint, "
    "llm_cache_misses bigint, tags map<string,string>, type string, trace_id string, run_id string"
)
_DEFAULTS = {"modality": "text", "edge_type": "semantic", "confidence": 1.0, "description": ""}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def names(ddl: str) -> list[str]:
    return struct(ddl).names


def contract(df: DataFrame, ddl: str) -> list[Column]:
    """The contract's columns as expressions over ``df``; absent ones become empty."""
    cols = []
    for field in struct(ddl).fields:
        if field.name in df.columns:
            col = F.col(field.name)
        elif isinstance(field.dataType, T.ArrayType):
            col = F.array()
        elif isinstance(field.dataType, T.MapType):
            col = F.create_map()
        else:
            col = F.lit(_DEFAULTS.get(field.name))
        cols.append(col.cast(field.dataType).alias(field.name))
    return cols


def conform(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*contract(df, ddl))
