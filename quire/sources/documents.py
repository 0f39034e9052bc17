"""Where pages come from: layout files of an outside parser, or PDF text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import IngestError
from quire.operators.layout import LAYOUT, layout_pages
from quire.schemas import PAGES, contract


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Layout JSON files (``<doc>_middle.json``) -> pages with blocks and page size.

    A file that cannot be read or holds no page gives one row without ``page_id``, so that its
    loss is seen.
    """
    raw = spark.read.schema(LAYOUT).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    doc = F.regexp_replace(name, r"(_middle)?\.json$", "")
    files = raw.select(doc.alias("doc_id"), "pdf_info")
    pages = layout_pages(files.filter(F.size("pdf_info") > 0))
    bad = files.filter(F.coalesce(F.size("pdf_info"), F.lit(0)) <= 0).select("doc_id")
    return pages.unionByName(bad, allowMissingColumns=True)


def read_pdfs(spark: SparkSession, path: str, **_: Any) -> DataFrame:
    """PDF text by page, one task per file. Needs the optional ``pypdfium2`` package."""
    try:
        import pypdfium2  # noqa: F401
    except ImportError as e:
        raise IngestError("reading PDF files needs the pypdfium2 package; supply layout JSON instead") from e

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pypdfium2

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                pdf = pypdfium2.PdfDocument(content)
                yield pd.DataFrame(
                    [(file, n + 1, pdf[n].get_textpage().get_text_range()) for n in range(len(pdf))],
                    columns=["path", "page_id", "text"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    rows = files.mapInPandas(pages, "path string, page_id bigint, text string")
    doc = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.pdf$", "")
    return rows.select(doc.alias("doc_id"), "page_id", "text")


READERS: dict[str, Callable[..., DataFrame]] = {"mineru": read_layouts, "pypdfium": read_pdfs}


def ingest(spark: SparkSession, parser: str, path: str) -> DataFrame:
    """Pages from ``path`` by the recipe's parser: page columns, plus blocks and size where known."""
    if parser not in READERS:
        raise IngestError(f"unknown parser {parser!r}; have {', '.join(READERS)}")
    rows = READERS[parser](spark, path)
    extra = [c for c in ("page_w", "page_h", "blocks") if c in rows.columns]
    return rows.select(*contract(rows, PAGES), *extra)


def drop_empty_pages(pages: DataFrame) -> DataFrame:
    """Keep pages with text, an image or figures."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") != ""
    image = F.coalesce(F.col("page_image_path") != "", F.lit(False))
    return pages.filter(text | image | (F.size("figure_image_paths") > 0))
