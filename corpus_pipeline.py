"""From raw documents to a tokenised training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's documents. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.base import Scratch, pick, table
from quire.llm.bpe import Tokenizer
from quire.llm.exact_dedup import exact_duplicates, normalised
from quire.llm.language import UNKNOWN, identify, train
from quire.llm.mixing import mix
from quire.llm.partenum import similar_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share this many percent of their distinct runs of so many words.
NEAR_PERCENT, NEAR_WORDS = 80, 5
#: Passes over the texts for the signatures of near duplicates, which are several times the text.
NEAR_PASSES = 3
VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that have no language: those without text or without any letter."""
    own = pick(docs, *COLUMNS)
    return identify(own, train(own)).filter(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (but for white space), the one with the smallest doc_id stays.

    Rows that also repeat the doc_id are one document; one of them stays.
    """
    own = pick(docs, *COLUMNS).withColumn("h", F.sha2(F.encode(normalised(), "UTF-8"), 256))
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("k"))
    stay = own.join(kept.hint("merge"), (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    return stay.dropDuplicates(["h"]).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents, the one with the smallest doc_id of its group stays.

    A document is its doc_id and text: others with the same doc_id, or none, are not affected.
    """
    own = pick(docs, *COLUMNS)
    found = similar_documents(own, words=NEAR_WORDS, percent=NEAR_PERCENT, passes=NEAR_PASSES)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t"))
    return own.join(gone.hint("merge"), same, "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their targets: a document stands as often as the mix takes it whole."""
    taken = mix(pick(docs, *COLUMNS), whole_documents=True, carry=COLUMNS).filter("taken > 0")
    times = (F.col("taken") / F.col("size")).cast("int")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, checked by decoding them again."""
    tokenizer = Tokenizer(public_tokenizers.path(VOCABULARY))
    coded = tokenizer.encode_and_decode(pick(docs, "doc_id", "text", "source"), keep_text=True)
    return coded.select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe", tokenise),
]
#: Neither the language models nor the components of the similarity join can be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
