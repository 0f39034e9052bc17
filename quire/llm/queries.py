"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.base import table
from quire.llm.bpe import Tokenizer
from quire.llm.codes import CODES_SQL, report
from quire.llm.exact_dedup import EXACT_SQL, exact_duplicates
from quire.llm.factors import without_repeated_passages
from quire.llm.forest import NEAR_SQL, near_vectors
from quire.llm.language import held_out, identify, train
from quire.llm.licenses import licenses_sql, scan_licenses
from quire.llm.line_dedup import without_common_blocks
from quire.llm.merkle import MANIFEST_SQL, audited, proof
from quire.llm.mixing import MIX_SQL, mix
from quire.llm.partenum import similar_documents
from quire.llm.pii import digest, find_disclosures
from quire.llm.repeats import without_repeats


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_disclosures(table(spark, sf_dir)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, train(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_common_blocks(table(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", "n_partners", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir))


VOCABULARY = "byte_bpe_50k.json"


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = Tokenizer(public_tokenizers.path(VOCABULARY))
    coded = tokenizer.encode(table(spark, sf_dir).select("doc_id", "text"))
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return tokenizer.decode(coded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hexed(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hexed(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir)).select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))


def op13_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_passages(table(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_licenses, op4_near_vectors, op5_repeats, op6_ngram_join, op7_language, op8_line_dedup, op9_exact_dedup, op10_bpe, op11_merkle, op12_codes, op13_factors)}
ORACLES = {"op2_mixing": MIX_SQL, "op3_licenses": licenses_sql(), "op4_near_vectors": NEAR_SQL, "op9_exact_dedup": EXACT_SQL, "op11_merkle": MANIFEST_SQL, "op12_codes": CODES_SQL}
