"""The registered queries of this subpackage, each an operator over its whole table, and the digests they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, decontaminate, divergence, hard_negatives, html_text, language, line_templates, minhash, neighbours, packing, pii, repeats, token_files

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digest(table(spark, folder, "documents"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), words=2, percent=80)


def packing_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces and their places, with a checksum of the ids in place of the ids."""
    pieces = packing.token_pieces(docs, tokenizer_path)
    digest = pieces.select("piece_id", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return digest.join(packing.pack(pieces), "piece_id").drop("piece_id")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_digest(table(spark, folder, "documents"), vocabulary())


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(table(spark, folder, "documents"))


def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removal_digest(table(spark, folder, "documents"))


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(table(spark, folder, "documents").select("doc_id", "text"), every_line=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", "verbatim")


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicate_vectors(table(spark, folder, "embeddings"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.tokens_round_trip(spark, table(spark, folder, "documents"), vocabulary())


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.packing_digest(table(spark, folder, "documents"), vocabulary())


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


QUERIES = (
    op1_pii, op2_near_duplicates, op3_packing, op4_language_id, op5_repeats, op6_main_text, op7_line_dedup, op8_decontamination,
    op9_near_vectors, op10_token_files, op11_best_fit_packing, op12_hard_negatives, op13_source_divergence,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}
