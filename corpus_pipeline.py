"""A corpus pipeline over `documents`: languages, recurring lines, near-duplicates, benchmark passages, packing.

SQL can't express the first and the last stage; `tests/llm` holds the pipeline
against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, language, line_templates, minhash
from lexiloom.llm.common import fresh, stored
from lexiloom.llm.queries import packing_digest, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter go."""
    model = language.train(docs.where(~language.held_out(docs) & F.col("doc_id").isNotNull()).select("lang", "text"))
    names = fresh(docs, "lang_pred", "score")
    return language.labelled(docs, model, tuple(names)).where(F.col(names[0]) != language.UNKNOWN).select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without recurring lines; `n_chars` follows the text where it changed."""
    names = fresh(docs, "n_lines", "n_dropped")
    cleaned = line_templates.drop_recurring_lines(docs, counts=tuple(names), every_line=True)
    if "n_chars" in docs.columns:
        length = F.when(F.col(names[1]) > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    dropped = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(stored(dropped, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences."""
    return packing_digest(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("lines", without_recurring_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
