"""Text folders: chunks -> vectors -> store; questions -> nearest chunks -> grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.inference import Factory, embed_batch, grade_batch
from lexiloom.operators.retrieval import chunk_corpus, retrieve_topk, split_by_grade, union_chunks
from lexiloom.session import materialize
from lexiloom.sources.corpus import read_text_corpus
from lexiloom.sources.sinks import write_chunk_store


def ingest(spark, folders: list[str], store: str, factory: Factory, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, rejects: str | None = None) -> None:
    """Chunks of all text files below the folders, embedded and written as a store.

    A chunk's id is its file and position, so it is unique at any size of corpus.
    Chunks that got no vector stay out of the store; with `rejects` they are
    written there as Parquet, to be tried again.
    """
    parts = [chunk_corpus(read_text_corpus(spark, f), "path", size=size, overlap=overlap) for f in folders]
    named = union_chunks(parts).withColumns(
        {
            "file_name": F.element_at(F.split("path", "/"), -1),
            "vec_id": F.concat_ws("#", "path", F.col("chunk_idx").cast("string")),
        }
    )
    embedded = materialize(embed_batch(named, factory))
    write_chunk_store(embedded.filter(F.col("embedding").isNotNull()), store)
    if rejects is not None:
        embedded.filter(F.col("embedding").isNull()).drop("embedding").write.mode("overwrite").parquet(rejects)


def answerable(store: DataFrame, questions: DataFrame, embed: Factory, grade: Factory, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(relevant chunks per question, questions without any)."""
    found = retrieve_topk(store, embed_batch(questions, embed, "question"), k)
    pairs = found.join(store.select("vec_id", F.col("text").alias("document")), "vec_id").join(
        questions.select("query_id", "question"), "query_id"
    )
    return split_by_grade(grade_batch(pairs, grade), questions)
