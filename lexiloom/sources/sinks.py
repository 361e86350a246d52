"""Writers: chunk store, translation memory, OCR results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.memory import tm_merge

BUCKETS = 64


def write_chunk_store(chunks: DataFrame, path: str, key: str = "file_name", buckets: int = BUCKETS, files_per_bucket: int = 16) -> None:
    """Chunks with vectors as parquet, one folder per bucket of the file name.

    Rows go to (bucket, spread) before writing: one file name with most of the
    chunks is spread over `files_per_bucket` writers of its bucket.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    spread = F.pmod(F.xxhash64(key, "chunk_idx"), F.lit(files_per_bucket))
    (
        chunks.withColumn("bucket", bucket)
        .repartition(F.col("bucket"), spread)
        .write.partitionBy("bucket")
        .mode("overwrite")
        .parquet(path)
    )


def read_chunk_store(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_translation_memory(memory: DataFrame, fresh: DataFrame, new_version: str) -> None:
    """Old memory + fresh pairs -> a new version folder; the newest pair of a text wins. Nothing is overwritten."""
    tm_merge(memory, fresh).write.mode("errorifexists").parquet(new_version)


def ocr_documents(lines: DataFrame, images: DataFrame) -> DataFrame:
    """One nested row per image: language, full text, and its lines in order.

    `lines` has image_id, pos, the box, text, text_corrected and confidence;
    `images` has image_id, language and full_text.
    """
    bbox = F.struct("x_min", "y_min", "x_max", "y_max").alias("bbox")
    result = F.struct(
        "pos", bbox, F.col("text").alias("text_original"), "text_corrected", "confidence"
    )
    per_image = lines.groupBy("image_id").agg(F.sort_array(F.collect_list(result)).alias("_lines"))
    results = F.transform(
        "_lines",
        lambda r: F.struct(r["bbox"], r["text_original"], r["text_corrected"], r["confidence"]),
    )
    return per_image.join(images.select("image_id", "language", "full_text"), "image_id", "left").select(
        "image_id", F.coalesce("language", F.lit("unknown")).alias("language"), "full_text", results.alias("results")
    )


def write_ocr_results(documents: DataFrame, path: str) -> None:
    """One JSON document per image, as lines of JSON files."""
    documents.write.mode("overwrite").json(path)
