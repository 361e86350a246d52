"""Following folders: new files -> segments -> each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import is_blank
from lexiloom.operators.memory import IDENTITY, with_key
from lexiloom.sources.corpus import text_files
from lexiloom.sources.docx import docx_runs

DOCX_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def translate_once(segments: DataFrame, target_lang: str, style: str = "General", text: str = "text", ts: str | None = None, within: str = "7 days") -> DataFrame:
    """Lets every text through once per target and style; blank texts never.

    With an event time, a text counts as seen for `within` after its last
    sighting and state stays bounded; without one it is remembered for good.
    """
    keyed = with_key(segments, target_lang, style, text).filter(F.col("key").isNotNull())
    if ts is None:
        return keyed.dropDuplicates(IDENTITY)
    return keyed.withWatermark(ts, within).dropDuplicatesWithinWatermark(IDENTITY)


def follow_texts(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of the non-blank lines of new text files: path, file_name, para_idx, text."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    lines = text_files(spark, reader, folder).select("path", "file_name", F.posexplode(F.split("text", "\n", -1)).alias("para_idx", "text"))
    return lines.filter(~is_blank(F.col("text")))


def follow_documents(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of the non-blank text elements of new Word files, as run rows."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(DOCX_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.docx")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    return docx_runs(files).filter(~is_blank(F.col("text")))
