"""Job-status files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.schemas import JOB_STATUS


def read_job_status(spark: SparkSession, folder: str) -> DataFrame:
    """All status files of a folder, one row per job; missing fields are NULL, unreadable files keep `_bad`."""
    return (
        spark.read.schema(f"{JOB_STATUS}, _bad STRING")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_bad")
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )
