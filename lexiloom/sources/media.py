"""Listing media files with a verdict on each."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.operators.ocr import file_number
from lexiloom.session import materialize


def _ends_in(path: Column, suffixes: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.lower(path).endswith(s) for s in suffixes])


def media_verdict(files: DataFrame, kind: str) -> DataFrame:
    """`path, length` -> adds `verdict`: accepted, bad_format, empty or too_large; images get their `number`."""
    path, length = F.col("path"), F.col("length")
    if kind == "image":
        ok = F.when(_ends_in(path, fixed.IMAGE_SUFFIXES), "accepted")
        return files.withColumn("verdict", ok.otherwise("bad_format")).withColumn("number", file_number(path))
    if kind == "audio":
        verdict = (
            F.when(~_ends_in(path, fixed.AUDIO_SUFFIXES), "bad_format")
            .when(length == 0, "empty")
            .when(length > fixed.AUDIO_MAX_BYTES, "too_large")
        )
        return files.withColumn("verdict", verdict.otherwise("accepted"))
    if kind == "document":
        ok = F.when(path.endswith(fixed.DOCUMENT_SUFFIX), "accepted")
        return files.withColumn("verdict", ok.otherwise("bad_format"))
    raise ValueError(f"unknown kind of media: {kind}")


def _listed(folder: str) -> list[tuple[str, bool]]:
    """(path, is a folder) of the folders and empty files directly in `folder`.

    Paths have the form that Spark's scan gives (`file:/a/b`, `s3a://bucket/a`),
    and names that the scan hides (those that start with `_` or `.`) are left out.
    """
    scheme, _, rest = folder.partition(":") if ":/" in folder else ("file", "", folder)
    uri = "file://" + "/" + rest.lstrip("/") if scheme == "file" else re.sub("^s3[an]:", "s3:", folder)
    files, root = fs.FileSystem.from_uri(uri)
    rows = []
    for found in files.get_file_info(fs.FileSelector(root)):
        is_folder = found.type == fs.FileType.Directory
        if not found.base_name.startswith(("_", ".")) and (is_folder or found.size == 0):
            rows.append((f"file:{found.path}" if scheme == "file" else f"{scheme}://{found.path}", is_folder))
    return rows


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """`path, length` of empty files, which Spark's own file scan leaves out.

    Folders are listed level by level, each folder by a task of its own; a
    single folder's names are the most that a task holds.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(_listed(path), columns=["path", "folder"])

    level, empty = spark.range(1, numPartitions=1).select(F.lit(folder).alias("path")), None
    while True:
        listed = materialize(level.mapInPandas(work, "path string, folder boolean"))
        found = listed.filter("NOT folder").select("path", F.lit(0).cast("long").alias("length"))
        empty = found if empty is None else empty.unionByName(found)
        level = listed.filter("folder").select("path")
        if level.isEmpty():
            return empty
        level = level.repartition("path")


def media_manifest(spark: SparkSession, folder: str, kind: str, with_empty: bool = True) -> DataFrame:
    """Files below `folder` with their verdict; the scan never reads the contents."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    )
    return media_verdict(files.unionByName(empty_files(spark, folder)) if with_empty else files, kind)
