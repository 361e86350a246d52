"""Tables in the shared folder that tasks read on their own."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession

from lexiloom.session import shared_folder


def folder_uri(folder: str) -> str:
    """A folder's URI as pyarrow wants it: Spark writes `file:/x` for `file:///x`, and `s3a` for `s3`."""
    scheme, _, rest = folder.partition(":") if ":/" in folder else ("file", "", folder)
    return "file://" + "/" + rest.lstrip("/") if scheme == "file" else re.sub("^s3[an]:", "s3:", folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the session's shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_for_tasks(df: DataFrame, name: str) -> str:
    """Writes `df` to a new folder below the session's shared one and returns it. No row passes through the driver."""
    folder = f"{new_folder(df.sparkSession, name)}/table"
    df.write.option("compression", "zstd").parquet(folder)
    return folder


def batches_of(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """A kept table, read by a task in batches of up to `rows` rows, always in the same order."""
    files, path = fs.FileSystem.from_uri(folder_uri(folder))
    table = dataset.dataset(path, filesystem=files, format="parquet")
    for batch in table.to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1, use_threads=False):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
