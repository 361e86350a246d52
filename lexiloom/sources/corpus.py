"""Folders of plain text, as a table and as a stream.

One folder, local or in S3, is read by a data source of its own: the driver walks
it and keeps its paths compressed, and tasks open about 1000 files each. Spark's
text source keeps an object for every file on the driver, often more than once,
and has a task for every few files; it is left what pyarrow can't list: patterns,
single files and other file systems.
"""

from __future__ import annotations

import time
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader

from lexiloom.sources.listing import Contents, FilePart, Found, can_list, files_below, hidden, is_local, planned, quoted

SUFFIX = "txt"
FORMAT = "text_corpus"
#: A part has so many bytes, and opening a file counts as so many.
PART_BYTES, FILE_BYTES = 16 << 20, 16 << 10
#: A task gives out its texts when it holds so many bytes.
HELD_BYTES = 8 << 20
#: Files change by clocks of this many seconds, local ones and others.
LOCAL_TICK, OTHER_TICK = 0.05, 2.0
_ARROW = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("value", pa.binary())])


def _files(folder: str) -> Iterator[Found]:
    """Like Spark's scan: no hidden files and folders, and no empty files."""
    return (f for f in files_below(folder, hidden) if f.name.endswith(SUFFIX) and f.size > 0 and not hidden(f.name))


def _rows(folder: str, part: FilePart) -> Iterator[pa.RecordBatch]:
    contents = Contents(folder)
    paths, values, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(paths, pa.string()), pa.array([p.rpartition("/")[2] for p in paths], pa.string()), pa.array(values, pa.binary())], schema=_ARROW)

    for path in part.paths:
        value = contents.read(path)
        if paths and size + len(value) > HELD_BYTES:
            yield batch()
            paths, values, size = [], [], 0
        paths.append(quoted(contents.uri(path)))
        values.append(value)
        size += len(value)
    if paths:
        yield batch()


class TextReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self) -> list[FilePart]:
        return planned(_files(self.folder), PART_BYTES, FILE_BYTES) or [FilePart()]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)


class TextStreamReader(DataSourceStreamReader):
    """Offsets are times of change in nanoseconds, so that none but the last one has to be kept.

    A local file changes when it is written or moved to its place, whatever its
    own date says; a file that changes again is read again. The first trigger
    after a start takes all files there are, because Spark asks no second time
    when a stream is to end with them; later ones take `maxFilesPerTrigger`, and
    those of the same moment as the last.
    """

    def __init__(self, options):
        self.folder, self.seen = options["path"], -1
        self.most = int(options.get("maxFilesPerTrigger", 0))
        self.tick = LOCAL_TICK if is_local(self.folder) else OTHER_TICK

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        now = time.time_ns()
        time.sleep(self.tick)  # what comes after the listing has a later time, then
        new = np.frombuffer(array("q", (f.changed for f in _files(self.folder) if self.seen < f.changed <= now)), dtype=np.int64)
        if len(new):
            cut = self.most if self.seen >= 0 and self.most else len(new)
            self.seen = int(np.partition(new, cut - 1)[cut - 1] if cut < len(new) else new.max())
        return {"changed": self.seen}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        self.seen = max(self.seen, end["changed"])
        return planned((f for f in _files(self.folder) if start["changed"] < f.changed <= end["changed"]), PART_BYTES, FILE_BYTES)

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class TextCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path STRING, file_name STRING, value BINARY"

    def reader(self, schema) -> TextReader:
        return TextReader(self.options)

    def streamReader(self, schema) -> TextStreamReader:
        return TextStreamReader(self.options)


def text_files(spark: SparkSession, reader, folder: str) -> DataFrame:
    """The same columns for a batch and a stream reader.

    A file counts when its name ends in `txt`, with or without a dot, in lower
    case only.
    """
    if can_list(spark, folder):
        spark.dataSource.register(TextCorpus)
        # The bytes are taken as they are, as Spark's text source takes them.
        return reader.format(FORMAT).load(folder).select("path", "file_name", F.col("value").cast("string").alias("text"))
    files = (
        reader.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"))
    )
    return files.filter(F.col("file_name").endswith(SUFFIX)).select("path", "file_name", F.col("value").alias("text"))


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text file below `folder`: path, file_name, text."""
    return text_files(spark, spark.read, folder)
