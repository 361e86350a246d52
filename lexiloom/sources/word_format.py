"""Word documents as a data source: `spark.read.format("word_runs")` and `spark.readStream.format("word_runs")`.

The driver walks the folder (names and sizes only) and plans partitions of about
`partitionBytes`, which hold compressed paths; tasks open the files. A broken file or part is a row with
`error`. Options: `path`, `partitionBytes`, and for streams `settleSeconds`, how
long a file must have been left alone before it is read.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader

from lexiloom.schemas import RUNS
from lexiloom.sources.docx import document_parts
from lexiloom.sources.listing import Contents, FilePart, Found, files_below, planned

SUFFIX = ".docx"
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 10_000
_TYPES = {"INT": pa.int32(), "STRING": pa.string()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in RUNS.split(", "))])


def _batches(counts: list[int], names: list[tuple], rows: tuple[list, ...]) -> Iterator[pa.RecordBatch]:
    """`rows` has columns; `names` has document, part, kind and error of as many rows each as `counts` says."""
    paragraphs, runs, numbers, texts = rows
    of = np.repeat(np.arange(len(names)), counts)
    each = [pa.array(values, pa.string()) for values in zip(*names, strict=True)]
    for start in range(0, len(texts), BATCH_ROWS):
        part = slice(start, start + BATCH_ROWS)
        doc, name, kind, error = (values.take(pa.array(of[part])) for values in each)
        ints = [pa.array(values[part], pa.int32()) for values in (paragraphs, runs, numbers)]
        yield pa.RecordBatch.from_arrays([doc, name, kind, *ints, pa.array(texts[part], pa.string()), error], schema=_ARROW)


class _Folder:
    """The Word files below a folder."""

    def __init__(self, options):
        self.folder = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.settle = float(options.get("settleSeconds", 2))

    def files(self) -> Iterator[Found]:
        return (f for f in files_below(self.folder) if f.name.endswith(SUFFIX) and not f.name.startswith(("_", ".")))

    def planned(self, files: Iterable[Found]) -> list[FilePart]:
        return planned(files, self.partition_bytes)

    def rows(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        """The rows of the files, as columns: Spark takes over tuples one value at a time."""
        contents = Contents(self.folder)
        counts, names, rows = [], [], ([], [], [], [])
        for path in partition.paths:
            doc = contents.uri(path)
            for part, kind, columns, error in document_parts(contents.read(path)):
                counts.append(len(columns[0]))
                names.append((doc, part, kind, error))
                for held, more in zip(rows, columns, strict=True):
                    held += more
            if len(rows[0]) >= BATCH_ROWS:
                yield from _batches(counts, names, rows)
                counts, names, rows = [], [], ([], [], [], [])
        if names:
            yield from _batches(counts, names, rows)


class WordReader(DataSourceReader):
    def __init__(self, options):
        self.folder = _Folder(options)

    def partitions(self) -> list[FilePart]:
        return self.folder.planned(self.folder.files()) or [FilePart()]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class WordStreamReader(DataSourceStreamReader):
    """Offsets are modification times in nanoseconds: a trigger reads the files changed after one and up to another."""

    def __init__(self, options):
        self.folder, self.seen = _Folder(options), -1

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(self.folder.settle * 1e9)
        self.seen = max(chain([self.seen], (f.modified for f in self.folder.files() if f.modified <= settled)))
        return {"changed": self.seen}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        return self.folder.planned(f for f in self.folder.files() if start["changed"] < f.modified <= end["changed"])

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class WordRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word_runs"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> WordReader:
        return WordReader(self.options)

    def streamReader(self, schema) -> WordStreamReader:
        return WordStreamReader(self.options)


def register_word_runs(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(WordRuns)
