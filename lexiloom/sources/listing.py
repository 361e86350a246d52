"""Files below a folder, listed one after the other and planned into parts of a task each.

The driver walks the folders without keeping what it saw: a part holds its paths
compressed (a few bytes each), and only tasks open files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition

from lexiloom.sources.shared import folder_uri

#: Files that are sorted and planned at a time, and the most of a part.
FILES_AT_ONCE = 10_000
#: Characters that Spark takes for a pattern, and those that it writes as %XX in a path.
_PATTERN, _QUOTED = re.compile(r"[*?\[\]{}\\]"), re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\x9f]|\s')


class Found(NamedTuple):
    path: str
    name: str
    size: int
    modified: int
    #: When the file came to its place or was last changed there, in nanoseconds.
    changed: int


@dataclass
class FilePart(InputPartition):
    """Files of one task, as the file system knows them."""

    packed: bytes = b""

    @classmethod
    def of(cls, paths: Iterable[str]) -> FilePart:
        return cls(zlib.compress("\0".join(paths).encode(errors="surrogateescape")))

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(zlib.decompress(self.packed).decode(errors="surrogateescape").split("\0")) if self.packed else ()


def is_local(folder: str) -> bool:
    return folder_uri(folder).startswith("file:")


def hidden(name: str) -> bool:
    """Names that Spark's scan leaves out."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def can_list(spark: SparkSession, folder: str) -> bool:
    """Whether `folder` is one folder, local or in S3; anything else is left to Spark's own readers."""
    if _PATTERN.search(folder):
        return False
    if ":/" not in folder and not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return False
    if is_local(folder):
        return os.path.isdir(folder_uri(folder).removeprefix("file://"))
    return folder_uri(folder).startswith("s3:")


def files_below(folder: str, skips: Callable[[str], bool] = lambda name: False) -> Iterator[Found]:
    """The files of a folder and of its folders; those that `skips` says by name are not entered."""
    system, root = fs.FileSystem.from_uri(folder_uri(folder))
    waiting, local = [root], is_local(folder)
    while waiting:
        for found, is_folder in (_entries if local else _objects)(system, waiting.pop()):
            if not is_folder:
                yield found
            elif not skips(found.name):
                waiting.append(found.path)


def _entries(_, folder: str) -> Iterator[tuple[Found, bool]]:
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                if entry.is_dir():
                    yield Found(entry.path, entry.name, 0, 0, 0), True
                elif entry.is_file():
                    stat = entry.stat()
                    yield Found(entry.path, entry.name, stat.st_size, stat.st_mtime_ns, max(stat.st_mtime_ns, stat.st_ctime_ns)), False
            except FileNotFoundError:  # it went meanwhile
                pass


def _objects(system, folder: str) -> Iterator[tuple[Found, bool]]:
    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.type == fs.FileType.Directory:
            yield Found(f.path, f.base_name, 0, 0, 0), True
        elif f.type == fs.FileType.File:
            yield Found(f.path, f.base_name, f.size, f.mtime_ns or 0, f.mtime_ns or 0), False


def planned(files: Iterable[Found], part_bytes: int, file_bytes: int = 0) -> list[FilePart]:
    """Parts of about `part_bytes`; each file counts `file_bytes` more than it has."""
    out, held, size = [], [], 0

    def flush(chunk: list[Found]) -> None:
        nonlocal held, size
        for file in sorted(chunk):
            if held and (size + file.size + file_bytes > part_bytes or len(held) >= FILES_AT_ONCE):
                out.append(FilePart.of(held))
                held, size = [], 0
            held.append(file.path)
            size += file.size + file_bytes

    chunk: list[Found] = []
    for file in files:
        chunk.append(file)
        if len(chunk) == FILES_AT_ONCE:
            flush(chunk)
            chunk = []
    flush(chunk)
    return [*out, FilePart.of(held)] if held else out


class Contents:
    """Reads files of a folder in a task."""

    def __init__(self, folder: str):
        self.local = is_local(folder)
        self.system, _ = (None, None) if self.local else fs.FileSystem.from_uri(folder_uri(folder))
        self.scheme = "file" if self.local else folder.partition(":")[0]

    def read(self, path: str) -> bytes:
        with open(path, "rb") if self.local else self.system.open_input_file(path) as source:
            return source.read()

    def uri(self, path: str) -> str:
        return f"file:{path}" if self.local else f"{self.scheme}://{path}"


def quoted(path: str) -> str:
    """A path as Spark's metadata columns write it."""
    return _QUOTED.sub(lambda found: quote(found[0], safe=""), path.encode(errors="surrogateescape").decode(errors="replace"))
