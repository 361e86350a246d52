"""Answers of a paid service, kept as they come.

A task that is repeated, or runs twice, would call the service again for texts
that were answered already. So answers go to small files in the shared folder
while the task runs, by bucket of their key; whoever works on a bucket reads its
files first. Files are written under another name and then moved, so a reader
sees whole files only, and no two attempts share one. At most the answers since
the last file, `answers` of them or those of `seconds`, are lost with a task.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs

from lexiloom.sources.shared import folder_uri

ROWS = pa.schema([("key", pa.string()), ("answer", pa.string())])


@dataclass(frozen=True)
class AnswerLog:
    """Where answers are kept, in how many buckets (a power of two up to 2^32), and how often files are written."""

    folder: str
    buckets: int = 1024
    answers: int = 32
    seconds: float = 5.0

    def __post_init__(self) -> None:
        if self.buckets.bit_count() != 1 or self.buckets > 1 << 32:
            raise ValueError("buckets must be a power of two")

    def open(self) -> OpenLog:
        return OpenLog(self)


def answer_key(*parts: str) -> str:
    """The key of a request: everything that decides its answer."""
    return hashlib.md5("\x1f".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


class OpenLog:
    """The log as one task uses it. Buckets are read when they are first needed; only the latest one is held."""

    def __init__(self, log: AnswerLog):
        self.log, self.bucket, self.known, self.fresh = log, None, {}, []
        self.system, self.root = fs.FileSystem.from_uri(folder_uri(log.folder))
        self.written = time.monotonic()

    def answer(self, key: str) -> str | None:
        bucket = int(key, 16) % self.log.buckets
        if bucket != self.bucket:
            self.flush()
            self.bucket, self.known = bucket, self._read(bucket)
        return self.known.get(key)

    def keep(self, key: str, answer: str) -> None:
        """Keeps the answer to a key that was just asked for."""
        self.known[key] = answer
        self.fresh.append((key, answer))
        if len(self.fresh) >= self.log.answers or time.monotonic() - self.written >= self.log.seconds:
            self.flush()

    def flush(self) -> None:
        if self.fresh:
            place, name = self._place(self.bucket), uuid.uuid4().hex
            self.system.create_dir(place, recursive=True)
            with self.system.open_output_stream(f"{place}/.{name}") as out, pa.ipc.new_stream(out, ROWS) as writer:
                writer.write_batch(pa.RecordBatch.from_pylist([dict(zip(ROWS.names, row)) for row in self.fresh], ROWS))
            self.system.move(f"{place}/.{name}", f"{place}/{name}.arrows")
            self.fresh = []
        self.written = time.monotonic()

    def _place(self, bucket: int) -> str:
        return f"{self.root.rstrip('/')}/bucket={bucket}"

    def _read(self, bucket: int) -> dict[str, str]:
        known: dict[str, str] = {}
        for file in self.system.get_file_info(fs.FileSelector(self._place(bucket), allow_not_found=True)):
            if file.base_name.endswith(".arrows"):
                with self.system.open_input_file(file.path) as source, pa.ipc.open_stream(source) as reader:
                    for row in reader.read_all().to_pylist():
                        known[row["key"]] = row["answer"]
        return known
