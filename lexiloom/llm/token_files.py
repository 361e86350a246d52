"""Token files: ids of all documents in order, as independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames and, last, a skippable frame in the public
seekable format: for each frame its compressed size, its plain size and a
checksum (low half of XXH64 of the plain bytes), then the number of frames, a
descriptor byte and a magic number. The frames hold ids as little-endian
unsigned 32-bit integers, about `FRAME_BYTES` each; the last data frame lists
the file's documents as pairs of 64-bit integers (id, number of ids). A reader
fetches the seek table, the list, and only the frames that a wanted document
touches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import run_folder
from .tokens import texts_of, word_ids

FRAME_BYTES = 256 * 1024
FILE_BYTES = 256 * 1024 * 1024
# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
NULL_ID = -(2**63)
MANIFEST = "part LONG, number LONG, file STRING, n_docs LONG, n_ids LONG, n_bytes LONG"


def file_system(folder: str):
    """(pyarrow file system, path) of a folder's URI, as executors open it. Spark writes `file:/x` for `file:///x`."""
    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if not rest:
        return fs.LocalFileSystem(), folder
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(folder)


class FrameWriter:
    """Cuts bytes into frames and writes them to an open stream."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.frames, self.rest, self.size = stream, [], bytearray(), 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def frame(self, plain: bytes) -> None:
        import xxhash

        data = self.compressor.compress(plain)
        self.stream.write(data)
        self.size += len(data)
        self.frames.append((len(data), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def write(self, ids: bytes) -> None:
        self.rest += ids
        while len(self.rest) >= FRAME_BYTES:
            self.frame(bytes(self.rest[:FRAME_BYTES]))
            del self.rest[:FRAME_BYTES]

    def close(self, documents: list[tuple[int, int]]) -> int:
        if self.rest:
            self.frame(bytes(self.rest))
        self.frame(b"".join(struct.pack("<qQ", *d) for d in documents))
        body = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        return self.size + 8 + len(body)


class TokenFile:
    """Reads documents from an open, seekable file; every frame's checksum is tested."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * count, 12 * count)
        self.frames, place, plain = [], 0, 0
        for packed_size, plain_size, checksum in struct.iter_unpack("<III", table):
            self.frames.append((place, packed_size, plain, plain_size, checksum))
            place, plain = place + packed_size, plain + plain_size
        self.documents = list(struct.iter_unpack("<qQ", self._frame(count - 1)))
        self._held = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _frame(self, number: int) -> bytes:
        import xxhash
        import zstandard

        place, packed_size, _, plain_size, checksum = self.frames[number]
        plain = zstandard.ZstdDecompressor().decompress(self._at(place, packed_size), max_output_size=plain_size)
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return plain

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """(doc_id, first id's place in the file, number of ids), in order."""
        at = 0
        for doc_id, count in self.documents:
            yield doc_id, at, count
            at += count

    def chunks(self, start: int, count: int) -> Iterator[bytes]:
        """The bytes of `count` ids from place `start`, frame by frame; each frame in turn is decompressed once."""
        at, end = 4 * start, 4 * (start + count)
        while at < end:
            number = at // FRAME_BYTES
            if self._held[0] != number:
                self._held = (number, self._frame(number))
            first = self.frames[number][2]
            piece = self._held[1][at - first : end - first]
            yield piece
            at += len(piece)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str) -> DataFrame:
    """Write all documents in ascending doc_id order and return the list of files.

    Null texts count as empty, a null doc_id sorts first, and rows with one
    doc_id keep their input order; a third column spreads such rows over tasks.
    Each task writes files of its own under a name for the attempt and renames
    them when they are whole, so a task that runs again replaces equal files.
    Other columns are not read. An empty table gives no file. `folder` must be
    one that pyarrow's file systems open on the executors.
    """

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        context, (system, root) = TaskContext.get(), file_system(folder)
        part, attempt = context.partitionId(), context.taskAttemptId()
        vocabulary, number, out = word_ids(tokenizer_path), 0, None
        rows: list[tuple] = []

        def finish() -> None:
            nonlocal out, number
            stream, writer, temporary, documents = out
            size = writer.close(documents)
            stream.close()
            name = f"tokens-{part:06d}-{number:04d}.zst"
            system.move(temporary, f"{root}/{name}")
            rows.append((part, number, f"{folder}/{name}", len(documents), sum(n for _, n in documents), size))
            out, number = None, number + 1

        for part_rows, texts in texts_of(batches):
            for doc_id, text in zip(part_rows.column("doc_id").to_pylist(), texts, strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    temporary = f"{root}/.attempt-{attempt}-{number:04d}"
                    stream = system.open_output_stream(temporary)
                    out = (stream, FrameWriter(stream), temporary, [])
                ids = vocabulary.text(text)
                out[1].write(ids)
                out[3].append((NULL_ID if doc_id is None else doc_id, len(ids) // 4))
                if out[1].size >= FILE_BYTES:
                    finish()
        if out is not None:
            finish()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["part", "number", "file", "n_docs", "n_ids", "n_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    ordered = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))
        .repartitionByRange("doc_id", "__row")
        .sortWithinPartitions("doc_id", "__row")
    )
    manifest = f"{folder}/manifest"
    ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_token_files(files: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, or of those in `wanted`, read back from the files.

    `start` counts the ids of all documents before it. The running total is
    taken over the list of files, one row each.
    """
    only = None if wanted is None else frozenset(wanted)

    def read(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, path = file_system(name)
                rows = []
                with system.open_input_file(path) as source:
                    tokens = TokenFile(source)
                    for doc_id, at, count in tokens.spans():
                        if only is not None and doc_id not in only:
                            continue
                        checksum = 0
                        for piece in tokens.chunks(at, count):
                            checksum = zlib.crc32(piece, checksum)
                        rows.append((None if doc_id == NULL_ID else doc_id, base + at, count, checksum))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    return based.repartition(tasks, "file").mapInArrow(read, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")


def tokens_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the documents to a new folder and read all of them back."""
    return read_token_files(write_token_files(docs, run_folder(spark, "tokens"), tokenizer_path))
