"""Best-fit packing: documents' token ids into as few sequences as best-fit decreasing needs.

Pieces in order of falling length each go to the open sequence with the least
room that still takes them. A segment tree over the possible amounts of room
(0 to the sequence length) finds that amount in log(length) steps.

What best-fit decreasing does depends on the lengths alone, so it is run once
for the whole corpus over the count of each length: pieces of one length that
meet sequences of one room are placed together, as a *run*. The driver sees one
count per length, at most `sequence_tokens` of them. Each length opens or splits
four ranges of sequences at most, and taking pieces at least halves a range's
room, so with 4096 tokens there are fewer than 4 * 4096 * 13 runs, whatever the
corpus. Tasks then look up the place of their pieces: the n-th piece of a length
belongs to the run that covers n.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import texts_of, word_ids

SEQUENCE_TOKENS, END_ID = 4096, 1
PIECES = "part INT, place LONG, doc_id LONG, piece INT, start LONG, length LONG, doc_tokens LONG, ids_crc32 LONG, ids BINARY"
#: More pieces of one length than any corpus has; lengths and numbers share a 64-bit key below it.
NUMBERS = 1 << 48


class Rooms:
    """Open sequences by the room they have left: a segment tree whose leaf `r` holds the ranges of sequences with room `r`."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any_below = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.ranges[room].append((first, count))
            node = self.leaves + room
            while node and not self.any_below[node]:
                self.any_below[node] = 1
                node //= 2

    def take(self, room: int) -> tuple[int, int]:
        out, node = self.ranges[room].pop(), self.leaves + room
        if not self.ranges[room]:
            self.any_below[node] = 0
            while node > 1:
                node //= 2
                self.any_below[node] = self.any_below[2 * node] | self.any_below[2 * node + 1]
        return out

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that an open sequence has."""
        node = self.leaves + need
        if self.any_below[node]:
            return need
        while node > 1 and (node % 2 or not self.any_below[node + 1]):
            node //= 2
        if node == 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.any_below[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, first sequence, pieces per sequence, offset) for so many pieces of each length.

    A run covers the pieces of its length from its first number up to the next
    run's; its sequences follow each other and each takes the same number of
    pieces, one after the other from `offset` on. Lengths are 1 to `capacity`.
    """
    rooms, opened, runs = Rooms(capacity), 0, []
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, needed = capacity, -(-left // (capacity // length))
                rooms.put(capacity, opened, needed)
                opened += needed
            first, sequences = rooms.take(room)
            each = room // length  # the room left by a piece is tighter than any other that takes one
            full = min(sequences, left // each)
            for taken, pieces in ((full, each), (min(1, sequences - full), left - full * each)):
                if taken and pieces > 0:
                    pieces = min(pieces, each)
                    runs.append((length, number, first, pieces, capacity - room))
                    rooms.put(room - pieces * length, first, taken)
                    number, left, first, sequences = number + taken * pieces, left - taken * pieces, first + taken, sequences - taken
            rooms.put(room, first, sequences)
    return runs


def token_pieces(docs: DataFrame, tokenizer_path: str, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Each text's ids and the end id; only longer ones are cut, into pieces of `sequence_tokens`, the last as long as what is left.

    Missing and empty texts are one piece with the end id alone; rows that
    repeat, and rows without an id, are packed each on its own. `part` and
    `place` tell pieces apart: the task that cut them and how many pieces of the
    same length it had cut before. Other columns are not read. An empty table
    gives no piece.
    """
    width, end = 4 * sequence_tokens, end_id.to_bytes(4, "little")
    names = [field.split()[0] for field in PIECES.split(", ")]

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary, task, places = word_ids(tokenizer_path), TaskContext.get().partitionId(), Counter()
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
        for part, texts in texts_of(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = vocabulary.text(text)[:-4] + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    length = len(own) // 4
                    rows.append((task, places[length], doc_id, piece, at // 4, length, len(ids) // 4, zlib.crc32(own), own))
                    places[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return stored(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


def numbered(pieces: DataFrame) -> DataFrame:
    """(part, place, length, number): each piece's number from 0 among all pieces of its length.

    Only counts per task and length are put in order: a window holds one row
    per task.
    """
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return pieces.join(before, ["part", "length"]).withColumn("number", F.col("place") + F.col("before")).drop("before")


def pack(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`; needs `part`, `place` and `length` (1 to `sequence_tokens`), and keeps all columns."""
    import numpy as np

    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(best_fit_decreasing(counts, sequence_tokens)), dtype="int64").reshape(-1, 5)
    keys, (first_number, first_sequence, each, offset) = runs[:, 0] * NUMBERS + runs[:, 1], runs[:, 1:].T
    schema = pieces.schema

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            number, length = (np.asarray(batch.column(name)) for name in ("number", "length"))
            run = np.searchsorted(keys, length * NUMBERS + number, side="right") - 1
            sequence, slot = np.divmod(number - first_number[run], each[run])
            columns = [*(batch.column(name) for name in schema.names), pa.array(first_sequence[run] + sequence), pa.array(offset[run] + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return numbered(pieces).mapInArrow(placed, f"{fields}, sequence_id LONG, offset LONG")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens): whole sequences as arrays of ids, without padding. A group holds one sequence."""

    def joined(key, table):
        import numpy as np
        import pyarrow as pa

        ids = np.frombuffer(b"".join(table.sort_by("offset").column("ids").to_pylist()), dtype="<u4").astype("int64")
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [ids], "n_tokens": [len(ids)]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(joined, "sequence_id LONG, ids ARRAY<LONG>, n_tokens LONG")


def packing_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces and their places, with a checksum of the ids in place of the ids."""
    return pack(token_pieces(docs, tokenizer_path).drop("ids")).drop("part", "place")
