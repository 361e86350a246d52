"""Packing: documents' token ids into sequences of a fixed length with little padding.

First-fit decreasing: pieces in order of falling length each go to the first
sequence with room. A tournament tree over the sequences' free room finds that
sequence in log(n) steps. Pieces are dealt at random into groups of about
`GROUP_PIECES`, and each group is packed by itself, so no step grows with the
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import texts_of, word_ids

SEQUENCE_TOKENS = 4096
#: Pieces that are packed together, on average. More leave less padding, fewer make smaller tasks.
GROUP_PIECES = 2048
PIECES = "piece_id LONG, doc_id LONG, start LONG, length LONG, doc_tokens LONG, ids BINARY"


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece, in the order given; sequences count from 0. Equal lengths keep their order."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[1] is the root: the most room that any sequence below has
    sequences, offsets = [0] * len(lengths), [0] * len(lengths)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[piece], 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        sequences[piece], offsets[piece] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return sequences, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of at most `sequence_tokens`; written once.

    A null or empty text has the end id alone. A null doc_id stays null and
    rows that repeat are packed each on its own: `piece_id` tells them apart.
    Other columns are not read. An empty table gives no piece.
    """
    width = 4 * sequence_tokens

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary, piece = word_ids(tokenizer_path), TaskContext.get().partitionId() << 36
        for part, texts in texts_of(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = vocabulary.text(text)
                for at in range(0, len(ids), width):
                    own = ids[at : at + width]
                    rows.append((piece, doc_id, at // 4, len(own) // 4, len(ids) // 4, own))
                    piece += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["piece_id", "doc_id", "start", "length", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return stored(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


def pack(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES, seed: int = 0) -> DataFrame:
    """(piece_id, sequence_id, offset) for pieces with distinct `piece_id` and a `length` of 1 to `sequence_tokens`.

    `sequence_id` is the group's number times 2^32 plus the sequence's place in
    the group. Only ids and lengths are shuffled.
    """
    groups = max(1, -(-pieces.count() // group_pieces))

    def packed(key, table):
        import pyarrow as pa

        table = table.sort_by("piece_id")
        sequences, offsets = first_fit_decreasing(table.column("length").to_pylist(), sequence_tokens)
        base = key[0].as_py() << 32
        return pa.table({"piece_id": table.column("piece_id"), "sequence_id": [base + s for s in sequences], "offset": offsets})

    group = F.pmod(F.xxhash64("piece_id", F.lit(seed)), F.lit(groups))
    return (
        pieces.select("piece_id", "length", group.alias("group"))
        .groupBy("group")
        .applyInArrow(packed, "piece_id LONG, sequence_id LONG, offset LONG")
    )


def packed_pieces(docs: DataFrame, tokenizer_path: str, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces with their ids, sequence and offset there."""
    pieces = token_pieces(docs, tokenizer_path, sequence_tokens)
    return pieces.join(pack(pieces, sequence_tokens), "piece_id")


def padded_sequences(packed: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): whole sequences as arrays of ids.

    A sequence is filled up with `pad_id` to `sequence_tokens`, except one whose
    length is a power of two, which stays as it is.
    """

    def joined(key, table):
        import numpy as np
        import pyarrow as pa

        ids = np.frombuffer(b"".join(table.sort_by("offset").column("ids").to_pylist()), dtype="<u4")
        size = len(ids) if len(ids) & (len(ids) - 1) == 0 else sequence_tokens
        full = np.full(size, pad_id, dtype=np.int64)
        full[: len(ids)] = ids
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [full], "n_tokens": [len(ids)]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(joined, "sequence_id LONG, ids ARRAY<LONG>, n_tokens LONG")
