"""Cutting one text into chunks: the small per-row helper behind the chunk operators."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed


def _pieces(text: str, size: int, separators: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
    """(level, pieces) groups in text order.

    Pieces of a group are packed together. A piece starts with its separator. A
    piece of `size` or more is cut again by the finer separators, on its own.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[level], separators[level + 1 :]
    if separator:
        cuts = [0, *(m.start() for m in re.finditer(re.escape(separator), text)), len(text)]
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]
    else:
        pieces = list(text)
    waiting: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            waiting.append(piece)
            continue
        if waiting:
            yield level, waiting
            waiting = []
        if finer:
            yield from _pieces(piece, size, finer)
        else:
            yield level, [piece]
    if waiting:
        yield level, waiting


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces up to `size` characters; each next chunk repeats up to `overlap` characters."""
    first, held = 0, 0
    for i, piece in enumerate(pieces):
        if held + len(piece) > size and first < i:
            yield "".join(pieces[first:i])
            while held > overlap or (held > 0 and held + len(piece) > size):
                held -= len(pieces[first])
                first += 1
        held += len(piece)
    if first < len(pieces):
        yield "".join(pieces[first:])


def split_text(
    text: str,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    separators: Sequence[str] = fixed.SEPARATORS,
) -> list[str]:
    """Chunks of at most `size` characters where the separators allow it, stripped, blank ones left out."""
    if not text:
        return []
    chunks = (chunk.strip() for _, pieces in _pieces(text, size, separators) for chunk in _packed(pieces, size, overlap))
    return [chunk for chunk in chunks if chunk]


@F.udtf(returnType="chunk_idx INT, chunk_size INT, chunk STRING")
class Chunks:
    """`SELECT ... FROM docs, LATERAL chunks(text, 2000, 400)`"""

    def eval(self, text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP):
        for index, chunk in enumerate(split_text(text or "", size, overlap)):
            yield index, size, chunk


def register_chunks(spark, name: str = "chunks") -> None:
    """Makes the table function available to SQL."""
    spark.udtf.register(name, Chunks)
