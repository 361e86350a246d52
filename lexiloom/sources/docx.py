"""Word documents as run tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.schemas import RUNS

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_P, _R, _T = f"{_W}p", f"{_W}r", f"{_W}t"
_LOOKED_AT = (_P, _R)
_PARTS = re.compile(r"word/(document\.xml|header[^/]*|footer[^/]*|footnotes\.xml|endnotes\.xml)")
_COLUMNS = ["doc", "part", "part_kind", "para_idx", "run_idx", "text_idx", "text", "error"]


def _part_kind(part: str) -> str:
    if part == "document.xml":
        return "document"
    return next((kind for kind in ("header", "footer") if kind in part), "other")


def _columns_of(root) -> tuple[list, list, list, list]:
    """Paragraphs, runs, text numbers and texts; every run belongs to its innermost paragraph.

    A paragraph's own row stays only when it has no run.
    """
    paragraphs, runs, numbers, texts = columns = [], [], [], []
    runs_in: list[int] = []
    own: list[int] = []
    open_nodes = [(root, None)]
    while open_nodes:
        node, paragraph = open_nodes.pop()
        if node.tag == _P:
            paragraph = len(runs_in)
            # Most paragraphs hold runs of one plain text each and nothing else; these are taken at once.
            plain = [t.text or "" for r in node if r.tag == _R and len(r) == 1 and (t := r[0]).tag == _T and not len(t)]
            if plain and len(plain) == len(node):
                runs_in.append(len(plain))
                paragraphs += [paragraph] * len(plain)
                runs += range(len(plain))
                numbers += [0] * len(plain)
                texts += plain
                continue
            runs_in.append(0)
            own.append(len(paragraphs))
            rows = [(None, None, None)]
        elif node.tag == _R and paragraph is not None:
            found = [child.text or "" for child in node if child.tag == _T]
            rows = [(runs_in[paragraph], number, text) for number, text in enumerate(found)] or [(runs_in[paragraph], None, None)]
            runs_in[paragraph] += 1
        else:
            rows = []
        for run, number, text in rows:
            paragraphs.append(paragraph)
            runs.append(run)
            numbers.append(number)
            texts.append(text)
        # Most nodes are plain texts; only those that are or hold a paragraph or a run are looked at again.
        open_nodes.extend((child, paragraph) for child in reversed(node) if len(child) or child.tag in _LOOKED_AT)
    if gone := {place for place in own if runs_in[paragraphs[place]]}:
        return tuple([value for place, value in enumerate(column) if place not in gone] for column in columns)
    return columns


def document_parts(content: bytes) -> Iterator[tuple[str | None, str | None, tuple[list, list, list, list], str | None]]:
    """Name, kind, columns of rows and error of each part of a document; a broken file or part has one row with `error`."""
    broken = [None], [None], [None], [None]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            for entry in package.namelist():
                found = _PARTS.fullmatch(entry)
                if not found:
                    continue
                part = found.group(1)
                try:
                    columns = _columns_of(ElementTree.fromstring(package.read(entry)))
                except ElementTree.ParseError as problem:
                    yield part, _part_kind(part), broken, str(problem)
                    continue
                yield part, _part_kind(part), columns, None
    except (zipfile.BadZipFile, OSError, RuntimeError) as problem:
        yield None, None, broken, str(problem)


def document_rows(name: str, content: bytes) -> list[tuple]:
    """All rows of one document."""
    return [(name, part, kind, *row, error) for part, kind, columns, error in document_parts(content) for row in zip(*columns, strict=True)]


def docx_runs(files: DataFrame) -> DataFrame:
    """`path, content` rows (batch or stream) -> run table. Parsing is a map over the files."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for name, content in zip(batch["path"], batch["content"]) for row in document_rows(name, content)]
            frame = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
            yield frame.astype({c: "Int32" for c in ("para_idx", "run_idx", "text_idx")})

    return files.select("path", "content").mapInPandas(explode, RUNS)


def read_docx_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every `.docx` below `folder`: main part, headers, footers, footnotes and endnotes."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.docx")
        .load(folder)
    )
    return docx_runs(files)


def unreadable(runs: DataFrame) -> DataFrame:
    """Documents or parts that could not be read, with the reason."""
    return runs.filter(F.col("error").isNotNull()).select("doc", "part", "error")
