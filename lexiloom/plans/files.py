"""Files made from the given tables, for the readers that follow them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.shared import folder_uri, new_folder

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Folders that the files of a table are dealt to, so that no folder has all of them.
FOLDERS = 256
#: What Spark writes for a missing value in a path.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def _escaped(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _joined(values: Column, *order: str) -> Column:
    """The texts of a group one after the other, by `order` with missing values last, then by themselves."""
    keys = [k for name in order for k in (F.col(name).isNull().alias(f"no_{name}"), F.col(name))]
    rows = F.sort_array(F.collect_list(F.struct(*keys, values.alias("_xml"))))
    return F.array_join(F.transform(rows, lambda r: r["_xml"]), "")


def _package(parts: list[dict]) -> bytes:
    """A Word file of parts with their paragraphs."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as package:
        for part in sorted(parts, key=lambda p: (p["part"] is None, p["part"] or "")):
            package.writestr(f"word/{part['part']}", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_WORD}"><w:body>{part["body"]}</w:body></w:document>')
    return data.getvalue()


def _run_texts(lists: Column) -> Column:
    """The texts of a paragraph; if it came more than once, its first runs come first, then its second ones."""
    placed = F.flatten(F.transform(lists, lambda texts: F.transform(texts, lambda text, i: F.struct(i.alias("run_idx"), text.alias("text")))))
    return F.when(F.size(lists) == 1, lists[0]).otherwise(F.transform(F.sort_array(placed), lambda r: r["text"]))


def _runs_xml(texts: Column) -> Column:
    plain = F.array_join(texts, "", "").rlike("[&<>\r]") == F.lit(False)
    safe = F.when(plain, texts).otherwise(F.transform(texts, _escaped))
    return F.concat(F.lit("<w:r><w:t>"), F.array_join(safe, "</w:t></w:r><w:r><w:t>", ""), F.lit("</w:t></w:r>"))


def word_files(runs: DataFrame) -> str:
    """Writes each document of a run table as a Word file, in tasks, and returns the folder.

    Runs become paragraphs, parts and documents by aggregates, without a shuffle
    if they are dealt by document already; only whole documents go to Python. The
    table has a row per run, or a row per paragraph with the `texts` of its runs.
    """
    folder = new_folder(runs.sparkSession, "word")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder_uri(folder))
        made: set[int] = set()
        for batch in batches:
            for at, doc, parts in zip(*batch.columns, strict=True):
                at, doc = at.as_py(), doc.as_py()
                if at not in made:
                    system.create_dir(f"{root}/bucket={at}", recursive=True)
                    made.add(at)
                with system.open_output_stream(f"{root}/bucket={at}/doc-{doc}.docx") as out:  # a repeated task writes the same bytes
                    out.write(_package(parts.as_py()))
            yield batch.select([0]).slice(0, 0)

    grouped = runs.groupBy("doc", "part", "para_idx")
    if "texts" in runs.columns:
        paragraphs = grouped.agg(F.collect_list("texts").alias("_lists")).select("doc", "part", "para_idx", _run_texts(F.col("_lists")).alias("_texts"))
        paragraphs = paragraphs.select("doc", "part", "para_idx", _runs_xml(F.col("_texts")).alias("_runs"))
    else:
        run = F.concat(F.lit("<w:r><w:t>"), _escaped(F.coalesce("text", F.lit(""))), F.lit("</w:t></w:r>"))
        paragraphs = grouped.agg(_joined(run, "run_idx", "text").alias("_runs"))
    bodies = paragraphs.groupBy("doc", "part").agg(_joined(F.concat(F.lit("<w:p>"), "_runs", F.lit("</w:p>")), "para_idx").alias("body"))
    documents = bodies.groupBy("doc").agg(F.collect_list(F.struct("part", "body")).alias("parts"))
    at = F.pmod(F.xxhash64("doc"), F.lit(FOLDERS)).cast("int").alias("at")
    documents.select(at, "doc", "parts").mapInArrow(write, "at int").write.format("noop").mode("overwrite").save()
    return folder


def _file_each(rows: DataFrame, key: str, suffix: str, folder: str) -> str:
    """Writes the column `line` of all rows of a key to a file of their own, `key=value` by name, and returns the folder.

    Tasks write the files where they stay. Spark's own writer with a folder per
    key moves each of them on the driver when it commits.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder_uri(folder))
        made, path, out = set(), None, None
        try:
            for batch in batches:
                for at, name, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    place = f"{root}/bucket={at}/{key}={name}.{suffix}"
                    if place != path:
                        if out is not None:
                            out.close()
                        if at not in made:
                            system.create_dir(f"{root}/bucket={at}", recursive=True)
                            made.add(at)
                        path, out = place, system.open_output_stream(place, buffer_size=1 << 16)  # a repeated task writes the same bytes
                    out.write(line.encode())
                    out.write(b"\n")
                yield batch.select([0]).slice(0, 0)
        finally:
            if out is not None:
                out.close()

    named = rows.select(
        F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int").alias("at"), F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("name"), "line"
    )
    written = named.repartition("at", "name").sortWithinPartitions("at", "name").mapInArrow(write, "at int")
    written.write.format("noop").mode("overwrite").save()
    return folder


def text_files_of(docs: DataFrame) -> str:
    """Writes each text as a file of its own, named by its id."""
    lines = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("line"))
    return _file_each(lines, "doc_id", "txt", new_folder(docs.sparkSession, "texts"))


def status_files(current: DataFrame) -> str:
    """Writes the current row of each job as a status file of its own."""
    fields = [F.col("job_id").cast("string").alias("id"), "status", F.col("current").cast("int").alias("progress"), "started_at", "message"]
    lines = current.select("job_id", F.to_json(F.struct(*fields)).alias("line"))
    return _file_each(lines, "job_id", "json", new_folder(current.sparkSession, "status"))
