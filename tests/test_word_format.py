"""The Word data source gives the rows of the file scan, in batch and as a stream."""

import io
import os
import time
import zipfile

import pytest

from lexiloom.sources.docx import read_docx_runs
from lexiloom.sources.word_format import WordReader, WordStreamReader, register_word_runs

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(*texts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
        archive.writestr("word/header1.xml", "<broken")
    return data.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(5):
        (tmp_path / "in" / ("deep" if i % 2 else ".") / f"d{i}.docx").write_bytes(package(f"text {i}", "", "end") if i != 3 else b"no package")
    for name in ("note.txt", "_temporary.docx", ".hidden.docx", "UPPER.DOCX"):
        (tmp_path / "in" / name).write_bytes(package("never"))
    return str(tmp_path / "in")


def lines(df):
    return sorted(map(repr, df.collect()))


def test_same_rows_as_the_file_scan(spark, folder):
    register_word_runs(spark)
    got = spark.read.format("word_runs").load(folder)
    want = read_docx_runs(spark, folder)
    assert lines(got) == lines(want) and got.schema == want.schema
    assert got.filter("error IS NOT NULL").count() == 5  # one file, and a part in each of the others
    assert lines(spark.read.format("word_runs").load(f"file:{folder}")) == lines(want)


def test_partitions_are_planned_by_size(folder):
    size = len(package("text 0", "", "end"))
    whole = WordReader({"path": folder}).partitions()
    single = WordReader({"path": folder, "partitionBytes": "1"}).partitions()
    pairs = WordReader({"path": folder, "partitionBytes": str(2 * size + 20)}).partitions()
    assert [len(p.paths) for p in whole] == [5] and [len(p.paths) for p in single] == [1] * 5
    assert len(pairs) in (2, 3) and sorted(x for p in pairs for x in p.paths) == sorted(whole[0].paths)


def test_an_empty_folder(spark, tmp_path):
    register_word_runs(spark)
    assert spark.read.format("word_runs").load(str(tmp_path)).count() == 0


def test_a_stream_reads_each_file_once(spark, folder, tmp_path):
    register_word_runs(spark)

    def run():
        stream = spark.readStream.format("word_runs").option("settleSeconds", 0).load(folder)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out")

    first = lines(run())
    assert first == lines(read_docx_runs(spark, folder))
    with open(os.path.join(folder, "late.docx"), "wb") as out:
        out.write(package("one more"))
    assert lines(run()) == lines(read_docx_runs(spark, folder))
    assert len(lines(run())) == len(first) + 2


def test_files_still_being_written_wait(folder):
    settled = WordStreamReader({"path": folder, "settleSeconds": "3600"})
    assert settled.latestOffset() == {"changed": -1} and settled.partitions({"changed": -1}, {"changed": -1}) == []
    past = time.time() - 7200
    os.utime(os.path.join(folder, "d0.docx"), (past, past))
    end = settled.latestOffset()
    assert [len(p.paths) for p in settled.partitions(settled.initialOffset(), end)] == [1]
