"""Many Word files: put together in Spark, planned without an object per file on the driver, read as columns."""

import os
import pickle
import zipfile

from lexiloom.plans import files
from lexiloom.plans.tables import Tables
from lexiloom.sources.docx import document_rows
from lexiloom.sources.listing import FilePart
from lexiloom.sources.word_format import WordReader, register_word_runs

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def names(parts: list[FilePart]) -> list[str]:
    return [os.path.basename(p) for part in parts for p in part.paths]


def test_word_files_of_odd_runs(spark):
    rows = [("a", "document.xml", p, r, f"<{p}&{r}>\r\n ") for p in range(12) for r in range(11, -1, -1)]
    rows += [("a", "header1.xml", 0, 0, None), ("a", "document.xml", None, 0, "last"), ("b", "footer1.xml", 3, None, "z"), ("b", "footer1.xml", 3, 2, "y"), (None, "document.xml", 0, 0, "é")]
    runs = spark.createDataFrame(rows, "doc STRING, part STRING, para_idx INT, run_idx INT, text STRING")
    folder = files.word_files(runs).removeprefix("file:")
    found = {os.path.basename(n): os.path.join(at, n) for at, _, inside in os.walk(folder) for n in inside if n.endswith(".docx")}
    assert sorted(found) == ["doc-None.docx", "doc-a.docx", "doc-b.docx"]
    assert all(os.path.basename(os.path.dirname(p)).startswith("bucket=") for p in found.values())
    read = {n: [r[1:2] + r[3:7] for r in document_rows(n, open(p, "rb").read())] for n, p in found.items()}
    texts = [("document.xml", p, r, 0, f"<{p}&{r}>\r\n ") for p in range(12) for r in range(12)]
    assert read["doc-a.docx"] == [*texts, ("document.xml", 12, 0, 0, "last"), ("header1.xml", 0, 0, 0, "")]
    assert read["doc-b.docx"] == [("footer1.xml", 0, 0, 0, "y"), ("footer1.xml", 0, 1, 0, "z")] and read["doc-None.docx"] == [("document.xml", 0, 0, 0, "é")]


def test_words_go_to_no_python_and_no_shuffle_on_their_way_to_files(spark, tmp_path, monkeypatch):
    frame = type(spark.range(1))
    seen, real = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a, **k: (seen.append(df), real(df, *a, **k))[1])
    spark.createDataFrame([(i, f"One two {i}\nthree\nfour") for i in range(20)], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    for whole in (False, True):
        files.word_files(Tables(spark, str(tmp_path)).runs(dealt=True, whole=whole))
        documents = seen.pop()
        plan = documents._jdf.queryExecution().executedPlan().toString()
        assert documents.count() == 20 and plan.count("Exchange") == 1 and "FlatMapGroups" not in plan
    assert plan.count("Generate posexplode") == 1  # paragraphs are cut, words are not


def test_whole_paragraphs_give_the_files_of_their_runs(spark, tmp_path):
    texts = [(i, f"One <two> & {i}\r\nthree  four \n\n five\n" + "a\n" * (3 * i)) for i in range(12)] + [(3, "ab c\nd"), (3, "ab c\nd e f"), (4, None), (5, ""), (-6, "\u00e9 \u0001 z")]
    spark.createDataFrame(texts, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))

    def read(folder):
        found = [os.path.join(at, n) for at, _, inside in os.walk(folder.removeprefix("file:")) for n in inside if n.endswith(".docx")]
        return {os.path.basename(p): sorted(map(repr, document_rows("", open(p, "rb").read()))) for p in found}

    of_runs, of_paragraphs = (read(files.word_files(t.runs(dealt=True, whole=whole))) for whole in (False, True))
    assert len(of_runs) == 13 and of_runs == of_paragraphs
    runs = t.runs().filter("doc = '7'").select("part", "para_idx", "text").collect()
    assert sorted(r["text"] for r in runs) == sorted(eval(r)[6] for r in of_paragraphs["doc-7.docx"])


def test_many_word_files_need_little_of_the_driver(tmp_path):
    for i in range(3000):
        (tmp_path / f"doc-{i}.docx").write_bytes(b"x" * 100)
    parts = WordReader({"path": str(tmp_path), "partitionBytes": "30000"}).partitions()
    assert len(parts) == 10 and sorted(names(parts)) == sorted(os.listdir(tmp_path)) and len(pickle.dumps(parts)) < 3000 * 16


def test_rows_of_plain_and_nested_paragraphs(spark, tmp_path):
    plain = "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in ("a", "", "b"))
    box = f"<w:r><w:pict><w:p>{plain}</w:p></w:pict></w:r>"
    odd = "<w:r><w:rPr/><w:t>c</w:t><w:t>d</w:t></w:r><w:hyperlink><w:r><w:t>e</w:t></w:r></w:hyperlink><w:r><w:t>f<w:p/></w:t></w:r>"
    body = f"<w:p>{plain}</w:p><w:p/><w:p><w:pPr/></w:p><w:p>{box}{odd}</w:p><w:r><w:t>no paragraph</w:t></w:r><w:p>{plain}<w:x/></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/header2.xml", f'<w:hdr xmlns:w="{W}"/>')
    want = [(0, 0, 0, "a"), (0, 1, 0, ""), (0, 2, 0, "b"), (1, None, None, None), (2, None, None, None), (3, 0, None, None), (4, 0, 0, "a"), (4, 1, 0, ""), (4, 2, 0, "b")]
    want += [(3, 1, 0, "c"), (3, 1, 1, "d"), (3, 2, 0, "e"), (3, 3, 0, "f"), (5, None, None, None), (6, 0, 0, "a"), (6, 1, 0, ""), (6, 2, 0, "b")]
    assert [r[3:7] for r in document_rows("a", (tmp_path / "a.docx").read_bytes())] == want
    register_word_runs(spark)
    got = spark.read.format("word_runs").load(str(tmp_path)).select("para_idx", "run_idx", "text_idx", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
