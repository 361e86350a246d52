"""Readers and writers on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import segments
from lexiloom.operators.jobs import read_side_progress
from lexiloom.sources.corpus import read_text_corpus
from lexiloom.sources.docx import read_docx_runs, unreadable
from lexiloom.sources.ledger import read_ledger
from lexiloom.sources.manifests import parse_manifest, read_ocr_manifest
from lexiloom.sources.media import media_manifest
from lexiloom.sources.sinks import read_chunk_store, write_chunk_store, write_translation_memory
from lexiloom.sources.status import read_job_status

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def part(body):
    return f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'


def para(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" if r is not None else "<w:r/>" for r in runs) + "</w:p>"


def package(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)


@pytest.fixture
def documents(tmp_path):
    nested = "<w:p><w:r><w:t>out</w:t></w:r><w:r><w:txbxContent>" + para("in1", "in2") + "</w:txbxContent></w:r><w:r><w:t>side</w:t></w:r></w:p>"
    package(tmp_path / "a.docx", {
        "word/document.xml": part(para("Hello ", "world", None) + "<w:p/>" + nested),
        "word/header1.xml": part(para("Head")), "word/footnotes.xml": part(para("Note")),
        "word/styles.xml": part(para("never")), "docProps/core.xml": part(para("never")),
    })
    package(tmp_path / "b.docx", {"word/document.xml": "<broken", "word/footer2.xml": part(para("Foot"))})
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.txt").write_text("no")
    return str(tmp_path)


def test_docx_runs(spark, documents):
    runs = read_docx_runs(spark, documents)
    got = sorted(
        (r["doc"].rsplit("/", 1)[1], r["part"], r["part_kind"], r["para_idx"], r["run_idx"], r["text_idx"], r["text"])
        for r in runs.filter("error IS NULL").collect()
    )
    assert sorted(got, key=str) == sorted([
        ("a.docx", "document.xml", "document", 0, 0, 0, "Hello "), ("a.docx", "document.xml", "document", 0, 1, 0, "world"),
        ("a.docx", "document.xml", "document", 0, 2, None, None), ("a.docx", "document.xml", "document", 1, None, None, None),
        ("a.docx", "document.xml", "document", 2, 0, 0, "out"), ("a.docx", "document.xml", "document", 2, 1, None, None),
        ("a.docx", "document.xml", "document", 3, 0, 0, "in1"), ("a.docx", "document.xml", "document", 3, 1, 0, "in2"),
        ("a.docx", "document.xml", "document", 2, 2, 0, "side"), ("a.docx", "header1.xml", "header", 0, 0, 0, "Head"),
        ("a.docx", "footnotes.xml", "other", 0, 0, 0, "Note"), ("b.docx", "footer2.xml", "footer", 0, 0, 0, "Foot"),
    ], key=str)
    bad = sorted((r["doc"].rsplit("/", 1)[1], r["part"]) for r in unreadable(runs).collect())
    assert bad == [("b.docx", "document.xml"), ("c.docx", None)]
    shape = segments.document_structure(runs.filter("error IS NULL")).first()
    assert (shape["num_paragraphs"], shape["num_text_elements"], shape["num_runs"]) == (4, 6, 8)


def test_structure_record(spark):
    """206 paragraphs, 211 texts and 530 runs with a mean of 23.891 need grouping because texts are sparse."""
    rows, chars = [], 5041
    for p in range(206):
        texts = 2 if p < 5 else 1
        for i in range(texts):
            size = 24 if chars >= 24 else chars
            rows.append(("d", "document.xml", "document", p, i, 0, "x" * size))
            chars -= size
        extra = 2 if p < 113 else 1
        rows += [("d", "document.xml", "document", p, texts + i, None, None) for i in range(extra)]
    df = spark.createDataFrame(rows, "doc string, part string, part_kind string, para_idx int, run_idx int, text_idx int, text string")
    r = segments.document_structure(df).first()
    assert (r["num_paragraphs"], r["num_text_elements"], r["num_runs"]) == (206, 211, 530)
    assert (r["avg_text_length"], r["special_paragraphs"], r["needs_text_grouping"]) == (23.89099526066351, 0, True)


def test_structure_rules(spark):
    def shape(paragraphs):
        rows = [("d", "document.xml", "document", p, i, 0, t) for p, ts in enumerate(paragraphs) for i, t in enumerate(ts)]
        return segments.document_structure(
            spark.createDataFrame(rows, "doc string, part string, part_kind string, para_idx int, run_idx int, text_idx int, text string")
        ).first()

    long = "long enough text"
    assert shape([[long, long]])["needs_text_grouping"] is False
    assert shape([["a", " b ", "c", long * 9]] * 3)["special_paragraphs"] == 3
    assert shape([["a", "b", long * 9]] * 3)["special_paragraphs"] == 0
    assert shape([[long, long, "a", "b", long, "c"]])["special_paragraphs"] == 0
    assert shape([["abcd", "abcde"]])["needs_text_grouping"] is True


def test_text_corpus(spark, tmp_path):
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "one.txt").write_text("a\nb", encoding="utf-8")
    (tmp_path / "notestxt").write_text("ở", encoding="utf-8")
    (tmp_path / "NO.TXT").write_text("no")
    (tmp_path / "other.md").write_text("no")
    got = sorted((r["file_name"], r["text"]) for r in read_text_corpus(spark, str(tmp_path)).collect())
    assert got == [("notestxt", "ở"), ("one.txt", "a\nb")]


def test_job_status(spark, tmp_path):
    full = {
        "id": "1", "status": "completed", "progress": 100, "started_at": 1.5, "updated_at": 2.5, "estimated_time_remaining": 0,
        "document_analysis": {"num_paragraphs": 206, "needs_text_grouping": True},
        "processing_details": {"current_step": "completed", "cache_stats": {"hits": 21, "misses": 119, "hit_rate": 15.0}},
    }
    (tmp_path / "1.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "2.json").write_text(json.dumps({"id": "2", "status": "processing", "progress": 25, "started_at": 100.0, "document_analysis": None}))
    (tmp_path / "3.json").write_text("{ broken")
    one, two, three = read_job_status(spark, str(tmp_path)).orderBy("file_name").collect()
    assert one["processing_details"]["cache_stats"]["misses"] == 119 and one["document_analysis"]["num_runs"] is None
    assert two["document_analysis"] is None and two["updated_at"] is None
    assert three["id"] is None and three["_bad"] is not None
    seen = read_side_progress(read_job_status(spark, str(tmp_path)), F.lit(150.0)).orderBy("file_name").collect()
    assert (seen[0]["elapsed_time"], seen[1]["elapsed_time"], seen[1]["estimated_time_remaining"]) == (None, 50.0, 150.0)


def test_manifest_kinds(spark, tmp_path):
    samples = {
        "text_areas": ("1|1,2,3,4|t|0.5", "x|1,2|t|0.5", 0), "cropped": ("2|p|1,2,3,4|1,2,3,4|t|0.5|more", "2|p|1,2,3|1,2,3,4|t|0.5", 0),
        "processed": ("3|c|p|1,2|1,2,3,4|t|1", "3|c|p|1,2|1,2,3|t|1", 0), "extracted": ("4|p|o|e", "4|p|o", 1),
        "translated_texts": ("5|p|e|t", "five|p|e|t", 1), "translated": ("6|c|o|e|t|false", "6|c|o|e", 1),
    }
    for kind, (good, bad, header) in samples.items():
        path = tmp_path / f"{kind}.txt"
        path.write_text(("INDEX|HEADER\n" if header else "") + f"{good}\n{bad}\n\n{good}\n")
        rows, rejects = read_ocr_manifest(spark, str(path), kind)
        assert rows.count() == 2, kind
        assert [r["line"] for r in rejects.collect()] == [bad], kind
    rows, _ = read_ocr_manifest(spark, str(tmp_path / "cropped.txt"), "cropped")
    row = rows.first()
    assert row["rect"].asDict() == {"x": 1, "y": 2, "w": 3, "h": 4} and [(p["x"], p["y"]) for p in row["box"]] == [(1.0, 2.0), (3.0, 4.0)]
    assert [r["has_text"] for r in read_ocr_manifest(spark, str(tmp_path / "translated.txt"), "translated")[0].collect()] == [False, False]


def test_manifest_by_header_name(spark, tmp_path):
    path = tmp_path / "five.txt"
    path.write_text("INDEX|PATH|PROCESSED_PATH|ORIGINAL_TEXT|EXTRACTED_TEXT\n1|p|q|orig|read\n")
    row = read_ocr_manifest(spark, str(path), "extracted", by_header=True)[0].first()
    assert (row["index"], row["path"], row["processed_path"], row["original_text"], row["extracted_text"]) == (1, "p", "q", "orig", "read")
    by_position = parse_manifest(spark.read.text(str(path)), "extracted")[0].first()
    assert by_position["extracted_text"] == "orig"


def test_media(spark, tmp_path):
    for name, content in {"a.mp3": "x", "b.WAV": "x", "c.mp3": "", "d.ogg": "x", "crop_2.jpg": "x", "crop_10.JPG": "x", "w.docx": "x", "W.DOCX": "x"}.items():
        (tmp_path / name).write_text(content)
    audio = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in media_manifest(spark, str(tmp_path), "audio").collect()}
    assert (audio["a.mp3"], audio["b.WAV"], audio["c.mp3"], audio["d.ogg"]) == ("accepted", "accepted", "empty", "bad_format")
    images = {r["path"].rsplit("/", 1)[1]: r["number"] for r in media_manifest(spark, str(tmp_path), "image").filter("verdict = 'accepted'").collect()}
    assert images == {"crop_2.jpg": 2, "crop_10.JPG": 10}
    docs = [r["path"].rsplit("/", 1)[1] for r in media_manifest(spark, str(tmp_path), "document").filter("verdict = 'accepted'").collect()]
    assert docs == ["w.docx"]
    plan = media_manifest(spark, str(tmp_path), "audio")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    with pytest.raises(ValueError):
        media_manifest(spark, str(tmp_path), "video")


def test_chunk_store(spark, tmp_path):
    chunks = spark.createDataFrame([(f"f{i % 3}", i, 2000, f"t{i}", [float(i)]) for i in range(30)], "file_name string, chunk_idx int, chunk_size int, text string, embedding array<float>")
    write_chunk_store(chunks, str(tmp_path / "s"), buckets=4)
    back = read_chunk_store(spark, str(tmp_path / "s"))
    assert sorted(r["text"] for r in back.collect()) == sorted(f"t{i}" for i in range(30))
    assert back.groupBy("file_name").agg(F.countDistinct("bucket").alias("b")).filter("b > 1").count() == 0


def test_memory_versions(spark, tmp_path):
    schema = "key string, target_lang string, style string, source string, target string, last_used timestamp_ntz"
    day = lambda d: F.expr(f"timestamp_ntz'2024-01-0{d} 00:00:00'")
    make = lambda rows, d: spark.createDataFrame(rows, schema.replace(", last_used timestamp_ntz", "")).withColumn("last_used", day(d))
    old = make([("k1", "vi", "G", "a", "old1"), ("k2", "vi", "G", "b", "old2"), ("k3", "vi", "G", "c", "new3")], 3)
    fresh = make([("k1", "vi", "G", "a", "new1"), ("k4", "vi", "G", "d", "new4"), ("k1", "ja", "G", "a", "ja1")], 4).unionByName(
        make([("k1", "vi", "G", "a", "stale"), ("k3", "vi", "G", "c", "stale")], 2)
    )
    write_translation_memory(old, fresh, str(tmp_path / "v2"))
    got = {(r["key"], r["target_lang"]): r["target"] for r in spark.read.parquet(str(tmp_path / "v2")).collect()}
    assert got == {("k1", "vi"): "new1", ("k2", "vi"): "old2", ("k3", "vi"): "new3", ("k4", "vi"): "new4", ("k1", "ja"): "ja1"}
    with pytest.raises(Exception):
        write_translation_memory(old, fresh, str(tmp_path / "v2"))


def test_ledger_reader(spark, sf, tmp_path):
    from lexiloom.plans.tables import Tables

    Tables(spark, sf).transactions().write.parquet(str(tmp_path / "t"))
    rows = read_ledger(spark, "credit_transactions", path=str(tmp_path / "t"))
    assert dict(rows.dtypes)["amount"] == "decimal(10,2)" and rows.count() == 1000
    plan = rows.filter("user_id = 7").select("amount")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan and "ReadSchema: struct<user_id:bigint,amount:decimal(10,2)>" in plan
    with pytest.raises(ValueError):
        read_ledger(spark, "users")


def test_empty_and_full_media_have_one_form_of_path(spark, tmp_path):
    for name, data in {"a.mp3": b"x", "b.wav": b"", "in/deep/c.mp3": b"", "in/d.txt": b"y", "_hidden.mp3": b"", "in/.e.mp3": b""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    for folder in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        listed = {r["path"]: r["verdict"] for r in media_manifest(spark, folder, "audio").collect()}
        assert listed == {
            f"file:{tmp_path}/a.mp3": "accepted", f"file:{tmp_path}/b.wav": "empty",
            f"file:{tmp_path}/in/deep/c.mp3": "empty", f"file:{tmp_path}/in/d.txt": "bad_format",
        }
