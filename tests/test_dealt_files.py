"""Files of one key each, texts that are dealt before they are cut, and manifests that are read once."""

import os

from pyspark.sql import functions as F

from lexiloom.operators import segments
from lexiloom.plans import files, queries
from lexiloom.plans.tables import Tables
from lexiloom.schemas import RUNS
from lexiloom.sources.corpus import read_text_corpus
from lexiloom.sources.manifests import is_reject, is_row, judge_manifest, parse_manifest, pick_rows
from lexiloom.sources.status import read_job_status


def below(folder: str) -> list[str]:
    return [os.path.join(at, name) for at, _, names in os.walk(folder.removeprefix("file:")) for name in names]


def tables_of(spark, folder, rows) -> Tables:
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").write.parquet(f"{folder}/documents.parquet")
    return Tables(spark, str(folder))


def plan_of(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_text_files_need_no_move_and_no_folder_of_their_own(spark):
    rows = [(i, f"a {i}\n é") for i in range(600)] + [(-4, ""), (7, "twice"), (9, None)]
    folder = files.text_files_of(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    found = below(folder)
    assert len(found) == 601 and len({os.path.dirname(f) for f in found}) <= files.FOLDERS
    assert {os.path.basename(os.path.dirname(f)).partition("=")[0] for f in found} == {"bucket"}
    texts = {r["path"].rpartition("/")[2]: r["text"] for r in read_text_corpus(spark, folder).collect()}
    assert texts["doc_id=-4.txt"] == "\n" and texts["doc_id=12.txt"] == "a 12\n é\n"
    assert sorted(texts["doc_id=7.txt"].split("\n")) == sorted(["", "a 7", " é", "twice"])
    assert sorted(texts["doc_id=9.txt"].split("\n")) == sorted(["", "", "a 9", " é"])


def test_status_files_keep_fields_and_missing_ones(spark):
    rows = [(1, "done", 5, 1.5, 'said "é"'), (None, None, None, None, None), (-3, "on", 0, 0.0, "")]
    current = spark.createDataFrame(rows, "job_id LONG, status STRING, current LONG, started_at DOUBLE, message STRING")
    folder = files.status_files(current)
    assert len(below(folder)) == 3
    got = read_job_status(spark, folder).select("id", "status", "progress", "started_at", "message", "_bad").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("1", "done", 5, 1.5, 'said "é"', None), (None,) * 6, ("-3", "on", 0, 0.0, "", None)], key=str)


def test_words_are_not_shuffled_for_documents_and_paragraphs(spark, tmp_path):
    t = tables_of(spark, tmp_path, [(i, f"One two {i}\nthree\nfour", "en") for i in range(20)])
    for name in ("segments_assembled", "segments_redistributed", "translated_rollup", "paragraph_preview"):
        plan = plan_of(queries.QUERIES[name](t))
        cut = [i for i, line in enumerate(plan) if "Generate posexplode" in line]
        dealt = [i for i, line in enumerate(plan) if "Exchange" in line and "REPARTITION" in line]
        assert cut and dealt and min(dealt) > max(cut), name  # the plan's leaves are its last lines
        above = [line for line in plan[: min(cut)] if "Exchange" in line]
        assert all("para_idx" not in line for line in above), name


def test_elements_without_numbers_come_first_and_stay(spark):
    rows = [("d", "document.xml", "document", 0, r, x, t, None) for r, x, t in [(1, 0, "b "), (None, None, "a "), (0, None, "12"), (0, 1, None), (2, 0, " "), (0, 0, "iv")]]
    runs = spark.createDataFrame(rows, RUNS)
    got = segments.assemble_segments(runs).collect()[0]
    assert got["source"] == "a b " and got["translate"]
    assert [tuple(r) for r in got["runs"]] == [(None, None, "a ", "text"), (0, None, "12", "number"), (0, 0, "iv", "roman"), (1, 0, "b ", "text")]
    assert segments.paragraph_texts(runs).collect()[0]["text"] == "a 12ivb  "
    assert segments.paragraph_texts(runs.filter("text IS NULL")).collect()[0]["text"] == ""


def test_rows_and_rejects_of_a_manifest_from_one_pass(spark, tmp_path):
    lines = spark.createDataFrame([(1, "1|a|b|c"), (2, ""), (3, "x|a|b|c"), (4, "5|a"), (5, " INDEX|p|q|r"), (6, None)], "at LONG, value STRING")
    judged = judge_manifest(lines, "extracted")
    one = pick_rows(judged, (is_row(), ["at", F.lit("row").alias("what")]), (is_reject(), ["at", F.col("reason").alias("what")]))
    assert sorted(map(tuple, one.collect())) == [(1, "row"), (3, "bad_number"), (4, "too_few_fields")]
    rows, rejects = parse_manifest(lines, "extracted")
    assert [r["at"] for r in rows.collect()] == [1] and sorted(r["at"] for r in rejects.collect()) == [3, 4]
    spark.sql("SELECT 1L l_orderkey, 1 l_linenumber, 2L l_partkey, 3L l_suppkey, 4.0D l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = plan_of(queries.manifest_layouts(Tables(spark, str(tmp_path))))
    assert sum("FileScan" in line for line in plan) == len(queries.MANIFESTS)
