"""Readers of many texts: no object per file on the driver, few tasks, the rows of Spark's own scan."""

import os
import pickle
import shutil

import pytest
from pyspark.sql import functions as F

from lexiloom.plans.streams import run_to_end
from lexiloom.sources.corpus import SUFFIX, TextReader, TextStreamReader, read_text_corpus
from lexiloom.sources.listing import FilePart
from lexiloom.streaming.inbox import follow_texts


def names(parts: list[FilePart]) -> list[str]:
    return [os.path.basename(p) for part in parts for p in part.paths]


@pytest.fixture
def odd_files(tmp_path):
    """Names that are hidden, written as %XX or read as patterns; texts that are empty or no UTF-8."""
    found = {
        "in/a b/p%q é.txt": b"x\xff\xfey\n", "in/a b/_x=1/_k=2.txt": b"u\r\nv", "in/[c]/d?{e}.txt": b"\n\n", "in/notestxt": "﻿ở".encode(),
        "in/_h/a.txt": b"never", "in/.h/a.txt": b"never", "in/empty.txt": b"", "in/_meta.txt": b"never", "in/x.txt._COPYING_": b"never", "in/NO.TXT": b"never",
    }
    for name, data in found.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path / "in")


def scanned(spark, folder):
    """As Spark's text source reads them."""
    df = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    rows = df.select("_metadata.file_path", "_metadata.file_name", F.hex("value")).collect()
    return sorted(tuple(r) for r in rows if r[1].endswith(SUFFIX))


def test_texts_are_those_of_the_file_scan(spark, odd_files):
    want = scanned(spark, odd_files)
    assert len(want) == 4
    for folder in (odd_files, f"file:{odd_files}", f"file://{odd_files}/"):
        got = read_text_corpus(spark, folder).select("path", "file_name", F.hex("text")).collect()
        assert sorted(map(tuple, got)) == want, folder
    one = read_text_corpus(spark, f"{odd_files}/notestxt").collect()
    assert [r["file_name"] for r in one] == ["notestxt"] and read_text_corpus(spark, f"{odd_files}/a*").count() == 2
    os.mkdir(f"{odd_files}/none")
    assert read_text_corpus(spark, f"{odd_files}/none").count() == 0
    with pytest.raises(Exception):
        read_text_corpus(spark, f"{odd_files}/missing").collect()


def test_many_texts_need_few_tasks_and_little_of_the_driver(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"doc_id={i}.txt").write_text(f"text {i}")
    df = read_text_corpus(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= 4
    assert df.select(F.sum(F.regexp_extract("text", r"(\d+)", 1).cast("long"))).first()[0] == 3000 * 2999 // 2
    parts = TextReader({"path": str(tmp_path)}).partitions()
    assert sorted(names(parts)) == sorted(os.listdir(tmp_path)) and len(pickle.dumps(parts)) < 3000 * 16


def test_a_stream_of_texts_reads_each_file_once(spark, odd_files, tmp_path):
    place = str(tmp_path / "place")
    run = lambda: sorted((r["file_name"], r["para_idx"], r["text"]) for r in run_to_end(follow_texts(spark, odd_files), place=place).collect())
    lines = read_text_corpus(spark, odd_files).select("file_name", F.posexplode(F.split("text", "\n", -1)))
    want = sorted(tuple(r) for r in lines.collect() if r[2].strip("\r\n "))
    assert run() == want and run() == want
    # A file that was written long ago is new when it is moved in.
    late = tmp_path / "late.txt"
    late.write_text("late")
    os.utime(late, (1, 1))
    shutil.move(late, f"{odd_files}/late.txt")
    assert run() == sorted([*want, ("late.txt", 0, "late")])


def test_a_stream_plans_in_parts_and_takes_so_many_files_later(tmp_path):
    follow = TextStreamReader({"path": str(tmp_path), "maxFilesPerTrigger": "2"})
    assert follow.latestOffset() == follow.initialOffset() == {"changed": -1}
    for i in range(2000):
        (tmp_path / f"{i}.txt").write_text("x")
    first = follow.latestOffset()
    parts = follow.partitions({"changed": -1}, first)
    assert len(names(parts)) == 2000 and len(pickle.dumps(parts)) < 2000 * 16
    ends = [first]
    for i in range(2000, 2005):
        (tmp_path / f"{i}.txt").write_text("x")
        os.utime(tmp_path / f"{i}.txt", ns=(i, first["changed"] + i * 1_000_000_000))  # all of them in the future
    assert follow.latestOffset() == first
    for i in range(2000, 2005):
        os.utime(tmp_path / f"{i}.txt", ns=(i, first["changed"] + i - 1900))
    seen = []
    while (end := follow.latestOffset()) != ends[-1]:
        seen.append(names(follow.partitions(ends[-1], end)))
        ends.append(end)
    assert sorted(sum(seen, [])) == [f"{i}.txt" for i in range(2000, 2005)]
