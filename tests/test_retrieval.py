"""Chunks and neighbours."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions.chunks import register_chunks, split_text
from lexiloom.functions.inference import constant_factory
from lexiloom.operators import retrieval
from lexiloom.plans.knowledge_base import answerable, ingest
from lexiloom.sources import shared
from lexiloom.sources.sinks import read_chunk_store


def test_chunks_by_hand():
    assert split_text("") == [] and split_text(" \n ") == [] and split_text("short") == ["short"]
    assert split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert split_text("aaa bbb ccc ddd", 8, 0) == ["aaa bbb", "ccc ddd"]
    assert split_text("one\n\ntwo three\n\nfour", 10, 0) == ["one", "two three", "four"]
    assert split_text("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]
    assert split_text("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    # the blank comes before the full stop
    assert split_text("aaaa.bbbb cc", 8, 0) == ["aaaa", ".bbbb", "cc"]
    assert split_text("xxxxx。yyyy", 6, 0) == ["xxxxx", "。yyyy"]


@settings(max_examples=200, deadline=None)
@given(st.text("ab .,\n。", max_size=120), st.integers(4, 30), st.integers(0, 3))
def test_chunks_keep_every_character_in_order(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() and c in text for c in chunks)
    solid = [c for c in text if not c.isspace()]
    covered = iter("".join(c for chunk in chunks for c in chunk if not c.isspace()))
    assert all(any(c == d for d in covered) for c in solid)
    if overlap == 0:
        assert [c for chunk in chunks for c in chunk if not c.isspace()] == solid


def test_chunk_forms_agree(spark):
    docs = spark.createDataFrame([("a", "word " * 900), ("b", ""), ("c", None), ("d", "x" * 4500)], "file_name string, text string")
    chunks = retrieval.chunk_corpus(docs)
    register_chunks(spark)
    docs.createOrReplaceTempView("chunk_docs")
    listed = spark.sql("SELECT file_name, c.chunk_idx, c.chunk_size, c.chunk AS text FROM chunk_docs, LATERAL chunks(text) c")
    want = [(n, i, 2000, t) for n, text in (("a", "word " * 900), ("d", "x" * 4500)) for i, t in enumerate(split_text(text))]
    assert sorted(map(tuple, chunks.collect())) == sorted(want)
    assert sorted(map(tuple, listed.collect())) == sorted(want)
    both = retrieval.union_chunks([chunks, chunks])
    assert both.count() == 2 * len(want)


@pytest.mark.parametrize("length,starts", [(1, [0]), (400, [0]), (2000, [0]), (2001, [0, 1600]), (3600, [0, 1600]), (3601, [0, 1600, 3200])])
def test_windows(spark, length, starts):
    docs = spark.createDataFrame([("a", "x" * length)], "file_name string, text string")
    got = retrieval.chunk_windows(docs).orderBy("chunk_idx").collect()
    assert [r["start"] for r in got] == starts
    assert max(r["start"] + len(r["text"]) for r in got) == length


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 4, size=(500, 6)).astype(float)
    return data


@pytest.mark.parametrize("block, held, part, few", [(512, 65_536, 8192, 2048), (7, 14, 30, 9), (3, 0, 1, 4), (1, 5, 600, 600)])
def test_neighbours_equal_brute_force(spark, vectors, monkeypatch, block, held, part, few):
    for name, value in (("PART_VECTORS", part), ("BLOCK_VECTORS", few), ("PAIRS", 11)):
        monkeypatch.setattr(retrieval, name, value)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(vectors[:20] + 0.25)], "query_id string, embedding array<double>")
    got = retrieval.retrieve_topk(corpus, queries, 7, block=block, held_queries=held)
    result = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["distance"], 6)) for r in got.collect()}
    want = {}
    for i, q in enumerate(vectors[:20] + 0.25):
        distances = ((vectors - q) ** 2).sum(axis=1)
        order = sorted(range(len(vectors)), key=lambda j: (distances[j], j))[:7]
        want.update({(f"q{i}", rank + 1): (j, round(distances[j], 6)) for rank, j in enumerate(order)})
    assert result == want


def test_neighbours_take_one_job_however_many_ask(spark, vectors):
    corpus = spark.createDataFrame([(f"v{i}" * (1 + i % 3), v.tolist()) for i, v in enumerate(vectors)], "vec_id string, embedding array<float>")
    before = spark.sparkContext.statusTracker()
    counts = []
    for n in (10, 400):
        queries = spark.createDataFrame([(i % 50, v.tolist()) for i, v in enumerate(vectors[:n])], "query_id long, embedding array<double>")
        spark.sparkContext.setJobGroup(f"ask{n}", "")
        got = retrieval.retrieve_topk(corpus, queries, 3, block=5, held_queries=20).collect()
        counts.append(len(before.getJobIdsForGroup(f"ask{n}")))
        assert len(got) == 3 * n  # also queries that share an id
    assert counts[0] == counts[1]


def test_near_equal_distances_keep_apart(spark):
    far = 1e7  # the matrix product loses these differences
    corpus = spark.createDataFrame([(i, [far + i * 1e-3, far]) for i in range(200)], "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [far, far])], "query_id long, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.retrieve_topk(corpus, queries, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_kept_tables_are_found_under_any_form_of_path():
    forms = {"/a/b": "file:///a/b", "file:/a/b": "file:///a/b", "file:///a/b": "file:///a/b", "s3a://x/b": "s3://x/b", "hdfs://n/b": "hdfs://n/b"}
    assert {form: shared.folder_uri(form) for form in forms} == forms


def test_no_queries(spark, vectors):
    corpus = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert retrieval.retrieve_topk(corpus, none).count() == 0


def test_grades(spark):
    pairs = spark.createDataFrame([(1, 10, "yes"), (1, 11, "no"), (2, 12, "no"), (3, 13, None)], "query_id long, vec_id long, grade string")
    questions = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id long")
    relevant, unanswered = retrieval.split_by_grade(pairs, questions)
    assert [(r["query_id"], r["vec_id"]) for r in relevant.collect()] == [(1, 10)]
    assert sorted(r["query_id"] for r in unanswered.collect()) == [2, 3, 4]


def test_ingest_and_answer(spark, tmp_path):
    for folder, texts in {"one": {"cats.txt": "cats purr", "dogs.txt": "dogs bark"}, "two": {"sub/birds.txt": "birds sing"}}.items():
        for name, text in texts.items():
            path = tmp_path / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    letters = lambda texts: [[float(t.count(c)) for c in "acdgkprs"] for t in texts]
    store = str(tmp_path / "store")
    ingest(spark, [str(tmp_path / "one"), str(tmp_path / "two")], store, constant_factory(letters))
    saved = read_chunk_store(spark, store)
    assert sorted(r["text"] for r in saved.collect()) == ["birds sing", "cats purr", "dogs bark"]
    questions = spark.createDataFrame([(1, "cats purr"), (2, "zzz")], "query_id long, question string")
    same = constant_factory(lambda question, document: "yes" if question == document else "no")
    relevant, unanswered = answerable(saved, questions, constant_factory(letters), same, k=2)
    assert [(r["query_id"], r["document"]) for r in relevant.collect()] == [(1, "cats purr")]
    assert [r["query_id"] for r in unanswered.collect()] == [2]
    assert saved.filter(F.col("embedding").isNull()).count() == 0


def test_missing_vectors_find_nothing(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0]), (2, None)], "query_id long, embedding array<double>")
    assert [tuple(r) for r in retrieval.retrieve_topk(corpus, queries).collect()] == [(1, 1, 1.0, 1)]


def test_one_bad_text_costs_its_own_vector_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("good", "bad", "fine"):
        (tmp_path / "in" / f"{name}.txt").write_text(name)

    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]

    ingest(spark, [str(tmp_path / "in")], str(tmp_path / "store"), constant_factory(embed), rejects=str(tmp_path / "rejects"))
    assert sorted(r["text"] for r in read_chunk_store(spark, str(tmp_path / "store")).collect()) == ["fine", "good"]
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["bad"]
