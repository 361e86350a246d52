"""The registered queries against SQL or brute force on the smallest tables, and the pipeline stage by stage."""

import os
import sys
import zlib

import duckdb
import pandas as pd
import pytest
from lexiloom.llm import language, minhash
from lexiloom.llm.oracles import ORACLES
from lexiloom.llm.queries import registry

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

QUERIES = registry()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        path = f"/root/testdata/sf0.001/{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def lines(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert lines(QUERIES[name](spark, sf).toPandas()) == lines(duck.sql(ORACLES[name]).df())


def test_native_queries_use_no_python(spark, sf):
    for name in ("op1_pii", "op7_line_dedup", "op8_decontamination"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct"))


def test_token_queries_agree_with_each_other(spark, sf):
    files = QUERIES["op10_token_files"](spark, sf).toPandas().sort_values("doc_id")
    pieces = QUERIES["op3_packing"](spark, sf).toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == dict(zip(files.doc_id, files.n_tokens, strict=True))
    whole = pieces[pieces.length == pieces.doc_tokens].set_index("doc_id").ids_crc32
    assert whole.to_dict() == files.set_index("doc_id").ids_crc32.loc[whole.index].to_dict()
    assert files.start.tolist() == [0, *files.n_tokens.cumsum().tolist()[:-1]]
    assert pieces.length.sum() / (pieces.sequence_id.nunique() * 4096) > 0.9


def test_languages_of_held_out_documents(spark, sf, duck):
    got = QUERIES["op4_language_id"](spark, sf).toPandas().merge(duck.sql("SELECT doc_id, lang FROM documents").df(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98


def test_main_text_of_pages(spark, sf):
    got = QUERIES["op6_main_text"](spark, sf).toPandas()
    assert (got.n_chars > 0).mean() > 0.99 and not got.text.str.contains("<p>|margin:0|track\\(").any()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(1).selectExpr("-1L AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    frame = docs.unionByName(odd).selectExpr("*", "1 AS n_lines", "2 AS lang_pred", "3 AS found_id")
    before = frame.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after_frame = stage(spark, frame, sf)
        assert after_frame.columns == frame.columns, name
        after = after_frame.toPandas()
        assert set(after.doc_id) <= set(before.doc_id)
        if name == "language":
            assert set(before.doc_id) - set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text, strict=True) if t is None or not language.has_letter(t)}
        elif name == "lines":
            assert len(after) == len(before) and (after.lang_pred == 2).all() and (after.n_lines == 1).all()
        elif name == "near_duplicates":
            kept = minhash.near_duplicates(frame).where("kept").toPandas()
            assert set(after.doc_id) == set(kept.doc_id) and set(after.doc_id) < set(before.doc_id)
        else:
            assert len(after) < len(before)
        before, frame = after, after_frame
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf).toPandas()
    assert set(packed.doc_id) == set(before.doc_id)
    assert isinstance(packed, pd.DataFrame) and len(packed) >= len(before)
