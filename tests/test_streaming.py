"""Streams give the rows of their batch forms."""

import time

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import jobs
from lexiloom.operators.cache import ttl_cache_replay
from lexiloom.operators.credits import replay_credits
from lexiloom.plans.tables import Tables
from lexiloom.plans.streams import run_past_the_end
from lexiloom.streaming import inbox, late
from lexiloom.streaming import jobs as stream_jobs
from lexiloom.streaming import state


@pytest.fixture
def in_pieces(spark, tmp_path):
    """Writes a table as several files in time order and follows them one by one."""

    def make(df, order, pieces=3):
        folder = str(tmp_path / "in")
        rows = df.orderBy(order).collect()
        size = -(-len(rows) // pieces)
        for i in range(pieces):
            part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
            part.coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def finish(stream, tmp_path, mode="append"):
    """Runs a stream over what is there and returns what it wrote."""
    spark = stream.sparkSession
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "check")).option("path", out)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(out)


def shuffled_files(spark, df, folder, order, pieces):
    """Files whose rows lie out of time order: dealt by turns, the last file first."""
    all_rows = df.orderBy(order).collect()
    for i in reversed(range(pieces)):
        spark.createDataFrame(all_rows[i::pieces], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_cache_replay(spark, sf, in_pieces, tmp_path):
    requests = Tables(spark, sf).cache_requests().withColumn("ts", F.col("ts").cast("timestamp"))
    got = run_past_the_end(in_pieces(requests, "ts"), lambda r: state.stream_cache_replay(r, storable="storable"))
    want = ttl_cache_replay(requests, storable="storable")
    assert rows(got, "id", "key", "hit") == rows(want, "id", "key", "hit")
    assert got.filter("hit").count() > 0


def test_credit_replay(spark, sf, in_pieces, tmp_path):
    events = Tables(spark, sf).credit_events()
    got = run_past_the_end(in_pieces(events, "ts"), state.stream_credit_replay)
    want = replay_credits(events)
    assert rows(got, "seq", "verdict", "balance") == rows(want, "seq", "verdict", "balance")


def test_job_progress(spark, sf, in_pieces, tmp_path):
    events = Tables(spark, sf).status_events()
    columns = ["job_id", "seq", "percent", F.round("elapsed", 3), "elapsed_text", "eta_text"]
    got = run_past_the_end(in_pieces(events, "ts"), state.stream_job_progress)
    assert rows(got, *columns) == rows(jobs.job_progress(events), *columns)


def test_job_status(spark, sf, in_pieces, tmp_path):
    events = Tables(spark, sf).status_events()
    query = stream_jobs.write_current_status(
        stream_jobs.stream_job_status(in_pieces(events, "ts")), str(tmp_path / "now"), str(tmp_path / "check")
    )
    query.awaitTermination(120)
    got = stream_jobs.read_current_status(spark, str(tmp_path / "now"))
    want = jobs.fold_job_status(events)
    columns = ["job_id", "status", "current", "total", "message", "started_at", "updated_at"]
    assert rows(got, *columns) == rows(want, *columns)


def test_throughput_windows_close_with_the_watermark(spark, sf, in_pieces, tmp_path):
    events = Tables(spark, sf).status_events().withColumn("ts", F.col("ts").cast("timestamp"))
    got = finish(stream_jobs.stream_throughput(in_pieces(events, "ts"), width="1 day"), tmp_path)
    want = jobs.throughput(events, width="1 day")
    columns = ["job_id", "window_start", "events", "first_item", "last_item"]
    closed = {r["window_start"] for r in got.select("window_start").distinct().collect()}
    assert rows(got, *columns) == rows(want.filter(F.col("window_start").isin(list(closed))), *columns)
    assert len(closed) >= want.select("window_start").distinct().count() - 2


def test_each_text_once(spark, sf, in_pieces, tmp_path):
    segments = Tables(spark, sf).segments()
    got = finish(inbox.translate_once(in_pieces(segments, "doc_id"), "vi"), tmp_path)
    texts = [r["text"] for r in segments.filter("trim(text) <> ''").select("text").distinct().collect()]
    assert sorted(r["text"] for r in got.collect()) == sorted(texts)


def test_each_text_once_with_bounded_state(spark, sf, in_pieces, tmp_path):
    day = F.lit("2024-01-01").cast("timestamp")
    segments = Tables(spark, sf).segments().withColumn("ts", day + F.make_dt_interval(mins=F.col("doc_id").cast("int")))
    got = finish(inbox.translate_once(in_pieces(segments, "doc_id"), "vi", ts="ts", within="1 day"), tmp_path)
    assert got.count() == segments.filter("trim(text) <> ''").select("text").distinct().count()


def test_inbox_of_texts(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("one\n\ntwo\n")
    (folder / "notestxt").write_text("two")
    (folder / "B.TXT").write_text("never")
    lines = inbox.follow_texts(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = finish(inbox.translate_once(lines, "vi"), tmp_path)
    assert sorted(r["text"] for r in got.collect()) == ["one", "two"]


def test_streams_over_a_folder_of_shuffled_files(spark, sf, tmp_path):
    import __spark_entry__ as entry_points

    for table in ("events", "customer", "documents"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(4).write.parquet(f"{tmp_path}/{table}.parquet")
    for name in ("ttl_replay", "credit_replay", "job_progress", "status_folded"):
        got = entry_points.queries()[f"stream_{name}"](spark, str(tmp_path))
        want = entry_points.queries()[name](spark, sf)
        assert rows(got, *sorted(want.columns)) == rows(want, *sorted(want.columns))


def test_stream_replays_keep_missing_and_large_values(spark, tmp_path, in_pieces):
    moves = [(1, 1, 100, "add"), (2, 1, None, "add"), (3, 1, 50, "subtract"), (4, 2, 5, "add"), (5, 1, None, None)]
    df = spark.createDataFrame([(s, u, k, a, s, 2**53 + 1 if s % 2 else None) for s, u, a, k in moves], "seq long, user_id long, kind string, amount long, n int, big long").withColumn("ts", F.timestamp_seconds("n"))
    accounts = spark.createDataFrame([(1, 10)], "user_id long, credits long")
    got = run_past_the_end(in_pieces(df, "seq"), lambda r: state.stream_credit_replay(r, accounts))
    want = replay_credits(df, accounts)
    assert rows(got, "seq", "verdict", "balance", "big") == rows(want, "seq", "verdict", "balance", "big")


def test_files_out_of_time_order_give_the_batch_rows(spark, sf, tmp_path):
    t = Tables(spark, sf)
    events, requests, status = t.credit_events(), t.cache_requests(), t.status_events()
    long = "1000 days"
    for name, df, work, want, columns in (
        ("credits", events, lambda r: state.stream_credit_replay(r, lateness=long), replay_credits(events), ("seq", "verdict", "balance")),
        ("cache", requests, lambda r: state.stream_cache_replay(r, storable="storable", lateness=long), ttl_cache_replay(requests, storable="storable"), ("id", "hit")),
        ("jobs", status, lambda r: state.stream_job_progress(r, lateness=long), jobs.job_progress(status), ("seq", "percent", "elapsed_text", "eta_text")),
    ):
        stream = shuffled_files(spark, df, f"{tmp_path}/{name}", "ts", 2)
        assert rows(run_past_the_end(stream, work), *columns) == rows(want, *columns), name


def moves(spark, rows_in):
    df = spark.createDataFrame(rows_in, "seq long, user_id long, kind string, amount long, at long")
    return df.select("seq", "user_id", "kind", "amount", F.timestamp_micros("at").alias("ts"))


def test_rows_are_folded_and_given_out_when_the_watermark_passes(spark, tmp_path):
    second = 1_000_000
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    files = [[(1, 1, "subtract", 60, 5 * second), (2, 1, "add", 50, 4 * second)], [(3, 1, "subtract", 90, 3 * second), (4, 1, "add", 1, 100 * second)], [(5, 1, "add", 7, 300 * second)]]
    seen = []
    for part in files:
        moves(spark, part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(moves(spark, part).schema).parquet(folder)
        replayed = state.stream_credit_replay(stream, start=100, lateness="20 seconds")
        query = replayed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(120)
        seen.append(rows(spark.read.schema("seq long, verdict string, balance long").parquet(out), "seq", "balance"))
    # The first file waits. With the third second's row of the second file, refusals follow the order of time, not of files.
    assert seen == [[], [(1, 0), (2, 60), (3, 10)], [(1, 0), (2, 60), (3, 10), (4, 1)]]


def test_rows_of_one_millisecond_keep_microseconds_and_ties(spark, tmp_path):
    rows_in = [(i, 1, "add" if i % 3 else "subtract", 10 + i, 1_000_000 + (i * 7) % 5) for i in range(40)]
    df = moves(spark, rows_in)
    got = run_past_the_end(shuffled_files(spark, df, f"{tmp_path}/in", "seq", 3), lambda r: state.stream_credit_replay(r, start=0))
    assert rows(got, "seq", "verdict", "balance") == rows(replay_credits(df, start=0), "seq", "verdict", "balance")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    second = 1_000_000
    counted = late.count_late_rows(spark)
    try:
        # A trigger drops what is older than the watermark that the trigger before it worked with.
        files = [[(1, 1, "add", 1, 1000 * second)], [(9, 1, "add", 9, 1001 * second)], [(2, 1, "add", 2, 10 * second), (3, 1, "add", 3, 11 * second), (4, 1, "add", 4, 2000 * second)]]
        folder = f"{tmp_path}/in"
        for part in files:
            moves(spark, part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(moves(spark, files[0]).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        for name, work in (
            ("replay", state.stream_credit_replay(stream, lateness="5 seconds")),
            ("once", inbox.translate_once(stream.withColumn("text", F.col("seq").cast("string")), "vi", ts="ts", within="5 seconds")),
            ("minutes", stream_jobs.stream_throughput(stream.withColumn("current", F.col("seq")), "user_id", lateness="5 seconds")),
        ):
            query = work.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            query.awaitTermination(120)
        deadline = time.time() + 20
        while time.time() < deadline and min(counted.dropped[n] for n in ("replay", "once", "minutes")) < 1:
            time.sleep(0.2)
        # Windows are counted after they are put together: both late rows are of one minute.
        assert {n: counted.dropped[n] for n in ("replay", "once", "minutes")} == {"replay": 2, "once": 2, "minutes": 1}
    finally:
        spark.streams.removeListener(counted)


def test_progress_starts_at_the_first_real_start(spark, tmp_path, in_pieces):
    rows_in = [(1, 1, None, 1, 10), (1, 2, 0.0, 2, 10), (1, 3, 5.0, 3, 10), (1, 4, 9.0, 4, 10)]
    df = spark.createDataFrame(rows_in, "job_id long, seq long, started_at double, current long, total long").withColumn("ts", F.timestamp_seconds(F.col("seq") + 10))
    got = run_past_the_end(in_pieces(df, "seq"), state.stream_job_progress)
    want = jobs.job_progress(df)
    assert rows(got, "seq", "elapsed", "percent") == rows(want, "seq", "elapsed", "percent")
    assert {r.seq: r.elapsed for r in want.collect()} == {1: None, 2: None, 3: 8.0, 4: 9.0}


def test_follow_documents(spark, tmp_path):
    import io
    import zipfile

    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for n in range(2):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in (f"line {n}", "  ", "end"))
            archive.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
        (tmp_path / f"d{n}.docx").write_bytes(data.getvalue())
    got = finish(inbox.follow_documents(spark, str(tmp_path), 1), tmp_path)
    assert sorted(r.text for r in got.collect()) == ["end", "end", "line 0", "line 1"]
