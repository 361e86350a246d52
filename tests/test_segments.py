"""Segments: assembly, redistribution, fallbacks and previews by hand."""

from pyspark.sql import functions as F

from lexiloom.functions.inference import constant_factory
from lexiloom.operators import memory, segments
from lexiloom.plans.document_job import translate_documents
from lexiloom.plans.translation import translate_batch

RUNS = "doc string, part string, part_kind string, para_idx int, run_idx int, text_idx int, text string"


def runs_of(spark, paragraphs, doc="d", part="document.xml", kind="document"):
    return spark.createDataFrame(
        [(doc, part, kind, p, i, 0, t) for p, texts in enumerate(paragraphs) for i, t in enumerate(texts)], RUNS
    )


def test_assembly(spark):
    runs = runs_of(spark, [["Hello ", " ", "12", "world", "iv"], ["12", "3,5"], [" ", ""], ["ab"], ["a", "bc"]])
    got = {r["para_idx"]: (r["source"], r["translate"], [x["kind"] for x in r["runs"]]) for r in segments.assemble_segments(runs).collect()}
    assert got == {
        0: ("Hello world", True, ["text", "number", "text", "roman"]), 1: ("", False, ["number", "number"]),
        3: ("ab", False, ["text"]), 4: ("abc", True, ["text", "text"]),
    }


def redistribute(spark, texts, target):
    segment = segments.assemble_segments(runs_of(spark, [texts])).withColumn("target", F.lit(target).cast("string"))
    return [r["new_text"] for r in segments.redistribute_segments(segment).orderBy("run_idx").collect()]


def test_redistribution_rules(spark):
    assert redistribute(spark, ["one text"], "x\ny") == ["x\ny"]
    assert redistribute(spark, ["ab ", "gh"], "xyz") == ["xyz", ""]
    assert redistribute(spark, ["ab ", "7", "gh"], "xyz") == ["xyz", "7", ""]
    assert redistribute(spark, ["ab ", "gh"], None) == ["ab ", "gh"]
    assert redistribute(spark, ["ab ", "gh"], "") == ["ab ", "gh"]
    assert redistribute(spark, ["one text"], "") == [""]
    assert redistribute(spark, ["a\nb", "gh"], "x") == ["x", ""]
    assert redistribute(spark, ["ab ", "gh"], "x\ny") == ["x\ny", ""]
    # two source lines, three elements: the third keeps its text
    assert redistribute(spark, ["ab\n", "gh", "ef"], "x\ny") == ["x", "y", "ef"]
    # surplus lines join the last element used
    assert redistribute(spark, ["ab\n", "gh", "ef"], "x\ny\nz\nw") == ["x", "y\nz\nw", "ef"]
    assert redistribute(spark, ["a\nb\nc ", "de"], "x\n\nz") == ["x", "z"]
    assert redistribute(spark, ["a\nb\nc ", "de"], "x\ny\nz") == ["x", "y\nz"]


def test_preview(spark):
    runs = runs_of(spark, [["a"], [" "], ["b" * 100], ["c" * 60, "d" * 41], ["e"]])
    texts = segments.paragraph_texts(runs)
    got = [(r["number"], r["position"], r["preview"]) for r in segments.paragraph_preview(texts, 2, 1).orderBy("position").collect()]
    assert got == [(3, 2, "b" * 100), (4, 3, "c" * 60 + "d" * 40 + "...")]


def test_fallback_only_without_a_translated_main_part(spark):
    runs = runs_of(spark, [["a long element", "short"]], "d1").unionByName(runs_of(spark, [["another long element"]], "d2"))
    header = runs_of(spark, [["a long header text"]], "d1", "header1.xml", "header")
    done = spark.createDataFrame([("d1", "header1.xml", 0, True), ("d1", "document.xml", 0, False), ("d2", "document.xml", 0, True)], "doc string, part string, para_idx int, ok boolean")
    got = [r["text"] for r in segments.fallback_text_elements(runs.unionByName(header), done).collect()]
    assert got == ["a long element"]


def test_hook_sees_every_missing_text_once_and_failures_keep_the_source(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def fn(text):
            if "fail" in text:
                raise RuntimeError("service down")
            with open(log, "a") as f:
                f.write(text + "\n")
            return "I'm sorry, but no" if "sorry" in text else "<" + text + ">"

        return fn

    texts = ["same line"] * 20 + ["known line", " ", "fail me", "make sorry", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    known = spark.createDataFrame([("known line", "remembered!"), ("same line", "")], "source string, target string")
    known = memory.with_key(known, "vi", "General", "source").withColumn("last_used", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = translate_batch(df, factory, "vi", memory=known, protect=None).collect()
    by_text = {r["text"]: (r["target"], r["outcome"]) for r in got}
    assert len(got) == len(texts)
    assert by_text == {
        "same line": ("<same line>", "translated"), "known line": ("remembered!", "remembered"), " ": (" ", "blank"),
        "fail me": ("fail me", "failed"), "make sorry": ("make sorry", "reverted"), None: (None, "blank"),
    }
    assert sorted(open(log).read().split("\n")) == ["", "make sorry", "same line"]


def test_protected_spans_survive_the_hook(spark):
    df = spark.createDataFrame([("Seehttp://x.y/Za andMore",), ("Translation:see /usr/lib now",)], "text string")
    upper = constant_factory(str.upper)
    got = sorted(r["target"] for r in translate_batch(df, upper, "vi").collect())
    assert got == ["SEEhttp://x.y/Za AND MORE", "TRANSLATION : SEE /usr/lib NOW"]
    links = sorted(r["target"] for r in translate_batch(df, upper, "vi", protect="links").collect())
    assert links == ["SEEhttp://x.y/Za ANDMORE", "TRANSLATION:SEE /USR/LIB NOW"]


def test_document_job(spark):
    runs = runs_of(spark, [["Hello ", "world"], ["Hello world"], ["12"], ["keep this"]], "d1").unionByName(
        runs_of(spark, [["please fail here", "x"]], "d2")
    )

    def factory():
        def fn(text):
            if "fail here" in text:
                return "Please provide the text"
            return text.upper()

        return fn

    done = translate_documents(runs, factory, "vi")
    texts = {(r["doc"], r["para_idx"], r["run_idx"]): r["new_text"] for r in done.runs.collect()}
    assert texts == {
        ("d1", 0, 0): "HELLO WORLD", ("d1", 0, 1): "", ("d1", 1, 0): "HELLO WORLD", ("d1", 2, 0): "12", ("d1", 3, 0): "KEEP THIS",
        ("d2", 0, 0): "please fail here", ("d2", 0, 1): "x",
    }
    counts = {(r["doc"], r["part"]): (r["translated"], r["segments"]) for r in done.counts.collect()}
    assert counts[("d1", "document.xml")] == (3, 4) and counts[("d2", None)] == (0, 1) and counts[(None, None)] == (3, 5)
    assert {(r["text"], r["outcome"]) for r in done.fallback.collect()} == {("please fail here", "reverted")}
    assert {r["doc"]: (r["hits"], r["misses"]) for r in done.cache.collect()} == {"d1": (1, 2), "d2": (0, 1)}
    assert sorted(r["source"] for r in done.fresh.collect()) == ["Hello world", "keep this"]
    again = translate_documents(runs, factory, "vi", memory=done.fresh)
    assert again.fresh.count() == 0 and {r["doc"]: r["hits"] for r in again.cache.collect()} == {"d1": 3, "d2": 0}


def test_memory_touch_and_stats(spark):
    keyed = memory.with_key(spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", " "), ("b", "z")], "job string, text string"), "vi", "G")
    stats = {r["job"]: (r["hits"], r["misses"], r["total_requests"], r["hit_rate"], r["cache_size"]) for r in memory.tm_stats(keyed).collect()}
    assert stats == {"a": (1, 2, 3, 1 / 3 * 100, 2), "b": (0, 1, 1, 0.0, 1)}
    time = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz")
    store = keyed.filter("text = 'x'").select("key", "target_lang", "style").distinct().withColumn("last_used", time(1))
    used = keyed.withColumn("used_at", time(5))
    assert str(memory.touch(store, used).first()["last_used"]) == "2024-01-05 00:00:00"
