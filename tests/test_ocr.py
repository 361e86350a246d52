"""Geometry by hand-made images and by a plain walk over the boxes."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.inference import constant_factory
from lexiloom.operators import ocr
from lexiloom.plans import image_job
from lexiloom.sources.sinks import ocr_documents, write_ocr_results

BOX = "image_id long, idx long, x_min int, y_min int, x_max int, y_max int, text string, confidence double"


def walk(boxes, h, v):
    """Merged boxes of one image: list of (text, hull)."""
    lines, result = [], []
    for box in sorted(boxes, key=lambda b: (b[3], b[1])):
        middle = (box[3] + box[5]) / 2
        if lines and abs(middle - lines[-1][0]) <= v:
            lines[-1][1].append(box)
            lines[-1][0] = middle
        else:
            lines.append([middle, [box]])
    for _, line in lines:
        line.sort(key=lambda b: b[2])
        groups = [[line[0]]]
        for left, right in zip(line, line[1:]):
            if right[2] - left[4] > h:
                groups.append([])
            groups[-1].append(right)
        for g in groups:
            hull = (min(b[2] for b in g), min(b[3] for b in g), max(b[4] for b in g), max(b[5] for b in g))
            result.append((" ".join(b[6] for b in g), hull))
    return result


def test_merging_equals_a_walk(spark):
    rnd = random.Random(11)
    data = []
    for image in range(30):
        for idx in range(rnd.randint(1, 25)):
            x, y = rnd.randint(0, 300), rnd.randint(0, 12) * 7
            data.append((image, idx, x, y, x + rnd.randint(5, 60), y + rnd.randint(5, 20), f"t{idx}", rnd.random()))
    merged = ocr.merge_nearby_boxes(spark.createDataFrame(data, BOX), 20, 6).orderBy("image_id", "line", "group_no").collect()
    for image in range(30):
        got = [(r["text"], (r["x_min"], r["y_min"], r["x_max"], r["y_max"])) for r in merged if r["image_id"] == image]
        assert got == walk([b for b in data if b[0] == image], 20, 6)


def test_merge_limits_are_inclusive_and_ties_keep_reader_order(spark):
    data = [
        (1, 0, 100, 10, 110, 20, "b", 0.5), (1, 1, 100, 10, 105, 20, "c", 1.0),
        (1, 2, 60, 20, 70, 30, "a", 0.9), (1, 3, 200, 31, 210, 41, "d", 0.1),
    ]
    got = [(r["text"], round(r["confidence"], 3)) for r in ocr.merge_nearby_boxes(spark.createDataFrame(data, BOX)).orderBy("line", "group_no").collect()]
    # centres 15, 15, 25 are within 10; 36 is 11 away. The gap 60..70 to 100 is exactly 30.
    assert got == [("a b c", 0.8), ("d", 0.1)]


def test_regions_store_the_whole_and_cut_the_clamped_rectangle(spark):
    boxes = spark.createDataFrame([(1, 5, -4, 2, 10, 8, "x", 1.0), (1, 9, 90, 45, 120, 60, "y", 1.0)], BOX)
    images = spark.createDataFrame([(1, 100, 50)], "image_id long, width int, height int")
    first, second = ocr.number_regions(boxes, images).orderBy("region").collect()
    assert (first["region"], first["x"], first["w"], first["crop_x"], first["crop_w"]) == (1, -4, 15, 0, 15)
    assert (second["x"], second["w"], second["h"], second["crop_w"], second["crop_h"]) == (90, 31, 16, 10, 5)
    assert first["file_name"] == "crop_1.jpg"


def test_detections(spark):
    flat = spark.createDataFrame([(1, 0, 3, 10, 40, 20, "a", 1.0), (1, 1, 200, 0, 210, 5, "gone", 1.0), (1, 2, 1, 1, 5, 5, " ", 1.0)], BOX)
    free = spark.createDataFrame(
        [(1, 3, "f", [(50.0, 30.0), (70.0, 28.0), (72.0, 44.0), (52.0, 46.0)])],
        "image_id long, idx long, text string, pts array<struct<x: double, y: double>>",
    )
    images = spark.createDataFrame([(1, 75, 60)], "image_id long, width int, height int")
    got = {r["text"]: (r["kind"], r["x_min"], r["y_min"], r["x_max"], r["y_max"], r["width"]) for r in ocr.union_detections(flat, free, images).collect()}
    assert got == {"a": ("horizontal", 0, 5, 45, 25, 45), "f": ("free", 45, 23, 75, 51, 30)}


def test_grid_shapes_and_even_cells(spark):
    images = spark.createDataFrame([(1, 401, 200), (2, 300, 200), (3, 100, 201), (4, 200, 200), (5, 400, 200)], "image_id long, width int, height int")
    cells = ocr.fallback_grid(images)
    counts = {r["image_id"]: (r["rows"], r["cols"]) for r in cells.groupBy("image_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")).collect()}
    assert counts == {1: (2, 4), 2: (2, 3), 3: (4, 2), 4: (3, 3), 5: (2, 3)}
    even = spark.createDataFrame([(4, 0, 0, 9.9), (4, 0, 1, 10.0)], "image_id long, row int, col int, std double")
    left = {r["text"] for r in ocr.fallback_grid(images, even).filter("image_id = 4").collect()}
    assert "Region_0_0" not in left and "Region_0_1" in left and len(left) == 8


def test_placement_rules(spark):
    crops = spark.createDataFrame(
        [(1, 1, 1, 0, 0, 10, 10), (1, 1, 2, 5, 5, 10, 10), (1, 2, 3, 95, 0, 10, 10), (1, 3, 4, -1, 0, 5, 5), (1, 4, 5, 90, 40, 10, 10)],
        "image_id long, region int, pos int, x int, y int, w int, h int",
    )
    translated = spark.createDataFrame(
        [(1, 1, None, 10, 10), (1, 2, True, 9, 10), (1, 3, True, 5, 5), (1, 4, True, 10, 10), (1, 4, False, 1, 1), (1, 9, True, 1, 1)],
        "image_id long, region int, has_text boolean, out_w int, out_h int",
    )
    images = spark.createDataFrame([(1, 100, 50)], "image_id long, width int, height int")
    plan = ocr.placement_plan(translated, crops, images)
    got = sorted((r["region"], r["x"], r["inside"], r["resize"]) for r in plan.collect())
    assert got == [(1, 5, True, False), (2, 95, False, True), (3, -1, False, False), (4, 90, True, False)]
    inside, rejected = ocr.inside_and_rejected(plan)
    assert inside.count() == 2 and rejected.count() == 2


def test_grid_placement_needs_a_number(spark):
    names = ["a/crop_1.jpg", "crop_9.png", "crop_10.jpg", "crop_x.jpg", "other_3.jpg", "crop_5_v2.jpg"]
    df = spark.createDataFrame([(1, n, True) for n in names], "image_id long, crop_path string, has_text boolean")
    images = spark.createDataFrame([(1, 100, 50)], "image_id long, width int, height int")
    got = {r["crop_path"]: (r["region"], r["x"], r["y"], r["inside"]) for r in ocr.placement_plan_grid(df, images).collect()}
    assert got == {
        "a/crop_1.jpg": (1, 0, 0, True), "crop_9.png": (9, 66, 32, True), "crop_10.jpg": (10, 0, 48, False), "crop_5_v2.jpg": (5, 33, 16, True),
    }


def test_corrections(spark):
    lines = spark.createDataFrame([(1, 0, "aa"), (1, 1, "bb"), (2, 0, "cc")], "image_id long, pos int, text string")
    replies = spark.createDataFrame([(1, "1. AA\n\n 2) x.y \n"), (2, "1. CC\n2. DD")], "image_id long, reply string")
    corrected = ocr.explode_numbered_lines(replies)
    assert sorted((r["image_id"], r["pos"], r["text"]) for r in corrected.collect()) == [(1, 0, "AA"), (1, 1, "y"), (2, 0, "CC"), (2, 1, "DD")]
    got = sorted((r["image_id"], r["pos"], r["text_corrected"]) for r in ocr.align_corrections(lines, corrected).collect())
    assert got == [(1, 0, "AA"), (1, 1, "y"), (2, 0, "cc")]
    full = spark.createDataFrame([(1, "all")], "image_id long, full_text string")
    first, second = ocr.correction_requests(lines, full, strict=True).orderBy("image_id").collect()
    assert (first["items"], first["numbered_text"], first["full_text"], first["mode"]) == (2, "1. aa\n2. bb", "all", "strict")
    assert second["full_text"] is None


def test_numbered_lines_by_hand(spark):
    cases = {"12345. x": "12345. x", "1234. x": "x", "1 a.b": "b", "x1. y": "x1. y", "  7.z": "z", "2026 is. it": "2026 is. it"}
    for line, want in cases.items():
        got = ocr.explode_numbered_lines(spark.createDataFrame([(line,)], "reply string")).first()
        assert got["text"] == want, line


def test_languages(spark):
    values = ["zh", "vi", "xx", "French", "ch_sim", "EN", "Farsi"]
    got = {r["lang"]: (r["ocr_code"], r["name_ocr_code"], r["display_name"], r["target_name"]) for r in ocr.map_language(spark.createDataFrame([(v,) for v in values], "lang string")).collect()}
    assert got == {
        "zh": ("ch_sim", None, "zh", "Chinese"), "vi": ("vi", None, "Vietnamese", "Vietnamese"), "xx": ("en", None, "xx", "xx"),
        "French": ("en", "fr", "French", "French"), "ch_sim": ("en", None, "Chinese", "ch_sim"), "EN": ("en", None, "EN", "EN"),
        "Farsi": ("en", "fa", "Farsi", "Farsi"),
    }
    codes = spark.createDataFrame([("rs_latin",), ("zz",)], "c string").select(ocr.supported_reader_code(F.col("c")).alias("c"))
    assert [r["c"] for r in codes.collect()] == ["rs_latin", "en"]


def test_natural_order(spark):
    names = ["crop_10.jpg", "crop_2.jpg", "logo.png", "d_1/crop_3.jpg", "a_x.jpg", "processed_2_7.jpg"]
    got = [(r["path"], r["number"]) for r in ocr.natural_order(spark.createDataFrame([(n,) for n in names], "path string")).collect()]
    assert got == [("a_x.jpg", 0), ("logo.png", 0), ("crop_2.jpg", 2), ("processed_2_7.jpg", 2), ("d_1/crop_3.jpg", 3), ("crop_10.jpg", 10)]


def test_result_documents(spark, tmp_path):
    lines = spark.createDataFrame(
        [(1, 1, 0, 0, 5, 5, "b", "B", 0.5), (1, 0, 1, 1, 2, 2, "a", "A", 0.25), (2, 0, 0, 0, 1, 1, "c", "c", 1.0)],
        "image_id long, pos int, x_min int, y_min int, x_max int, y_max int, text string, text_corrected string, confidence double",
    )
    info = spark.createDataFrame([(1, "vi", "a b")], "image_id long, language string, full_text string")
    write_ocr_results(ocr_documents(lines, info), str(tmp_path / "out"))
    one, two = spark.read.json(str(tmp_path / "out")).orderBy("image_id").collect()
    assert [(r["text_original"], r["text_corrected"], r["bbox"]["x_max"]) for r in one["results"]] == [("a", "A", 2), ("b", "B", 5)]
    assert (one["language"], one["full_text"], two["language"]) == ("vi", "a b", "unknown")


def test_regions_of_merges_first(spark):
    boxes = spark.createDataFrame(
        [(1, 0, 0, 0, 10, 10, "a", 0.5), (1, 1, 15, 0, 30, 10, "b", 0.7), (1, 2, 200, 0, 220, 10, "c", 0.9)],
        "image_id long, idx long, x_min int, y_min int, x_max int, y_max int, text string, confidence double",
    )
    images = spark.createDataFrame([(1, 300, 100)], "image_id long, width int, height int")
    merged = image_job.regions_of(boxes, images).orderBy("region").collect()
    assert [(r.region, r.text, r.x, r.w) for r in merged] == [(1, "a b", 0, 31), (2, "c", 200, 21)]
    assert [r.text for r in image_job.regions_of(boxes, images, merge=False).orderBy("region").collect()] == ["a", "b", "c"]


def test_a_strict_second_request_is_made_where_counts_differ(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def service(prompt):
        with open(seen, "a") as log:
            log.write(repr(prompt) + "\n")
        lines = prompt.split("\n\n")[0].split("\n")
        return "\n".join(x.upper() for x in (lines if "\n\n" not in prompt or len(lines) == 1 else lines[:-1]))

    lines = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "c")], "image_id long, pos int, text string")
    full = spark.createDataFrame([(1, "a"), (2, "bc")], "image_id long, full_text string")
    got = image_job.corrected_lines(lines, full, constant_factory(service))
    assert sorted((r.image_id, r.pos, r.text_corrected) for r in got.collect()) == [(1, 0, "A"), (2, 0, "B"), (2, 1, "C")]
    assert sorted(open(seen).read().splitlines()) == sorted(map(repr, ["1. a\n\na", "1. b\n2. c\n\nbc", "1. b\n2. c"]))


@pytest.mark.parametrize("kind", ["text", "number"])
def test_one_image_with_one_top_and_one_left_edge(spark, monkeypatch, kind):
    """Crowds of one value are cut by the box number: no slice is larger than twice the bound, and results stay the same."""
    import random

    from lexiloom.operators import skew

    rnd = random.Random(1)
    name = (lambda i: f"{i * 7919 % 1000:06d} of the one long line") if kind == "text" else (lambda i: i * 7919 % 1000 - 2**60)
    data = [(1, name(i), 0 if i % 3 else rnd.randrange(900), 5, 40 + rnd.randrange(900), 15, f"w{i}", 0.5) for i in range(300)]
    boxes = spark.createDataFrame(data, f"image_id long, idx {'string' if kind == 'text' else 'long'}, x_min int, y_min int, x_max int, y_max int, text string, confidence double").repartition(3)
    sizes = []
    plain = skew.cut_into_slices
    def noted(df, keys, *a, **k):
        cut = plain(df, keys, *a, **k)
        sizes.append(cut.groupBy(*keys, "_slice").count().agg({"count": "max"}).first()[0])
        return cut
    monkeypatch.setattr(ocr, "cut_into_slices", noted)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(ocr.merge_nearby_boxes(boxes, max_rows=60)) == rows(ocr.merge_nearby_boxes(boxes, max_rows=None))
    assert rows(ocr.region_numbers(boxes, max_rows=60)) == rows(ocr.region_numbers(boxes, max_rows=None))
    assert len(sizes) >= 3 and max(sizes) <= 120
