"""Text boxes in images: merging, numbering, placing, and aligning corrected text.

A box row has `image_id, idx, x_min, y_min, x_max, y_max, text, confidence`;
`idx` is its position in the reader's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.languages import DEFAULT_OCR, TRANSLATOR_NAMES, iso_rows, name_rows
from lexiloom.functions.text import is_blank, strip
from lexiloom.operators.selection import numbers_of, small_numbers
from lexiloom.operators.skew import GROUP_ROWS, cut_into_slices, running_count, running_islands, split_hot
from lexiloom.session import materialize

BOX = ("x_min", "y_min", "x_max", "y_max")


# --- merging -----------------------------------------------------------------
def _islands(df: DataFrame, keys: list[str], order: list[Column], shown: Column, compared: Column, breaks, name: str) -> DataFrame:
    """Gaps and islands inside one sorted pass per group."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    opens = F.when(breaks(F.lag(shown).over(ordered), compared), 1).otherwise(0)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(upto)).drop("_opens")


def merge_box_group(grouped: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Hull, blank-joined text in `order`, and mean confidence of each group."""
    texts = F.sort_array(F.collect_list(F.struct(*order, "text")))
    # An exact decimal sum: the mean must not depend on the order of the rows.
    total = F.sum(F.col("confidence").cast("decimal(18,8)")).cast("double")
    return grouped.groupBy(*keys).agg(
        F.min("x_min").alias("x_min"),
        F.min("y_min").alias("y_min"),
        F.max("x_max").alias("x_max"),
        F.max("y_max").alias("y_max"),
        F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text"),
        (total / F.count(F.lit(1))).alias("confidence"),
        F.count(F.lit(1)).alias("boxes"),
    )


def _merge_once(boxes: DataFrame, horizontal: int, vertical: int, max_rows: int | None) -> DataFrame:
    center = (F.col("y_min") + F.col("y_max")) / 2
    by_line = ["image_id", "line"]
    y_order = [F.col("_top"), F.col("idx")]
    x_order = [F.col("x_min"), F.col("_top"), F.col("idx")]
    new_line = lambda prev, this: F.abs(this - prev) > vertical
    new_group = lambda prev, this: this - prev > horizontal
    x_max, x_min = F.col("x_max"), F.col("x_min")

    prepared = boxes.withColumn("_top", F.col("y0") if "y0" in boxes.columns else F.col("y_min"))
    usual, hot = split_hot(prepared, ["image_id"], max_rows)
    lines = _islands(usual, ["image_id"], y_order, center, center, new_line, "line")
    # The second window and the aggregate reuse the partitioning by image.
    marked = _islands(lines, by_line, x_order, x_max, x_min, new_group, "group_no")
    if hot is not None:
        # Boxes that share a top, or a left edge, are cut by what they are sorted by next.
        by_idx = small_numbers(numbers_of(hot, "idx"))
        sliced = materialize(cut_into_slices(hot, ["image_id"], F.col("_top"), max_rows, ties=by_idx))
        hot_lines = running_islands(sliced, ["image_id"], y_order, center, center, new_line, "line").drop("_slice")
        # A crowded image mostly has ordinary lines; only crowded lines are cut once more.
        short, long = split_hot(materialize(hot_lines), by_line, max_rows)
        marked = marked.unionByName(_islands(short, by_line, x_order, x_max, x_min, new_group, "group_no"))
        if long is not None:
            sliced = materialize(cut_into_slices(long, by_line, x_min, max_rows, ties=[F.col("_top"), *by_idx]))
            marked = marked.unionByName(running_islands(sliced, by_line, x_order, x_max, x_min, new_group, "group_no").drop("_slice"))
    return merge_box_group(marked, [*by_line, "group_no"], ["x_min", "_top", "idx"])


def merge_nearby_boxes(
    boxes: DataFrame,
    horizontal: int = fixed.MERGE_HORIZONTAL,
    vertical: int = fixed.MERGE_VERTICAL,
    passes: int = 1,
    max_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Boxes of one line that are close together become one box; result has `line` and `group_no`.

    Boxes sorted by their top share a line while neighbouring centres differ by
    at most `vertical`; within a line sorted by x, a gap to the previous box
    above `horizontal` starts a new box. Both tests look at the direct
    predecessor, so `lag` is exact. One shuffle by image carries everything.
    """
    merged = _merge_once(boxes, horizontal, vertical, max_rows)
    for _ in range(passes - 1):
        again = merged.withColumn("idx", F.shiftleft(F.col("line").cast("long"), 32) + F.col("group_no"))
        merged = _merge_once(again.drop("line", "group_no", "boxes"), horizontal, vertical, max_rows)
    return merged


# --- regions -----------------------------------------------------------------
def region_numbers(boxes: DataFrame, max_rows: int | None = GROUP_ROWS) -> DataFrame:
    """Adds the 1-based `region` number of each box in its image, in reader order."""
    keys, order = ["image_id"], [F.col("idx")]
    usual, hot = split_hot(boxes, keys, max_rows)
    numbered = usual.withColumn("region", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if hot is not None:
        first, *ties = small_numbers(numbers_of(hot, "idx")) or [F.col("idx")]
        sliced = materialize(cut_into_slices(hot, keys, first, max_rows, ties=ties))
        numbered = numbered.unionByName(running_count(sliced, keys, order, "region").drop("_slice"))
    return numbered


def region_rect() -> list[Column]:
    """x, y, w, h of a box. A rectangle around integer points covers both border pixels."""
    x, y = F.col("x_min"), F.col("y_min")
    return [x.alias("x"), y.alias("y"), (F.col("x_max") - x + 1).alias("w"), (F.col("y_max") - y + 1).alias("h")]


def number_regions(boxes: DataFrame, images: DataFrame, max_rows: int | None = GROUP_ROWS) -> DataFrame:
    """Region numbers, the stored rectangle (x, y, w, h) and the clamped one to cut (crop_*)."""
    shaped = region_numbers(boxes, max_rows).select("image_id", "idx", "region", *region_rect(), "text", "confidence")
    left, top = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    return shaped.join(images.select("image_id", "width", "height"), "image_id").select(
        *[c for c in shaped.columns if c not in ("text", "confidence")],
        left.alias("crop_x"),
        top.alias("crop_y"),
        F.least(F.col("width") - left, F.col("w")).alias("crop_w"),
        F.least(F.col("height") - top, F.col("h")).alias("crop_h"),
        F.concat(F.lit("crop_"), F.col("region").cast("string"), F.lit(".jpg")).alias("file_name"),
        "text",
        "confidence",
    )


def union_detections(horizontal: DataFrame, free: DataFrame, images: DataFrame, padding: int = fixed.DETECTION_PADDING) -> DataFrame:
    """Horizontal boxes (x_min, x_max, y_min, y_max) and free boxes (`pts`) in one shape.

    Each is padded and clamped to its image; empty regions and blank texts go.
    """
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    flat = lambda kind, *sides: [
        "image_id", "idx", F.lit(kind).alias("kind"), "text",
        *[side.cast("int").alias(name) for side, name in zip(sides, BOX)],
    ]
    boxes = horizontal.select(*flat("horizontal", *[F.col(c) for c in BOX])).unionByName(
        free.select(*flat("free", F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    )
    return (
        boxes.join(images.select("image_id", "width", "height"), "image_id")
        .withColumns(
            {
                "x_min": F.greatest(F.lit(0), F.col("x_min") - padding),
                "y_min": F.greatest(F.lit(0), F.col("y_min") - padding),
                "x_max": F.least("width", F.col("x_max") + padding),
                "y_max": F.least("height", F.col("y_max") + padding),
            }
        )
        .filter((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")) & ~is_blank(F.col("text")))
        .withColumn("width", F.col("x_max") - F.col("x_min"))
        .withColumn("height", F.col("y_max") - F.col("y_min"))
    )


def fallback_grid(images: DataFrame, deviations: DataFrame | None = None) -> DataFrame:
    """Grid cells for images in which nothing was found.

    The grid follows the aspect ratio. `deviations` (image_id, row, col, std)
    drops the cells that are too even to hold text.
    """
    w, h = F.col("width"), F.col("height")
    shape = (
        F.when(w > h * 2, F.struct(F.lit(2).alias("r"), F.lit(4).alias("c")))
        .when(w > h, F.struct(F.lit(2).alias("r"), F.lit(3).alias("c")))
        .when(h > w * 2, F.struct(F.lit(4).alias("r"), F.lit(2).alias("c")))
        .otherwise(F.struct(F.lit(3).alias("r"), F.lit(3).alias("c")))
    )
    cells = (
        images.withColumn("_g", shape)
        .withColumn("_cw", F.floor(w / F.col("_g.c")).cast("int"))
        .withColumn("_ch", F.floor(h / F.col("_g.r")).cast("int"))
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_g.r") - 1)))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_g.c") - 1)))
    )
    if deviations is not None:
        even = deviations.filter(F.col("std") < fixed.FALLBACK_MIN_STD).select("image_id", "row", "col")
        cells = cells.join(even, ["image_id", "row", "col"], "left_anti")
    return cells.select(
        "image_id",
        "row",
        "col",
        (F.col("col") * F.col("_cw")).alias("x_min"),
        (F.col("row") * F.col("_ch")).alias("y_min"),
        ((F.col("col") + 1) * F.col("_cw")).alias("x_max"),
        ((F.col("row") + 1) * F.col("_ch")).alias("y_max"),
        F.concat_ws("_", F.lit("Region"), F.col("row").cast("string"), F.col("col").cast("string")).alias("text"),
        F.lit(fixed.FALLBACK_CONFIDENCE).alias("confidence"),
    )


# --- placing -----------------------------------------------------------------
def _placed(regions: DataFrame, images: DataFrame) -> DataFrame:
    sized = regions.join(images.select("image_id", "width", "height"), "image_id")
    inside = (
        (F.col("x") >= 0)
        & (F.col("y") >= 0)
        & (F.col("x") + F.col("w") <= F.col("width"))
        & (F.col("y") + F.col("h") <= F.col("height"))
    )
    return sized.withColumn("inside", inside).drop("width", "height")


def placement_plan(translated: DataFrame, crops: DataFrame, images: DataFrame) -> DataFrame:
    """Where each translated region goes, with `inside` false for those beyond the image.

    `crops` may list a region twice (`pos` is its line): the last one counts.
    Regions without text are left out. `resize` says that the translated picture
    (`out_w`, `out_h`) does not have the region's size; NULL when not known.
    """
    # Four numbers instead of one struct: they aggregate by hash, without a sort.
    last = crops.groupBy("image_id", "region").agg(*[F.max_by(c, "pos").alias(c) for c in ("x", "y", "w", "h")])
    wanted = translated.filter(F.coalesce("has_text", F.lit(True)))
    joined = wanted.join(last, ["image_id", "region"]).select(*wanted.columns, "x", "y", "w", "h")
    if "out_w" in wanted.columns:
        joined = joined.withColumn("resize", (F.col("out_w") != F.col("w")) | (F.col("out_h") != F.col("h")))
    return _placed(joined, images)


def placement_plan_grid(translated: DataFrame, images: DataFrame, side: int = 3) -> DataFrame:
    """Placing without a crop list: by the number in the file name, row by row in a 3 x 3 grid.

    Names that are not `crop_<number>` are left out.
    """
    name = F.element_at(F.split("crop_path", "/"), -1)
    number = F.regexp_extract(name, r"^crop_([0-9]+)(?:[._]|$)", 1)
    region = F.expr("try_cast(_number AS INT)")
    wanted = translated.filter(F.coalesce("has_text", F.lit(True))).withColumn("_number", number)
    cell_w, cell_h = F.floor(F.col("width") / side).cast("int"), F.floor(F.col("height") / side).cast("int")
    placed = (
        wanted.withColumn("region", region)
        .filter(F.col("region").isNotNull())
        .join(images.select("image_id", "width", "height"), "image_id")
        .withColumn("x", F.pmod(F.col("region") - 1, F.lit(side)) * cell_w)
        .withColumn("y", F.floor((F.col("region") - 1) / side).cast("int") * cell_h)
        .withColumn("w", cell_w)
        .withColumn("h", cell_h)
        .drop("width", "height", "_number")
    )
    return _placed(placed, images)


def inside_and_rejected(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return placed.filter("inside").drop("inside"), placed.filter("NOT inside").drop("inside")


# --- corrections -------------------------------------------------------------
def correction_requests(lines: DataFrame, extracted: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One request per image: its numbered OCR lines, how many, and the full text read.

    `lines` has image_id, pos, text; `extracted` has image_id, full_text. The
    strict form asks for nothing but the numbered lines.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    numbered = F.transform(ordered, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["text"]))
    requests = lines.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("items"), F.array_join(numbered, "\n").alias("numbered_text")
    )
    if extracted is not None:
        requests = requests.join(extracted.select("image_id", "full_text"), "image_id", "left")
    return requests.withColumn("mode", F.lit("strict" if strict else "normal"))


def explode_numbered_lines(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Reply -> one row per non-blank line (`pos` from 0), without its leading number."""
    lines = F.filter(F.transform(F.split(reply, "\n", -1), strip), lambda line: line != "")
    exploded = replies.select(
        *[c for c in replies.columns if c != reply], F.posexplode(lines).alias("pos", "_line")
    )
    line = F.col("_line")
    numbered = line.rlike(r"^\p{Nd}") & F.substring(line, 1, 5).contains(".")
    rest = strip(F.expr("substring(_line, instr(_line, '.') + 1)"))
    return exploded.withColumn("text", F.when(numbered, rest).otherwise(line)).drop("_line")


def agreeing_images(lines: DataFrame, corrected: DataFrame) -> DataFrame:
    """Images that have as many corrected lines as lines."""
    # Both counts in one aggregate over narrow rows: +1 per line, -1 per corrected line.
    signed = lines.select("image_id", F.lit(1).alias("_n")).unionByName(corrected.select("image_id", F.lit(-1).alias("_n")))
    return signed.groupBy("image_id").agg(F.sum("_n").alias("_n")).filter("_n = 0").select("image_id")


def align_corrections(lines: DataFrame, corrected: DataFrame) -> DataFrame:
    """OCR lines with the corrected text at the same position (`text_corrected`).

    Only images whose line counts agree are corrected; the others keep their text.
    """
    usable = corrected.join(agreeing_images(lines, corrected), "image_id", "left_semi").select(
        "image_id", "pos", F.col("text").alias("text_corrected")
    )
    return lines.join(usable, ["image_id", "pos"], "left").withColumn(
        "text_corrected", F.coalesce("text_corrected", "text")
    )


# --- languages and names -----------------------------------------------------
def map_language(df: DataFrame, column: str = "lang") -> DataFrame:
    """OCR code and English names of a language given as code or as name.

    Adds `ocr_code` (by ISO code, `en` if unknown), `name_ocr_code` (by name),
    `display_name` (the code's first name, else the value itself) and
    `target_name` (the translator's name of the code, else the value itself).
    The four tables are fixed and hold fewer than a hundred rows each.
    """
    spark = df.sparkSession
    first_names = {}
    for name, code, _ in name_rows():
        first_names.setdefault(code, name)
    tables = {
        "ocr_code": iso_rows(),
        "name_ocr_code": [(name, code) for name, code, _ in name_rows()],
        "display_name": list(first_names.items()),
        "target_name": list(TRANSLATOR_NAMES.items()),
    }
    result = df
    for target, rows in tables.items():
        table = spark.createDataFrame(rows, f"_key string, {target} string")
        result = result.join(F.broadcast(table), F.col(column) == F.col("_key"), "left").drop("_key")
    return result.withColumns(
        {
            "ocr_code": F.coalesce("ocr_code", F.lit(DEFAULT_OCR)),
            "display_name": F.coalesce("display_name", column),
            "target_name": F.coalesce("target_name", column),
        }
    )


def supported_reader_code(code: Column) -> Column:
    """The OCR code itself when the reader knows it, else English."""
    known = sorted({c for _, c, _ in name_rows()})
    return F.when(code.isin(known), code).otherwise(F.lit(DEFAULT_OCR))


def file_number(path: Column) -> Column:
    """The number after the first `_` of a file name up to the next dot; 0 when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    part = F.get(F.split(name, "_"), F.lit(1))
    digits = F.regexp_extract(F.get(F.split(part, r"\."), F.lit(0)), r"^\s*([+-]?[0-9]+)\s*$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def natural_order(files: DataFrame, path: str = "path") -> DataFrame:
    """Files sorted by the number in their name, then by path."""
    return files.withColumn("number", file_number(F.col(path))).orderBy("number", path)
