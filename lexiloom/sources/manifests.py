"""The six `|`-separated manifests of the OCR steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import strip

# Fields in file order and whether the file opens with a header line.
LAYOUTS = {
    "text_areas": (("index", "box", "text", "confidence"), False),
    "cropped": (("index", "path", "box", "rect", "text", "confidence"), False),
    "processed": (("index", "crop_path", "processed_path", "box", "rect", "text", "confidence"), False),
    "extracted": (("index", "path", "original_text", "extracted_text"), True),
    "translated_texts": (("index", "path", "extracted_text", "translated_text"), True),
    "translated": (("index", "crop_path", "output_path", "extracted_text", "translated_text"), True),
}
# Why an empty line is neither a row nor a reject.
EMPTY = "empty"
# Optional sixth field of `translated`.
HAS_TEXT = "has_text"
# Some writers put a processed path between path and texts: such files are read by their header.
HEADER_NAMES = {
    "INDEX": "index",
    "PATH": "path",
    "CROP_PATH": "crop_path",
    "PROCESSED_PATH": "processed_path",
    "OUTPUT_PATH": "output_path",
    "ORIGINAL_TEXT": "original_text",
    "EXTRACTED_TEXT": "extracted_text",
    "TRANSLATED_TEXT": "translated_text",
    "HAS_TEXT": HAS_TEXT,
}


def _numbers(text: Column, kind: str) -> Column:
    return F.transform(F.split(text, ",", -1), lambda n: strip(n).try_cast(kind))


def _points(n: Column) -> Column:
    """x1, y1, x2, y2, ... -> points; NULL unless every number is there and they pair up."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(n, i * 2).alias("x"), F.get(n, i * 2 + 1).alias("y")),
    )
    whole = (F.size(n) > 1) & (F.size(n) % 2 == 0) & ~F.exists(n, lambda v: v.isNull())
    return F.when(whole, pairs)


def _rect(n: Column) -> Column:
    """x, y, w, h -> struct; NULL unless the first four are whole numbers."""
    first = F.slice(n, 1, 4)
    return F.when(
        (F.size(first) == 4) & ~F.exists(first, lambda v: v.isNull()),
        F.struct(*[F.get(n, F.lit(i)).alias(name) for i, name in enumerate("xywh")]),
    )


def judge_manifest(lines: DataFrame, kind: str, header: str | None = None) -> DataFrame:
    """`value` lines of one kind -> their fields, the `line` and the `reason` why it is no row, NULL for rows.

    The reason `EMPTY` is no fault. Read both rows and rejects from one pass with
    `pick_rows`: a filter on parsed columns would be pushed below the parsing and
    parse every line a second time. Lines with too few fields or with numbers that do not parse are rejected one
    by one; header lines are recognised by their first field. With `header` (the
    text of the file's first line) the fields are taken by name instead of by
    position.
    """
    fields, has_header = LAYOUTS[kind]
    if header is not None:
        fields = tuple(HEADER_NAMES.get(name.strip().upper(), name.strip().lower()) for name in header.split("|"))
    others = [c for c in lines.columns if c != "value"]
    needed = len(fields)
    line = lines.select(*others, strip(F.col("value")).alias("line")).withColumn("_p", F.split("line", r"\|", -1))
    if has_header or header is not None:
        line = line.filter(F.upper(strip(F.get("_p", F.lit(0)))) != "INDEX")
    typed = {
        "index": lambda c: strip(c).try_cast("int"),
        "confidence": lambda c: strip(c).try_cast("double"),
        "box": lambda c: _numbers(c, "double"),
        "rect": lambda c: _numbers(c, "int"),
        HAS_TEXT: lambda c: F.lower(strip(c)) != "false",
    }
    enough = F.size("_p") >= needed
    for i, name in enumerate(fields):
        raw = F.get("_p", F.lit(i))
        line = line.withColumn(name, typed[name](raw) if name in typed else raw)
    # A second projection: the lists of numbers are read many times, but made once.
    shapes = {"box": _points, "rect": _rect}
    line = line.withColumns({name: shapes[name](F.col(name)) for name in fields if name in shapes})
    if kind == "translated" and HAS_TEXT not in fields:
        line = line.withColumn(HAS_TEXT, F.coalesce(F.lower(strip(F.get("_p", F.lit(needed)))) != "false", F.lit(True)))
    bad = F.lit(False)
    for name in ("index", "confidence", "box", "rect"):
        if name in fields:
            bad = bad | F.col(name).isNull()
    reason = F.when(~enough, "too_few_fields").when(bad, "bad_number")
    shown = [*others, *fields] + ([HAS_TEXT] if kind == "translated" and HAS_TEXT not in fields else [])
    return line.select(*shown, "line", F.when(reason.isNotNull() & (F.col("line") == ""), EMPTY).otherwise(reason).alias("reason"))


def is_row() -> Column:
    return F.col("reason").isNull()


def is_reject() -> Column:
    return F.col("reason") != EMPTY


def pick_rows(judged: DataFrame, *choices: tuple[Column, Sequence[Column | str]]) -> DataFrame:
    """For each judged line the columns of the first condition that holds; lines that meet none are left out."""
    picked = F
    for condition, columns in choices:
        picked = picked.when(condition, F.array(F.struct(*columns)))
    return judged.select(F.inline(picked))


def parse_manifest(lines: DataFrame, kind: str, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`value` lines of one kind -> (rows, rejects with `line` and `reason`), as `judge_manifest` finds them."""
    judged = judge_manifest(lines, kind, header)
    others = [c for c in lines.columns if c != "value"]
    fields = [c for c in judged.columns if c not in ("line", "reason")]
    return pick_rows(judged, (is_row(), fields)), pick_rows(judged, (is_reject(), [*others, "line", "reason"]))


def read_ocr_manifest(spark: SparkSession, path: str, kind: str, by_header: bool = False) -> tuple[DataFrame, DataFrame]:
    """Manifest files of one kind -> (rows, rejects), with the file each line came from.

    `by_header` takes the field order from the first line of the files, which
    must agree among them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    header = None
    if by_header:
        first = lines.filter(F.upper("value").startswith("INDEX|")).select("value").first()
        header = first["value"] if first else None
    return parse_manifest(lines, kind, header)
