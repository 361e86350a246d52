"""Images: detections -> merged boxes -> regions -> corrected lines -> placement and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.inference import Factory, text_hook
from lexiloom.operators.ocr import (
    agreeing_images,
    align_corrections,
    correction_requests,
    explode_numbered_lines,
    merge_nearby_boxes,
    number_regions,
)
from lexiloom.session import materialize


def regions_of(boxes: DataFrame, images: DataFrame, merge: bool = True) -> DataFrame:
    """Numbered regions of all images, merged first when asked."""
    if merge:
        merged = merge_nearby_boxes(boxes)
        boxes = merged.withColumn("idx", F.shiftleft(F.col("line").cast("long"), 32) + F.col("group_no"))
    return number_regions(boxes, images)


def corrected_lines(
    lines: DataFrame, extracted: DataFrame, factory: Factory, attempts: int = 3, strict_factory: Factory | None = None
) -> DataFrame:
    """OCR lines with the service's corrections, one request per image and a strict second one where it is needed.

    The request text is the numbered list, a blank line, and the full text.
    Images whose answer has another number of lines are asked again with the
    numbered list alone; those that fail once more keep their own text.
    """

    def asked(requests: DataFrame, prompt: Column, service: Factory) -> DataFrame:
        replies = materialize(requests.select("image_id", text_hook(service, attempts)(prompt, F.lit("")).getField("answer").alias("reply")))
        return explode_numbered_lines(replies)

    prompt = F.concat_ws("\n\n", "numbered_text", "full_text")
    first = asked(correction_requests(lines, extracted), prompt, factory)
    fit = agreeing_images(lines, first)
    open_lines = lines.join(fit, "image_id", "left_anti")
    second = asked(correction_requests(open_lines, strict=True), F.col("numbered_text"), strict_factory or factory)
    return align_corrections(lines, first.join(fit, "image_id", "left_semi").unionByName(second))
