"""Translating a table of segments through a user function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.answer_log import AnswerLog
from lexiloom.functions.inference import Factory, log_bucket, text_hook
from lexiloom.functions.text import contains_any, spaced, strip, unmasked, without_phrases
from lexiloom.operators.memory import IDENTITY, join_by_identity, tm_misses, with_key
from lexiloom.operators.textwork import mask_formats, mask_links


def empty_memory(spark) -> DataFrame:
    return spark.createDataFrame(
        [], "key string, target_lang string, style string, source string, target string, last_used timestamp_ntz"
    )


def translate_misses(
    misses: DataFrame,
    factory: Factory,
    protect: str | None = "formats",
    attempts: int = 3,
    tasks: int | None = None,
    pause: float = 0,
    log: AnswerLog | None = None,
) -> DataFrame:
    """`source` -> `target`, `outcome` (translated, reverted or failed) and `error`, the last failure, for distinct texts.

    Mask, repair, call, clean, unmask, then revert to the source when the answer
    is an excuse. `tasks` is the number of tasks that call the function: fewer for
    a service that limits its callers, more for very many texts, so that a
    repeated task costs little. By default every core gets two. Failed calls are
    tried again after `pause` seconds. With a `log`, answers are kept as they
    come, and a repeated task, or a repeated job, asks for the others only.
    """
    count = tasks or 2 * misses.sparkSession.sparkContext.defaultParallelism
    if log is None:
        misses = misses.repartition(count)
    if protect == "formats":
        prepared = mask_formats(misses, "source").withColumn("masked", strip(spaced(F.col("masked"))))
    elif protect == "links":
        prepared = mask_links(misses, "source")
    else:
        none = F.array().cast("array<struct<placeholder: string, original: string>>")
        prepared = misses.withColumn("masked", F.col("source")).withColumn("spans", none)
    prepared = prepared.withColumn("_context", F.concat_ws("|", *IDENTITY[1:]))
    if log is not None:
        at = log_bucket(log, "masked", "_context")
        prepared = prepared.withColumn("_bucket", at).repartition(count, "_bucket").sortWithinPartitions("_bucket").drop("_bucket")
    answered = prepared.withColumn("_reply", text_hook(factory, attempts, pause, log)(F.col("masked"), F.col("_context")))
    answered = answered.withColumn("_answer", F.col("_reply.answer"))
    clean = without_phrases(F.col("_answer")) if protect == "formats" else F.col("_answer")
    reverted = contains_any(F.col("_restored"), fixed.REVERT_MARKERS)
    if protect == "links":
        reverted = reverted | contains_any(F.col("_restored"), fixed.NO_TEXT_MARKERS)
    return (
        answered.withColumn("_restored", unmasked(clean, F.col("spans")))
        .withColumn(
            "outcome",
            F.when(F.col("_restored").isNull(), "failed").when(reverted, "reverted").otherwise("translated"),
        )
        .withColumn("target", F.when(F.col("outcome") == "translated", F.col("_restored")).otherwise(F.col("source")))
        .select(*IDENTITY, "source", "target", "outcome", F.col("_reply.error").alias("error"))
    )


def translate_batch(
    segments: DataFrame,
    factory: Factory,
    target_lang: str,
    style: str = "General",
    memory: DataFrame | None = None,
    text: str = "text",
    protect: str | None = "formats",
    attempts: int = 3,
    tasks: int | None = None,
    fresh: DataFrame | None = None,
    pause: float = 0,
    log: AnswerLog | None = None,
) -> DataFrame:
    """Adds `target` and `outcome` to every segment.

    The function sees each missing text once, wherever and however often it
    occurs. Outcomes are blank, remembered, translated, reverted or failed; the
    last two keep the source. `fresh` takes the result of `translate_misses`
    when the caller has stored it already, e.g. to write the memory from it too.
    """
    keyed = with_key(segments, target_lang, style, text)
    known = empty_memory(segments.sparkSession) if memory is None else memory
    if fresh is None:
        fresh = translate_misses(tm_misses(keyed, known, text), factory, protect, attempts, tasks, pause, log)
    # Memory and fresh pairs are disjoint, so one join serves both.
    remembered = known.filter(F.col("target") != "").select(*IDENTITY, "target", F.lit("remembered").alias("outcome"))
    answers = remembered.unionByName(fresh.select(*IDENTITY, "target", "outcome"))
    blank = F.col("key").isNull()
    return join_by_identity(keyed, answers).withColumns(
        {"target": F.when(blank, F.col(text)).otherwise(F.col("target")), "outcome": F.when(blank, "blank").otherwise(F.col("outcome"))}
    )
