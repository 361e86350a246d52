"""Word documents: runs -> segments -> translation -> runs with new texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.inference import Factory
from lexiloom.operators.memory import tm_misses, tm_stats, with_key
from lexiloom.operators.segments import (
    assemble_segments,
    fallback_text_elements,
    redistribute_segments,
    translated_counts,
)
from lexiloom.plans.translation import empty_memory, translate_batch, translate_misses
from lexiloom.session import materialize


@dataclass
class TranslatedDocuments:
    runs: DataFrame  # text elements with new_text
    fallback: DataFrame  # long single elements of documents without a translated paragraph
    counts: DataFrame  # per part, per document, in all
    cache: DataFrame  # hits and misses per document
    fresh: DataFrame  # new pairs for the memory


def translate_documents(
    runs: DataFrame,
    factory: Factory,
    target_lang: str,
    style: str = "General",
    memory: DataFrame | None = None,
    attempts: int = 3,
    tasks: int | None = None,
) -> TranslatedDocuments:
    """All documents in one job. The answers are stored once, because several results read them."""
    segments = assemble_segments(runs)
    known = empty_memory(runs.sparkSession) if memory is None else memory
    wanted = segments.filter("translate")
    keyed = with_key(wanted, target_lang, style, "source")
    fresh = materialize(translate_misses(tm_misses(keyed, known, "source"), factory, "formats", attempts, tasks))
    translated = translate_batch(wanted, factory, target_lang, style, known, "source", fresh=fresh)
    accepted = F.col("outcome").isin("remembered", "translated")
    judged = translated.withColumn("ok", accepted).withColumn("target", F.when(accepted, F.col("target")))
    untouched = segments.filter(~F.col("translate")).withColumn("target", F.lit(None).cast("string")).withColumn("ok", F.lit(False))
    everything = judged.select(*untouched.columns).unionByName(untouched)
    single = fallback_text_elements(runs, everything)
    return TranslatedDocuments(
        runs=redistribute_segments(everything),
        fallback=translate_batch(single, factory, target_lang, style, known, "text", attempts=attempts, tasks=tasks),
        counts=translated_counts(everything),
        cache=tm_stats(keyed, "doc", known),
        fresh=fresh.filter("outcome = 'translated'").drop("outcome").withColumn("last_used", F.localtimestamp()),
    )
