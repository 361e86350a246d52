"""The translation memory: known pairs, what is missing, statistics and retention.

A memory row is `key, target_lang, style, source, target, last_used`; the key is
the MD5 of the source text. The memory outlives a job, so target language and
style belong to its identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import is_blank
from lexiloom.operators.selection import first_rows, numbers_of

IDENTITY = ["key", "target_lang", "style"]


def with_key(segments: DataFrame, target_lang: str, style: str, text: str = "text") -> DataFrame:
    """Adds the identity columns; blank texts get no key and are never looked up."""
    return segments.withColumns(
        {
            "key": F.when(~is_blank(F.col(text)), F.md5(F.col(text).cast("binary"))),
            "target_lang": F.lit(target_lang),
            "style": F.lit(style),
        }
    )


def tm_lookup(keyed: DataFrame, memory: DataFrame) -> DataFrame:
    """Adds `target` and `hit`; an empty remembered target counts as a miss.

    The memory has one row per identity, so the join never multiplies rows. A
    sentence that fills a third of the table lands in one shuffle partition,
    which adaptive execution splits; blank rows have no key and are not sent to
    a single place.
    """
    known = memory.filter(F.col("target") != "").select(*IDENTITY, "target")
    return join_by_identity(keyed, known).withColumn("hit", F.when(F.col("key").isNotNull(), F.col("target").isNotNull()))


def join_by_identity(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """A left join in one pass. Rows without a key match nothing; numbers in its place spread them over the join's tasks."""
    number = (F.monotonically_increasing_id() % 4096).cast("string")
    placed = keyed.withColumn("_place", F.coalesce(F.col("key"), F.concat(F.lit("blank "), number)))
    return placed.join(pairs.withColumnRenamed("key", "_place"), ["_place", *IDENTITY[1:]], "left").drop("_place")


def tm_misses(keyed: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    """Each missing text once: what has to be translated.

    Duplicates go first, inside each task and then per key, so that the join
    with the memory sees every text once and no key is hot.
    """
    wanted = keyed.filter(F.col("key").isNotNull()).select(*IDENTITY, F.col(text).alias("source")).distinct()
    known = memory.filter(F.col("target") != "").select(*IDENTITY)
    return wanted.join(known, IDENTITY, "left_anti")


def tm_stats(keyed: DataFrame, job: str = "job", memory: DataFrame | None = None) -> DataFrame:
    """Hits, misses, lookups, hit rate in percent and resulting size per job.

    A miss is the first lookup of a text in its job that the memory does not
    hold. Lookups combine per (job, key) first, so a repeated sentence is one row.
    """
    per_key = keyed.filter(F.col("key").isNotNull()).groupBy(job, *IDENTITY).agg(F.count(F.lit(1)).alias("_lookups"))
    if memory is None:
        per_key = per_key.withColumn("_known", F.lit(False))
    else:
        known = memory.filter(F.col("target") != "").select(*IDENTITY, F.lit(True).alias("_known"))
        per_key = per_key.join(known, IDENTITY, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    total, missed = F.sum("_lookups"), F.sum(F.when(F.col("_known"), 0).otherwise(1))
    return per_key.groupBy(job).agg(
        (total - missed).alias("hits"),
        missed.alias("misses"),
        total.alias("total_requests"),
        ((total - missed) / total * 100).alias("hit_rate"),
        F.count(F.lit(1)).alias("cache_size"),
    )


def tm_retain(memory: DataFrame, max_size: int = 2000) -> DataFrame:
    """The `max_size` most recently used entries; equal times keep the smaller key.

    Counts tell which entries stay for sure; only those next to the bound are
    sorted, so no task has to hold all that stay, or all of one moment.
    """
    order = [F.col("last_used").desc(), *(F.col(c) for c in IDENTITY)]
    numbers = [*numbers_of(memory, "last_used", descending=True), *(n for c in IDENTITY for n in numbers_of(memory, c))]
    return first_rows(memory, numbers, order, max_size)


def tm_merge(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next version of the memory: per identity the newest pair wins; at equal times a fresh one, then the larger target.

    Old and new pairs meet in one aggregate.
    """
    columns = [*IDENTITY, "source", "target", "last_used"]
    both = memory.select(*columns, F.lit(0).alias("_new")).unionByName(fresh.select(*columns, F.lit(1).alias("_new")))
    best = F.max_by(F.struct("source", "target", "last_used"), F.struct("last_used", "_new", "target"))
    return both.groupBy(*IDENTITY).agg(best.alias("_v")).select(*IDENTITY, "_v.*")


def touch(memory: DataFrame, lookups: DataFrame) -> DataFrame:
    """`last_used` moved forward to the newest lookup of each entry."""
    used = lookups.filter(F.col("key").isNotNull()).groupBy(*IDENTITY).agg(F.max("used_at").alias("_used"))
    return (
        memory.join(used, IDENTITY, "left")
        .withColumn("last_used", F.greatest("last_used", "_used"))
        .drop("_used")
    )
