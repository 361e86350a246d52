"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders. Every window of `WINDOW`
words of a document meets the benchmark's windows by hash; windows of one item
that match at one offset make an alignment. An alignment with enough windows
counts if its slots are consistent: wherever the item has one value twice, the
document has one value twice as well, the same or another. So a question with
its numbers or names exchanged is caught as surely as a verbatim one. Items
without enough windows of plain words (dense in numbers, names or units, or
short) are looked for as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Words of a window, plain words it needs, and windows of an alignment (or all of a shorter item's).
WINDOW, LEAST_PLAIN, LEAST_WINDOWS = 8, 5, 6
#: Plain words from which an item of at least a window that is looked for as a whole may have other values.
LEAST_PLAIN_WHOLE = 3
#: Benchmark windows up to which they are broadcast (24 bytes each); more are joined by shuffling.
BROADCAST_WINDOWS = 500_000
NUMBER, NAME, UNIT = "<n>", "<name>", "<u>"
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g gram grams kg kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres dollar dollars cent cents euro euros percent degree degrees mph kmh hz w kw v"
).split()
BLANK = "[\\x20\\x09-\\x0D]"


def _words(text: Column) -> Column:
    return F.split(text, BLANK, -1)


def _canonical(text: Column) -> Column:
    """The text with placeholders, in small letters and without marks; its blanks are where they were."""
    text = F.when(text.rlike("\\p{Lu}"), F.regexp_replace(text, rf"(?<=[^\x20\x09-\x0D.!?:]{BLANK})\p{{Lu}}[\p{{L}}'-]*+", NAME)).otherwise(text)
    text = F.when(text.rlike("[0-9]"), F.regexp_replace(text, "[0-9]++(?:[.,:/][0-9]++)*+", NUMBER)).otherwise(text)
    text = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}<>\x20\x09-\x0D]++", "")
    return F.regexp_replace(text, rf"(?<![^\x20\x09-\x0D])(?:{'|'.join(UNITS)})(?![^\x20\x09-\x0D])", UNIT)


def _canonical_words(text: Column) -> Column:
    return F.filter(_words(_canonical(text)), lambda w: w != "")


def _hashes(words: Column, length: Column) -> Column:
    """A hash for each window of `length` words."""
    count = F.size(words) - length + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, length)))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_pos, window, length, n_windows, asked, whole, loose) of the benchmark's items.

    An item with too few windows of enough plain words is looked for as a
    `whole`: all its windows count, and a document needs all of them; under
    `WINDOW` words it is one window of its own length. As the first word of an
    item is a name to a document that goes on before it, the first window of a
    whole item has that form as well. `loose` items may have other values.
    """
    text = F.col("text")
    inner = F.slice(_canonical_words(F.concat(F.lit("x "), text)), 2, 1 << 30)
    items = benchmark.where("text IS NOT NULL").select("item_id", _canonical_words(text).alias("words"), inner.alias("inner")).where("size(words) > 0")
    items = items.withColumn("length", F.least(F.lit(WINDOW), F.size("words"))).withColumn("n_windows", F.size("words") - F.col("length") + 1)

    def plain(words: Column) -> Column:
        return F.size(F.filter(words, lambda w: ~w.contains("<")))

    fit = F.transform(F.sequence(F.lit(1), F.col("n_windows")), lambda i: plain(F.slice("words", i, F.col("length"))) >= LEAST_PLAIN)
    asked = F.least(F.lit(LEAST_WINDOWS), F.col("n_windows"))
    short = F.size("words") < WINDOW
    items = items.withColumn("fit", fit).withColumn("whole", short | (F.size(F.filter("fit", lambda x: x)) < asked))
    first = F.when(F.col("whole") & (F.col("inner") != F.col("words")), F.array(F.xxhash64(F.slice("inner", F.lit(1), F.col("length")))))
    windows = F.concat(_hashes(F.col("words"), F.col("length")), F.coalesce(first, F.array().cast("array<bigint>")))
    loose = ~F.col("whole") | (plain(F.col("words")) >= F.when(short, LEAST_PLAIN).otherwise(LEAST_PLAIN_WHOLE))
    items = items.select("item_id", "length", "n_windows", "fit", F.when(F.col("whole"), F.col("n_windows")).otherwise(asked).alias("asked"), "whole", loose.alias("loose"), F.posexplode(windows).alias("pos", "window"))
    return items.where(F.col("whole") | F.get("fit", F.col("pos"))).select(
        "item_id", F.when(F.col("pos") < F.col("n_windows"), F.col("pos")).otherwise(0).alias("item_pos"), "window", "length", "n_windows", "asked", "whole", "loose"
    )


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, places) of items that a document has enough windows of.

    `places` has (offset, first, last, n_matched, n_windows, length, whole, loose) for each offset with enough of them.
    """
    items = stored(_item_windows(benchmark.select("item_id", "text")), "items")
    lengths = [r.length for r in items.select("length").distinct().collect()]
    if items.count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    own = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), _canonical_words(F.col("text")).alias("words"))
    # one row per place for all lengths; the hash of a window tells its length
    by_length = [_hashes(F.col("words"), F.lit(n)) for n in sorted(lengths, reverse=True) or [WINDOW]]
    if len(by_length) == 1:
        windows = own.select("doc_id", "text_hash", F.posexplode(by_length[0]).alias("pos", "window"))
    else:
        placed = F.concat(*(F.transform(h, lambda x, i: F.struct(i.alias("pos"), x.alias("window"))) for h in by_length))
        windows = own.select("doc_id", "text_hash", F.inline(placed))
    hits = windows.join(items, "window")
    enough = (
        hits.groupBy("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset"))
        .agg(
            F.min("item_pos").alias("first"), F.max("item_pos").alias("last"), F.countDistinct("item_pos").alias("n_matched"), F.max("n_windows").alias("n_windows"),
            F.max("length").alias("length"), F.max("asked").alias("asked"), F.bool_and("whole").alias("whole"), F.bool_and("loose").alias("loose"),
        )
        .where(F.col("n_matched") >= F.col("asked"))
    )
    place = F.struct("offset", "first", "last", "n_matched", "n_windows", "length", "whole", "loose")
    return enough.groupBy("doc_id", "text_hash", "item_id").agg(F.collect_list(place).alias("places"))


def _parsed(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, words): each word as (canonical, plain form) where the canonical form isn't empty."""
    small = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}<>.,:/\x20\x09-\x0D-]++", "")
    both = F.arrays_zip(_words(_canonical(F.col("text"))).alias("canonical"), _words(small).alias("word"))
    trimmed = F.transform(both, lambda w: F.struct(w["canonical"].alias("canonical"), F.regexp_replace(w["word"], "^[.,:/-]++|[.,:/-]++$", "").alias("word")))
    return table.select(*keys, F.filter(trimmed, lambda w: w["canonical"] != "").alias("words"))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_windows, verbatim): an item's best consistent alignment in a document.

    `verbatim` says whether all slots have the item's own values. Items looked
    for as a whole that have next to no plain words are found verbatim only.
    Null texts and texts without a word match nothing, nor do such items; an
    item of under `WINDOW` words has one window, itself; null ids stay; documents with the same id and text give one row per item; other
    columns are not read; an empty table on either side gives no row.
    """
    found = stored(alignments(docs, benchmark), "alignments")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    wanted = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    texts = own.join(wanted, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = _parsed(texts.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "text"), "__id", "__hash")
    texts = texts.withColumnRenamed("words", "doc_words")
    parts = _parsed(benchmark.select("item_id", "text").where("text IS NOT NULL"), "item_id").withColumnRenamed("words", "item_words")
    aligned = found.join(parts.withColumnRenamed("item_id", "__item"), F.col("item_id").eqNullSafe(F.col("__item"))).join(texts, same)

    def slot(place: Column, offset: Column) -> Column:
        mine, theirs = F.get("item_words", place), F.get("doc_words", place + offset)
        return F.struct((mine["canonical"] == theirs["canonical"]).alias("same"), mine["canonical"].alias("kind"), mine["word"].alias("item"), theirs["word"].alias("doc"))

    def compared(p: Column) -> Column:
        spanned = F.transform(F.sequence(p["first"], p["last"] + p["length"] - 1), lambda place: slot(place, p["offset"]))
        # the first word of a whole item can be a name on one side only
        holds = ~p["whole"] | F.forall(spanned, lambda s: s["same"] | (s["item"] == s["doc"]))
        slots = F.array_distinct(F.filter(spanned, lambda s: s["same"] & s["kind"].contains("<")))
        return F.struct(p["n_matched"].alias("n_matched"), p["n_windows"].alias("n_windows"), p["loose"].alias("loose"), holds.alias("holds"), slots.alias("slots"))

    checked = aligned.select("doc_id", "text_hash", "item_id", F.explode(F.transform("places", compared)).alias("place")).select("doc_id", "text_hash", "item_id", "place.*")
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), s["item"].alias("item"))))
    checked = checked.where(F.col("holds") & (F.size(values) == F.size("slots"))).withColumn("verbatim", F.forall("slots", lambda s: s["item"] == s["doc"]))
    return checked.where("loose OR verbatim").groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n_matched").alias("n_matched"), F.max("n_windows").cast("long").alias("n_windows"), F.bool_or("verbatim").alias("verbatim")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a benchmark item. Rows with a null id are judged by their text alone."""
    ids, hashes = fresh(docs, "found_id", "found_hash")
    found = find_contamination(docs, benchmark).select(F.col("doc_id").alias(ids), F.col("text_hash").alias(hashes)).distinct()
    own = F.col("doc_id").eqNullSafe(F.col(ids)) & (F.xxhash64("text") == F.col(hashes))
    return docs.join(stored(found, "contaminated"), own, "left_anti")
