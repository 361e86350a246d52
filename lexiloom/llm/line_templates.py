"""Line deduplication with a log-template tree.

Words with a digit are variable from the start. A tree of fixed depth then deals
lines out by their number of words and their first `LEAD` words. In a leaf, a
word that stands at its place in enough lines is part of a template, any other
one is a variable field. A template recurs if lines of enough different
documents fall under it; its lines are dropped everywhere but in the document
with the smallest id. Everything is joins and sums, and each sum starts on the
side of the scan, so a line that stands in a third of all documents is no
heavier than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Leading words that the tree branches on; documents in which a template recurs; words of the shortest line that can be a template with fields;
#: share of a template's words, in percent, that are no variable fields.
LEAD, LEAST_DOCUMENTS, LEAST_WORDS, LEAST_CONSTANT = 4, 10, 4, 60
VARIABLE = "<*>"
#: White space that parts words besides the space.
BLANKS = "\t\x0b\x0c\r\x85\xa0\u2002\u2003\u2009\u202f\u3000"
WITH_DIGIT = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def _lines(docs: DataFrame, every_line: bool) -> DataFrame:
    """(doc_id, text_hash, pos, line, leaf): lines with words that hold a digit masked, long enough to be looked at.

    With `every_line`, any white space parts words, and of a line of fewer than
    `LEAST_WORDS` words only the digits are masked; with a letter left it is a
    leaf of its own.
    """
    text = F.col("text")
    if every_line:  # few texts have other blanks than spaces, and looking for them is far cheaper than replacing them
        text = F.when(text.rlike(f"[{BLANKS}]"), F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)
    lines = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    lines = lines.withColumn("n_words", spaces + 1)
    short = F.col("n_words") < LEAST_WORDS
    masked = F.when(~F.col("line").rlike("[0-9]"), F.col("line")).when(short, F.regexp_replace("line", "[0-9]++", VARIABLE)).otherwise(F.regexp_replace("line", WITH_DIGIT, VARIABLE))
    looked_at = ~short | F.col("line").rlike(r"\p{L}") if every_line else ~short
    masked_lines = lines.where(looked_at).select("doc_id", "text_hash", "pos", masked.alias("line"), "n_words")
    return masked_lines.select("doc_id", "text_hash", "pos", "line", F.xxhash64("n_words", F.substring_index("line", " ", LEAD)).alias("leaf"))


def recurring_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, every_line: bool = False) -> DataFrame:
    """(line_hash, keeper): masked lines under a recurring template, and the smallest doc_id that has one of its lines.

    Documents with one and the same text count once, so a group of exact copies makes nothing recur.
    """
    lines = _lines(docs, every_line)
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents).select("leaf")
    # a row per leaf, line and text: what recurs is far less than what is read
    candidates = stored(
        lines.join(leaves, "leaf")
        .groupBy("leaf", F.xxhash64("line").alias("line_hash"), "text_hash")
        .agg(F.min("doc_id").alias("first"), F.min("line").alias("line")),
        "lines",
    )
    distinct = candidates.groupBy("leaf", "line_hash").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    places = distinct.select("leaf", "line_hash", "n", F.posexplode(F.split("line", " ", -1)).alias("place", "word"))
    places = places.select("leaf", "line_hash", "n", F.xxhash64("place", "word").alias("word"), (F.col("word") != VARIABLE).alias("plain"))
    constants = places.groupBy("leaf", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_documents).select("leaf", "word")
    n_words = F.size(F.split("line", " ", -1))
    templates = (
        places.join(constants, ["leaf", "word"])
        .groupBy("leaf", "line_hash")
        .agg(F.bit_xor("word").alias("template"), F.count_if("plain").alias("n_constant"))
        .join(distinct.select("leaf", "line_hash", n_words.alias("n_words")), ["leaf", "line_hash"])
        .where((F.col("n_constant") * 100 >= F.col("n_words") * LEAST_CONSTANT) | (F.col("n_words") < LEAST_WORDS))
        .select("leaf", "line_hash", "template")
    )
    under = candidates.select("leaf", "line_hash", "text_hash", "first").join(templates, ["leaf", "line_hash"])
    recurring = (
        under.groupBy("leaf", "template", "text_hash").agg(F.min("first").alias("first"))
        .groupBy("leaf", "template").agg(F.count("*").alias("n"), F.min("first").alias("keeper"))
        .where(F.col("n") >= least_documents)
    )
    return templates.join(recurring, ["leaf", "template"]).select("line_hash", "keeper")


def drop_recurring_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, counts: tuple[str, str] = ("n_lines", "n_dropped"), every_line: bool = False) -> DataFrame:
    """`docs` with `text` without the dropped lines, and the numbers of lines and of dropped lines added under the names `counts`.

    A null text stays null with no lines; an empty one has one line; a null
    doc_id never keeps a recurring line unless all its documents have null ids;
    rows with the same id and text get the same result; other columns stay,
    but those named like `counts` are replaced; an empty table gives no row.
    Words are what single spaces part, and lines of fewer than `LEAST_WORDS`
    words stay. With `every_line`, which the query and the pipeline set, all
    white space parts words, and a shorter line with a letter recurs if the
    whole line does, its digits aside.
    """
    found = stored(recurring_lines(docs.select("doc_id", "text"), least_documents, every_line), "templates")
    own, ids, hashes, gone = fresh(docs, "own_hash", "dropped_id", "dropped_hash", "dropped_lines")
    dropped = (
        _lines(docs.select("doc_id", "text"), every_line)
        .select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("line_hash"))
        .join(found, "line_hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias(ids), F.col("text_hash").alias(hashes))
        .agg(F.collect_set("pos").alias(gone))
    )
    rows = docs.withColumn(own, F.xxhash64("text"))
    joined = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col(own) == F.col(hashes)), "left")
    every = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(every, lambda line, pos: ~F.array_contains(F.col(gone), pos)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in counts),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).cast("long").alias(counts[0]),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(counts[1]),
    )
