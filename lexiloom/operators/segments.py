"""Documents as runs and segments: classes, assembly, redistribution, statistics.

A run row has `doc, part, part_kind, para_idx, run_idx, text_idx, text`. Runs
without text and paragraphs without runs are rows too (`text_idx` or `run_idx`
is NULL), so that the counts are right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.text import is_blank, is_number, is_roman, preserve_reason, strip

PARAGRAPH = ["doc", "part", "para_idx"]
KINDS = ("number", "roman", "text")

_LISTS = ["run_idx", "text_idx", "text"]
# Below every INT, so it comes first, as a missing number does.
_NO_NUMBER = -(1 << 31) - 1


def _text_lists() -> list[Column]:
    """Aggregates that gather a paragraph's text elements as lists in step, for `_element`.

    Plain lists take half the room of a list of structs in a shuffle. Rows
    without a text are in none of them.
    """
    number = lambda name: F.when(F.col("text").isNotNull(), F.coalesce(F.col(name).cast("long"), F.lit(_NO_NUMBER)))
    return [F.collect_list(number("run_idx")).alias("run_idx"), F.collect_list(number("text_idx")).alias("text_idx"), F.collect_list("text").alias("text")]


def _element(entry: Column, runs: DataFrame) -> list[Column]:
    """The fields of a text element, from an entry of the zipped lists."""
    numbers = [F.when(entry[n] != _NO_NUMBER, entry[n]).cast(runs.schema[n].dataType).alias(n) for n in _LISTS[:2]]
    return [*numbers, entry["text"].alias("text")]


def classify_segments(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `kind` (blank, number, roman, short or text), and `preserve_reason` for texts kept as they are."""
    t, bare = F.col(text), F.col("_bare")
    short = (F.length(bare) <= fixed.SHORT_TEXT) & ~t.contains(".")
    kind = (
        F.when(bare.isNull() | (bare == ""), "blank")
        .when(is_number(bare), "number")
        .when(is_roman(bare), "roman")
        .when(short, "short")
        .otherwise("text")
    )
    stripped = df.withColumn("_bare", strip(t))
    return stripped.withColumn("kind", kind).withColumn("preserve_reason", preserve_reason(bare)).drop("_bare")


def class_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("kind", "preserve_reason").agg(F.count(F.lit(1)).alias("segments"))


def assemble_segments(runs: DataFrame, keep_runs: bool = True) -> DataFrame:
    """Runs -> one segment per paragraph.

    Blank runs are dropped, number and roman runs stay apart, the others are
    joined in order to `source`. `translate` is false for segments of two
    characters or fewer. `runs` keeps the text elements, so that the translation
    can be given back to them without another join; the group is one paragraph.
    """
    bare = F.col("_bare")
    kind = F.when(is_number(bare), KINDS.index("number")).when(is_roman(bare), KINDS.index("roman")).otherwise(KINDS.index("text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = (
        runs.withColumn("_bare", strip(F.col("text")))
        .filter(bare != "")
        .withColumn("_kind", kind.cast("byte"))
        .groupBy(*PARAGRAPH)
        .agg(*_text_lists(), F.collect_list("_kind").alias("_kind"))
        .withColumn("runs", F.sort_array(F.arrays_zip(*_LISTS, "_kind")))
        .select(*PARAGRAPH, F.transform("runs", lambda r: F.struct(*_element(r, runs), F.get(names, r["_kind"]).alias("kind"))).alias("runs"))
    )
    content = F.filter("runs", lambda r: r["kind"] == "text")
    source = F.array_join(F.transform(content, lambda r: r["text"]), "")
    segments = ordered.withColumn("source", source).withColumn(
        "translate", F.length(strip(F.col("source"))) > fixed.SHORT_TEXT
    )
    return segments if keep_runs else segments.drop("runs")


def redistribute_segments(translated: DataFrame) -> DataFrame:
    """Segments with `target` -> their text elements with `new_text`.

    A segment without a target (NULL: not translated or refused) and number or
    roman elements keep their text. One element takes the whole target. With
    line breaks on both sides, line i goes to element i as far as both have
    lines; what is left over joins the last element used, and elements beyond
    keep their text. Otherwise the first element takes everything and the others
    become empty. All of it happens inside the row: no join and no window.
    """
    content = F.filter("runs", lambda r: r["kind"] == "text")
    by_lines = F.col("source").contains("\n") & F.col("target").contains("\n")
    lines = F.split("target", "\n", -1)
    shared = F.least(F.size(F.split("source", "\n", -1)), F.size(lines), F.col("_n"))
    rest = F.array_join(F.slice("_lines", F.col("_used") + 1, F.greatest(F.size("_lines") - F.col("_used"), F.lit(0))), "\n")
    prepared = (
        translated.withColumn("_content", content)
        .withColumn("_n", F.size("_content"))
        .withColumn("_lines", lines)
        .withColumn("_by_lines", by_lines)
        .withColumn("_used", F.when(F.col("_by_lines"), shared).otherwise(F.lit(0)))
        .withColumn("_rest", F.when(F.col("_used") < F.size("_lines"), rest))
    )

    def placed(run, i):
        own = run["text"]
        line = F.get("_lines", i)
        last = F.when(F.col("_rest").isNull(), line).when(line == "", F.col("_rest")).otherwise(
            F.concat(line, F.lit("\n"), F.col("_rest"))
        )
        return (
            F.when(F.col("target").isNull(), own)
            .when(F.col("_n") == 1, F.col("target"))
            .when(F.col("target") == "", own)
            .when(F.col("_by_lines") & (i < F.col("_used") - 1), line)
            .when(F.col("_by_lines") & (i == F.col("_used") - 1), last)
            .when(F.col("_by_lines"), own)
            .when(i == 0, F.col("target"))
            .otherwise(F.lit(""))
        )

    new_content = F.transform(
        "_content", lambda r, i: F.struct(r["run_idx"], r["text_idx"], r["text"], r["kind"], placed(r, i).alias("new_text"))
    )
    kept = F.transform(
        F.filter("runs", lambda r: r["kind"] != "text"),
        lambda r: F.struct(r["run_idx"], r["text_idx"], r["text"], r["kind"], r["text"].alias("new_text")),
    )
    return prepared.select(*PARAGRAPH, F.explode(F.concat(new_content, kept)).alias("_e")).select(
        *PARAGRAPH,
        F.col("_e.run_idx").alias("run_idx"),
        F.col("_e.text_idx").alias("text_idx"),
        F.col("_e.text").alias("text"),
        F.col("_e.kind").alias("kind"),
        F.col("_e.new_text").alias("new_text"),
    )


def translated_counts(segments: DataFrame, ok: str = "ok") -> DataFrame:
    """Translated segments per part, per document and in all; NULL marks the level above."""
    return segments.rollup("doc", "part").agg(
        F.sum(F.col(ok).cast("int")).alias("translated"), F.count(F.lit(1)).alias("segments")
    )


def fallback_text_elements(runs: DataFrame, translated: DataFrame, ok: str = "ok") -> DataFrame:
    """Single text elements of more than 10 characters, for documents whose main part got no translation."""
    done = translated.filter(ok).select("doc", "part").distinct()
    main = runs.filter(F.col("part_kind") == "document")
    return main.join(done, ["doc", "part"], "left_anti").filter(
        F.length(strip(F.col("text"))) > fixed.FALLBACK_MIN_CHARS
    )


def document_structure(runs: DataFrame) -> DataFrame:
    """Counts per document (main part only) and whether its texts need grouping.

    The paragraph level combines first, so a huge document is only many
    paragraph rows, never one group of runs.
    """
    size = F.length(strip(F.coalesce("text", F.lit(""))))
    single = F.col("text_idx").isNotNull() & (size == 1) & (F.col("run_idx") < 5)
    per_paragraph = (
        runs.filter(F.col("part_kind") == "document")
        .groupBy(*PARAGRAPH)
        .agg(
            F.count("text_idx").alias("texts"),
            # A run with several texts has several rows; its first one counts.
            F.count(F.when(F.col("run_idx").isNotNull() & (F.coalesce("text_idx", F.lit(0)) == 0), 1)).alias("runs"),
            F.sum(F.when(F.col("text_idx").isNotNull(), size).otherwise(0)).alias("chars"),
            F.count(F.when(single, 1)).alias("singles"),
        )
    )
    special = F.col("special_paragraphs") >= 3
    short = (F.col("num_text_elements") > 0) & (F.col("avg_text_length") < 5)
    sparse = (F.col("num_runs") > 0) & (
        F.col("num_text_elements") / F.greatest(F.col("num_runs"), F.lit(1)) < 0.8
    )
    return (
        per_paragraph.groupBy("doc")
        .agg(
            F.count(F.lit(1)).alias("num_paragraphs"),
            F.sum("texts").alias("num_text_elements"),
            F.sum("runs").alias("num_runs"),
            (F.sum("chars") / F.greatest(F.lit(1), F.sum("texts"))).alias("avg_text_length"),
            F.count(F.when((F.col("runs") >= 3) & (F.col("singles") >= 3), 1)).alias("special_paragraphs"),
        )
        .withColumn("needs_text_grouping", special | short | sparse)
    )


def paragraph_texts(runs: DataFrame) -> DataFrame:
    """Text of every paragraph of the main part, runs in order; empty paragraphs have an empty text."""
    texts = F.transform(F.sort_array(F.arrays_zip(*_LISTS)), lambda e: e["text"])
    return (
        runs.filter(F.col("part_kind") == "document")
        .groupBy(*PARAGRAPH)
        .agg(*_text_lists())
        .select(*PARAGRAPH, F.array_join(texts, "").alias("text"))
    )


def paragraph_preview(paragraphs: DataFrame, max_paragraphs: int = 10, offset: int = 0) -> DataFrame:
    """Non-blank paragraphs with their own 1-based number, a page per document, shown up to 100 characters.

    Spark prunes the ranks inside each task before the shuffle, so a document of
    any length sends few rows on.
    """
    order = Window.partitionBy("doc").orderBy("para_idx")
    shown = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    return (
        paragraphs.filter(~is_blank(F.col("text")))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= offset + max_paragraphs)
        .filter(F.col("position") > offset)
        .select("doc", (F.col("para_idx") + 1).alias("number"), "position", shown.alias("preview"))
    )
