"""Text columns of whole tables: masking, spacing, guards, requests and replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.text import contains_any, masked, ocr_is_empty, spaced, strip, unmasked, without_phrases


# --- protected spans ---------------------------------------------------------
def _mask(df: DataFrame, text: str, steps: Sequence[tuple[str, str, str]], out: str, spans: str) -> DataFrame:
    """Each pattern runs over the text as the patterns before it left it; numbers run on."""
    no_spans = F.array().cast("array<struct<placeholder: string, original: string>>")
    result = df.withColumn(out, F.col(text)).withColumn(spans, no_spans)
    for prefix, suffix, pattern in steps:
        matches = F.regexp_extract_all(out, F.lit(pattern), F.lit(0))
        result = result.withColumn("_found", matches).withColumn("_offset", F.size(spans))
        placeholders = F.transform(
            "_found",
            lambda original, i: F.struct(
                F.concat(F.lit(prefix), (F.col("_offset") + i).cast("string"), F.lit(suffix)).alias("placeholder"),
                original.alias("original"),
            ),
        )
        result = result.withColumns(
            {
                spans: F.concat(spans, placeholders),
                out: F.when(F.size("_found") == 0, F.col(out)).otherwise(
                    masked(F.split(out, pattern, -1), prefix, suffix, F.col("_offset"))
                ),
            }
        ).drop("_found", "_offset")
    return result


def mask_links(
    df: DataFrame, text: str = "text", out: str = "masked", spans: str = "spans", kinds=fixed.LINK_KINDS
) -> DataFrame:
    """URLs, then e-mail addresses, then domains become `___KIND_n___`; `spans` remembers them in order."""
    return _mask(df, text, [(f"___{name}_", "___", pattern) for name, pattern in kinds], out, spans)


def mask_formats(df: DataFrame, text: str = "text", out: str = "masked", spans: str = "spans") -> DataFrame:
    """Links, paths and identifiers become `__PROTECTED_n__`."""
    return _mask(df, text, [("__PROTECTED_", "__", pattern) for pattern in fixed.FORMAT_PATTERNS], out, spans)


def unmask(df: DataFrame, text: str = "masked", spans: str = "spans", out: str = "restored") -> DataFrame:
    """Puts the originals back."""
    return df.withColumn(out, unmasked(F.col(text), F.col(spans)))


def span_table(df: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """One row per protected span."""
    return df.select(*keys, F.posexplode(spans).alias("span", "_s")).select(*keys, "span", "_s.*")


def repair_spacing(df: DataFrame, text: str = "text", out: str = "repaired", prefixes: bool = False) -> DataFrame:
    """Blanks at lower-to-upper, letter-digit and letter-symbol borders; white space collapsed and stripped."""
    return df.withColumn(out, strip(spaced(F.col(text), prefixes)))


# --- model answers -----------------------------------------------------------
def guard_responses(
    df: DataFrame, kind: str = "document", source: str = "source", output: str = "output"
) -> DataFrame:
    """Adds `guarded` and `guard_outcome` (accepted, reverted, cleaned or emptied).

    document  an apology or a question instead of a translation: keep the source
    api       the service saw no text: keep the source
    cleanup   unwanted phrases are taken out
    ocr       the reader saw no text: empty
    """
    given = F.col(output)
    if kind in ("document", "api"):
        markers = fixed.REVERT_MARKERS if kind == "document" else fixed.NO_TEXT_MARKERS
        bad = given.isNull() | contains_any(given, markers)
        value, outcome = F.when(bad, F.col(source)).otherwise(given), F.when(bad, "reverted")
    elif kind == "cleanup":
        value = without_phrases(given)
        outcome = F.when(contains_any(given, fixed.REMOVED_PHRASES), "cleaned")
    elif kind == "ocr":
        bad = given.isNull() | ocr_is_empty(given)
        value, outcome = F.when(bad, F.lit("")).otherwise(strip(given)), F.when(bad, "emptied")
    else:
        raise ValueError(f"unknown kind of answers: {kind}")
    return df.withColumn("guarded", value).withColumn("guard_outcome", outcome.otherwise("accepted"))


def guard_summary(guarded: DataFrame) -> DataFrame:
    return guarded.groupBy("guard_outcome").agg(F.count(F.lit(1)).alias("answers"))


# --- requests and replies ----------------------------------------------------
REQUEST_FIELDS = (
    "source_lang", "target_lang", "style", "body", "input_path", "output_path",
    "model", "temperature", "workers", "status_file", "language",
)


def parse_requests(df: DataFrame, question: str = "question") -> DataFrame:
    """`VERB|a|b|...` -> columns; `reject_reason` is set for rows that do not parse.

    TRANSLATE is cut four times, ANALYZE and EXTRACT once: what follows keeps
    its bars. TRANSLATE_DOCX and TRANSCRIBE are cut everywhere.
    """
    q = F.col(question)
    verb = F.get(F.split(q, r"\|", -1), F.lit(0))
    parts = F.split(q, r"\|", -1)
    few, two = F.split(q, r"\|", 5), F.split(q, r"\|", 2)
    at = lambda array, i: F.get(array, F.lit(i))
    is_translate, is_docx = verb == "TRANSLATE", verb == "TRANSLATE_DOCX"
    is_single, is_audio = verb.isin("ANALYZE", "EXTRACT"), verb == "TRANSCRIBE"
    enough = (
        F.when(is_translate, F.size(few) == 5)
        .when(is_docx, F.size(parts) >= 4)
        .when(is_single, F.size(two) == 2)
        .when(is_audio, F.size(parts) >= 2)
    )
    temperature = F.coalesce(at(parts, 5), F.lit(str(fixed.DOCX_DEFAULTS["temperature"]))).try_cast("double")
    workers = F.coalesce(at(parts, 6), F.lit(str(fixed.DOCX_DEFAULTS["workers"]))).try_cast("int")
    bad_number = is_docx & (temperature.isNull() | workers.isNull())
    reason = (
        F.when(enough.isNull(), "unknown_verb").when(~enough, "too_few_fields").when(bad_number, "bad_number")
    )
    good = reason.isNull()
    docx_default = lambda i, name: F.coalesce(at(parts, i), F.lit(fixed.DOCX_DEFAULTS[name]))
    fields = {
        "source_lang": F.when(is_translate, at(few, 1)),
        "target_lang": F.when(is_translate, at(few, 2)).when(is_docx, at(parts, 3)),
        "style": F.when(is_translate, at(few, 3)).when(is_docx, docx_default(8, "style")),
        "body": F.when(is_translate, at(few, 4)).when(is_single, at(two, 1)),
        "input_path": F.when(is_docx | is_audio, at(parts, 1)),
        "output_path": F.when(is_docx, at(parts, 2)),
        "model": F.when(is_docx, docx_default(4, "model")),
        "temperature": F.when(is_docx, temperature),
        "workers": F.when(is_docx, workers),
        "status_file": F.when(is_docx, at(parts, 7)),
        "language": F.when(is_audio & (at(parts, 2) != ""), at(parts, 2)),
    }
    return df.withColumns(
        {"verb": verb, "reject_reason": reason, **{name: F.when(good, value) for name, value in fields.items()}}
    )


_FRAGMENTS = "language ARRAY<STRUCT<name: STRING, code: STRING, text: STRING>>, _bad STRING"


def language_fragments(df: DataFrame, reply: str = "reply") -> DataFrame:
    """JSON reply -> one row per fragment with defaults; an unreadable reply gives one error row."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = df.withColumn("_json", F.from_json(reply, _FRAGMENTS, options))
    unreadable = F.col("_json").isNull() | F.col("_json._bad").isNotNull() | ~strip(F.col(reply)).startswith("{")
    fixed_row = lambda values: F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
    fragments = F.when(unreadable, F.array(fixed_row(fixed.FRAGMENT_ERROR))).otherwise(
        F.transform(
            F.coalesce("_json.language", F.array().cast("array<struct<name: string, code: string, text: string>>")),
            lambda f: F.struct(
                *[F.coalesce(f[k], F.lit(v)).alias(k) for k, v in fixed.FRAGMENT_DEFAULTS.items()]
            ),
        )
    )
    keys = [c for c in df.columns if c != reply]
    return parsed.select(*keys, F.posexplode(fragments).alias("pos", "_f")).select(*keys, "pos", "_f.*")


def language_shares(fragments: DataFrame) -> DataFrame:
    """Characters and fragments per language."""
    return fragments.groupBy("code", "name").agg(
        F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("fragments")
    )
