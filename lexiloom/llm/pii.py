"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their score.

All of it is column expressions. A pattern is run twice over a text that has a
match: once for the matches, once for what lies between them; the lengths of
both give each match's place in code points. Patterns are written so that a
failed attempt is never started again inside the same run of characters, which
keeps the time in proportion to the text whatever it holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a match, back to the match before it, in which context words count.
CONTEXT = 48
CONTEXT_BONUS = 20
ACCEPTED_SCORE = 60
FOUND = "array<struct<start:bigint,rank:int,end:bigint,score:int,text:string>>"
DIGITS = "[^0-9]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, DIGITS, "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def add(total: Column, place: Column) -> Column:
        value = digits.substr(n - place + 1, F.lit(1)).cast("int") * (F.lit(1) + (place - 1) % 2)
        return total + value - F.when(value > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number's check digits fit: moved to the end, letters as 10 to 35, the rest modulo 97 is 1."""
    turned = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, place: Column) -> Column:
        value = F.ascii(turned.substr(place, F.lit(1)))
        return F.when(value < 58, rest * 10 + value - 48).otherwise(rest * 100 + value - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), add) == 1


def _card(match: Column, before: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _phone(match: Column, before: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _ip(match: Column, before: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(value) <= 3, F.concat(F.lit("0"), value).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(match, "\\."), small)


def _iban(match: Column, before: Column) -> Column:
    code = F.translate(match, " ", "")
    return ~before.rlike("[0-9A-Za-z]$") & mod97(code)


def _ssn(match: Column, before: Column) -> Column:
    return ~before.rlike("[0-9A-Za-z-]$") & ~match.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """`hint` is a string that every text with a match contains, or empty. `base` spans stay whatever their score."""

    name: str
    pattern: str
    hint: str
    confirmed: Callable[[Column, Column], Column]
    score: int
    context: str
    base: bool


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m, b: F.lit(True), 80, "mail|email|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", _ip, 60, "ip|address|server|host", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card, 70, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone, 60, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", "", _iban, 70, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", _ssn, 45, "ssn|social|security", False),
)


def _running(numbers: Column) -> Column:
    """Sums up to each place of an array, in as many passes as its length has binary digits; none of them copies a growing array."""
    passes = F.length(F.bin(F.size(numbers)))
    add = lambda sums, k: F.transform(sums, lambda x, at: x + F.coalesce(F.get(sums, at - F.pow(F.lit(2), k).cast("int")), F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), passes - 1), numbers, add)


def _found(rank: int, kind: Kind, matches: Column, gaps: Column) -> Column:
    """Confirmed matches of one kind with place and score."""

    def judged(item: Column, end: Column) -> Column:
        before = F.right(item["gap"], F.lit(CONTEXT))
        near = F.lower(before).rlike(f"(?:^|[^a-z])(?:{kind.context})(?:[^a-z]|$)")
        score = F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0)
        good = kind.confirmed(item["match"], before)
        if not kind.base:
            good = good & (score >= ACCEPTED_SCORE)
        own = F.struct((end - F.length(item["match"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), score.alias("score"), item["match"].alias("text"))
        return F.when(good, own)

    items = F.arrays_zip(matches.alias("match"), F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"))
    ends = _running(F.transform(items, lambda x: (F.length(x["gap"]) + F.length(x["match"])).cast("long")))
    return F.array_compact(F.zip_with(items, ends, judged)).cast(FOUND)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found): found is an array of (start, rank, end, score, text), by start and then by kind.

    `rank` is the kind's place in KINDS; places are code points, end exclusive.
    A null text counts as empty; a null doc_id stays; each of several equal
    rows gets its own result; other columns are not read; an empty table gives
    no row. Context words are looked for between a match and the one before it.
    """
    no_match = F.array().cast("array<string>")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        matches = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        if kind.hint:
            matches = F.when(F.contains(F.col("text"), F.lit(kind.hint)), matches).otherwise(no_match)
        df = df.withColumn(f"match_{kind.name}", matches)
    for rank, kind in enumerate(KINDS):
        matches = F.col(f"match_{kind.name}")
        gaps = F.split("text", kind.pattern, -1)
        df = df.withColumn(f"found_{kind.name}", F.when(F.size(matches) > 0, _found(rank, kind, matches, gaps)).otherwise(F.array().cast(FOUND)))
    return df.select("doc_id", F.array_sort(F.concat(*(f"found_{kind.name}" for kind in KINDS))).alias("found"))


def span_names(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document: how many spans of each base kind, a hash of the base spans, all spans and their scores."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["rank"].isin([i for i, k in enumerate(KINDS) if k.base]))
    ranks = F.transform(found, lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, rank))).cast("long").alias(f"n_{k.name}") for rank, k in enumerate(KINDS)]
    scores = F.array_join(F.transform(found, lambda s: s["score"].cast("string")), ",")
    return find_pii(docs).select("doc_id", *counts, F.sha2(span_names(base), 256).alias("base_sha256"), span_names(found).alias("spans"), scores.alias("scores"))
