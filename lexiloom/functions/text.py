"""Column expressions for text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode blanks included."""
    return F.btrim(text, F.lit(fixed.SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


# The next three take a text that is stripped already, so that operators can
# strip once and ask several questions.
def is_number(bare: Column) -> Column:
    """Anything a decimal parser takes, with a comma as decimal point too, or four and more digits.

    A pattern, not a cast: casts take type suffixes and refuse grouping underscores.
    Most words fail on their first character already, which is far cheaper to
    look at than to run a pattern: digits, signs and points sort up to "9",
    other scripts sort behind "~", and the rest can only be inf or nan.
    """
    first = F.substring(bare, 1, 1)
    possible = (first <= "9") | (first > "~") | first.isin("i", "I", "n", "N")
    return possible & (bare.rlike(fixed.NUMBER) | bare.rlike(fixed.LONG_DIGITS))


def is_roman(bare: Column) -> Column:
    first, longest = F.substring(bare, 1, 1), len("mmmmdccclxxxviii")
    possible = first.isin(*"ivxlcdmIVXLCDM") & (F.length(bare) <= longest)
    return possible & F.lower(bare).rlike(fixed.ROMAN)


def preserve_reason(bare: Column) -> Column:
    """Why a text is kept as it is, NULL when it is not."""
    reason = F.when(bare.isNull() | (bare == ""), "blank")
    for name, pattern in fixed.PRESERVE.items():
        reason = reason.when(bare.rlike(pattern), name)
    return reason.when(
        bare.rlike(fixed.PROPER_NAME_OPENS) & ~bare.rlike(fixed.PROPER_NAME_BREAKS), "proper_name"
    ).when((F.length(bare) <= fixed.SHORT_TEXT) & ~bare.rlike(r"^\p{L}+$"), "short_symbol")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(n) for n in needles])


def masked(parts: Column, prefix: str, suffix: str, offset: Column) -> Column:
    """The pieces around the matches, glued with numbered placeholders from `offset` on."""
    glued = F.transform(
        parts,
        lambda part, i: F.when(i == 0, part).otherwise(
            F.concat(F.lit(prefix), (offset + i - 1).cast("string"), F.lit(suffix), part)
        ),
    )
    return F.array_join(glued, "")


def unmasked(text: Column, spans: Column) -> Column:
    """Placeholders replaced by their originals, the highest number first.

    A late span can hold an earlier placeholder, so restoring in rising order
    would leave that one in the text.
    """
    return F.aggregate(F.reverse(spans), text, lambda t, s: F.replace(t, s["placeholder"], s["original"]))


def spaced(text: Column, prefixes: bool = False) -> Column:
    """Blanks where words stick together; runs of white space become one blank."""
    steps = [(f"({left})({right})", "$1 $2") for left, right in fixed.SPACED_BORDERS]
    if prefixes:
        steps += [(rf"(?i)({prefix})([a-z]{{2,}})", "$1 $2") for prefix in fixed.SPACED_PREFIXES]
    steps.append((rf"[{fixed.SPACE}]+", " "))
    return reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)


def without_phrases(text: Column) -> Column:
    """Unwanted phrases removed one after the other; each removal also strips.

    A fold over the phrases: nested conditions would repeat the text three times
    per phrase and grow without end.
    """
    phrases = F.array(*[F.lit(p) for p in fixed.REMOVED_PHRASES])
    return F.aggregate(
        phrases, text, lambda t, phrase: F.when(F.contains(t, phrase), strip(F.replace(t, phrase, F.lit("")))).otherwise(t)
    )


def ocr_is_empty(text: Column) -> Column:
    """The reader answered that there is nothing to read."""
    bare = strip(text)
    return (
        (F.upper(bare) == fixed.OCR_EMPTY)
        | contains_any(F.lower(bare), fixed.OCR_NO_TEXT)
        | reduce(Column.__or__, [bare.startswith(opening) for opening in fixed.OCR_OPENINGS])
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 by the clock on the value, whatever the session's zone."""
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
        + (F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60) * 1_000_000
        + (seconds * 1_000_000).cast("long")
    )


def iso_text(ts: Column) -> Column:
    """ISO text; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(full.endswith(".000000"), whole).otherwise(full)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; hours grow beyond two digits."""
    whole = F.floor(seconds).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(whole / 3600).cast("long")
    shown = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60))
