"""Text columns against plain Python on hand-made and generated texts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.operators import segments, textwork

AWKWARD = [
    "", " ", "  two  words ", "see http://a.b/c?d=e#f, and https://x.org", "mail me@x.org or you@y.co.uk!",
    "v1.2 and 3.14 and www.site.com.", "a.b-cé", "http://a.b@c.com tail", "C:\\tmp\\x.txt and /usr/lib/x",
    "12AB-x é12ab-x AB12CD-EF", "___URL_0___ kept", "x@y.zz http://q.r/s x@y.zz", "đường dẫn http://ví.dụ/ở?x=1 ở đây",
    "helloWorld and abc123def", "ends. here,now (yes)no", "postgame PREview interstate distrust", "tab\tand\u00a0blank\u3000wide",
    "www.a b www.c.de/f", "1.2.3.4", "-a.b- c.d-", "_x.y_ x.y_z", "e@f", "https://", "%41http://%41%42/x",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(AWKWARD)), "id int, text string")


def python_mask(text, steps):
    spans = []
    for before, after, pattern in steps:
        def take(match):
            spans.append((f"{before}{len(spans)}{after}", match.group(0)))
            return spans[-1][0]

        text = re.sub(pattern, take, text)
    return text, spans


# The patterns of the spans, as Python writes them.
LINKS = [
    ("___URL_", "___", r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+(?:/[-\w%!$&'()*+,;=:@/~]*)?(?:\?[-\w%!$&'()*+,;=:@/~]*)?(?:#[-\w%!$&'()*+,;=:@/~]*)?"),
    ("___EMAIL_", "___", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("___DOMAIN_", "___", r"(?<!\w)(?:www\.)?[a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z0-9][-a-zA-Z0-9]*)+(?!\w)"),
]
FORMATS = [
    ("__PROTECTED_", "__", p)
    for p in (
        r"https?://[^\s]+", r"www\.[^\s]+\.[a-zA-Z]{2,}[^\s]*", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        r"[a-zA-Z]:\\[^\s]+", r"/[a-zA-Z0-9_/.-]+", r"\b\d+[A-Za-z]+-[A-Za-z0-9]+\b", r"___[A-Z]+_\d+___",
        r"\b[A-Z]+\d+[A-Z]+-[A-Z]+\b",
    )
]


@pytest.mark.parametrize("mask,steps", [(textwork.mask_links, LINKS), (textwork.mask_formats, FORMATS)])
def test_masks_equal_python(texts, mask, steps):
    for row in textwork.unmask(mask(texts)).collect():
        text, spans = python_mask(row["text"], steps)
        assert (row["masked"], [tuple(s) for s in row["spans"]]) == (text, spans), row["text"]
        assert row["restored"] == row["text"]


def test_masks_of_the_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("text"))
    for mask, steps in ((textwork.mask_links, LINKS), (textwork.mask_formats, FORMATS)):
        for row in mask(pages).collect():
            assert (row["masked"], [tuple(s) for s in row["spans"]]) == python_mask(row["text"], steps)


def test_span_table(texts):
    spans = textwork.span_table(textwork.mask_links(texts), ["id"]).filter("id = 11").orderBy("span").collect()
    assert [(r["placeholder"], r["original"]) for r in spans] == [
        ("___URL_0___", "http://q.r/s"), ("___EMAIL_1___", "x@y.zz"), ("___EMAIL_2___", "x@y.zz")
    ]


# The borders that get a blank.
BORDERS = ["([a-z])([A-Z])", r"([a-zA-Z]{2})(\d)", r"(\d)([a-zA-Z]{2})", r"([a-zA-Z])([^\w\s])", r"([^\w\s])([a-zA-Z])"]


def python_spacing(text, prefixes):
    """Walks over the border patterns, then joins the words again."""
    borders = BORDERS + [f"(?i:({p}))((?i:[a-z]){{2,}})" for p in fixed.SPACED_PREFIXES if prefixes]
    for border in borders:
        text = re.sub(border, lambda m: m.group(1) + " " + m.group(2), text)
    return " ".join(text.split())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abzAZ019 .,;-_/@:%éởß\t\n\u00a0\u3000(){}", max_size=60), min_size=40, max_size=60))
def test_generated_texts(spark, generated):
    df = spark.createDataFrame(list(enumerate(generated)), "id int, text string")
    result = textwork.mask_formats(textwork.mask_links(df), "text", "formats", "format_spans")
    result = textwork.repair_spacing(textwork.repair_spacing(result, "text", "spaced"), "text", "split", prefixes=True)
    for row in result.collect():
        assert row["masked"] == python_mask(row["text"], LINKS)[0]
        assert row["formats"] == python_mask(row["text"], FORMATS)[0]
        assert row["spaced"] == python_spacing(row["text"], False)
        assert row["split"] == python_spacing(row["text"], True)


def parses(text):
    try:
        return isinstance(float(text), float)
    except ValueError:
        return False


def python_kind(text):
    bare = text.strip()
    if not bare:
        return "blank"
    if parses(bare.replace(",", ".")) or (len(bare) >= 4 and bare.isdigit()):
        return "number"
    low = bare.lower()
    if re.fullmatch(r"(?=[ivxlcdm])m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", low):
        return "roman"
    return "short" if len(bare) <= 2 and "." not in text else "text"


NUMBERS = [
    "1", " 12 ", "1,5", "1.5e3", "-3", "+.5", "5.", "1_000", "1__0", "_1", "1d", "0x10", "nan", "-inf", "Infinity", "infinite",
    "1,000,000", "²³²³", "²³", "١٢", "iv", "XIV", "iiii", "mix", "m", "a", "ab", "a.", ".", "-", "e5", "1e", "1e5", "é", "Ab 12",
    "\u00a012\u00a0", "\u3000", "1 2", "", "vi.", "IIX",
]


def test_kinds_equal_python(spark):
    df = spark.createDataFrame(list(enumerate(NUMBERS + AWKWARD)), "id int, text string")
    got = {r["text"]: r["kind"] for r in segments.classify_segments(df).collect()}
    assert got == {t: python_kind(t) for t in NUMBERS + AWKWARD}


def test_preserve_reasons(spark):
    cases = {
        "12 apples": "number_prefix", "xiv": "roman", "A12": "code", "New York": "proper_name", "New  York": None,
        "New York city": None, "?!": "short_symbol", "ab": None, " ": "blank", "A": "proper_name", "hello": None,
        "01/02/2024": "number_prefix", "Énorme": None,
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for row in segments.classify_segments(df).collect():
        assert row["preserve_reason"] == row["want"], row["text"]


def test_guards(spark):
    cases = [
        ("document", "src", "I'm sorry, no", "src", "reverted"), ("document", "src", "fine", "fine", "accepted"),
        ("document", "src", None, "src", "reverted"), ("api", "src", "No content to translate.", "src", "reverted"),
        ("cleanup", "src", "Translation: Sorry, x", ", x", "cleaned"), ("cleanup", "src", " x ", " x ", "accepted"),
        ("ocr", "src", " empty ", "", "emptied"), ("ocr", "src", "There is NO TEXT here", "", "emptied"),
        ("ocr", "src", "The image shows a cat", "", "emptied"), ("ocr", "src", " a cat ", "a cat", "accepted"),
    ]
    for kind, source, output, want, outcome in cases:
        df = spark.createDataFrame([(source, output)], "source string, output string")
        row = textwork.guard_responses(df, kind).first()
        assert (row["guarded"], row["guard_outcome"]) == (want, outcome), (kind, output)
    with pytest.raises(ValueError):
        textwork.guard_responses(df, "other")


def test_requests(spark):
    questions = [
        "TRANSLATE|en|vi|General|a|b|c", "TRANSLATE|en|vi|General", "ANALYZE|x|y", "ANALYZE", "EXTRACT|aGk=",
        "TRANSCRIBE|a.mp3|", "TRANSCRIBE|a.mp3|vi", "TRANSCRIBE", "TRANSLATE_DOCX|in|out|ja",
        "TRANSLATE_DOCX|in|out|ja|m|0.7|2|st|Formal", "TRANSLATE_DOCX|in|out|ja|m|hot", "TRANSLATE_DOCX|in|out", "", "translate|a|b|c|d",
    ]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "id int, question string")
    got = [r.asDict() for r in textwork.parse_requests(df).orderBy("id").collect()]
    reasons = [r["reject_reason"] for r in got]
    assert reasons == [
        None, "too_few_fields", None, "too_few_fields", None, None, None, "too_few_fields", None, None, "bad_number",
        "too_few_fields", "unknown_verb", "unknown_verb",
    ]
    assert got[0]["body"] == "a|b|c" and got[2]["body"] == "x|y" and got[4]["body"] == "aGk="
    assert got[5]["language"] is None and got[6]["language"] == "vi"
    assert (got[8]["model"], got[8]["temperature"], got[8]["workers"], got[8]["status_file"], got[8]["style"]) == (
        "gpt-4o-mini", 0.3, 4, None, "General"
    )
    assert (got[9]["temperature"], got[9]["workers"], got[9]["status_file"], got[9]["style"]) == (0.7, 2, "st", "Formal")


def test_fragments(spark):
    replies = [
        '{"language":[{"name":"Thai","code":"th","text":"a"},{"code":"en"}]}', '{"language":[]}', "{}", "[1]", "not json",
        '{"language":[{"name"', "", ' {"language":[{"text":"b"}]} ',
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    got = sorted((r["id"], r["pos"], r["name"], r["code"], r["text"]) for r in textwork.language_fragments(df).collect())
    error = ("Error", "err", "Failed to parse analysis result")
    assert got == [
        (0, 0, "Thai", "th", "a"), (0, 1, "Unknown", "en", ""), (3, 0, *error), (4, 0, *error), (5, 0, *error), (6, 0, *error),
        (7, 0, "Unknown", "und", "b"),
    ]
