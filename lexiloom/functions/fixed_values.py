"""Word lists, patterns, defaults and lookup tables that decide results.

They are part of the data formats this library works with, so they are stated
here as plain text and used everywhere else by name.
"""

# --- character classes -------------------------------------------------------
# Unicode word characters and white space, written out so that they mean the
# same in every regular-expression engine.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
# The same white space as single characters.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# --- segment classes ---------------------------------------------------------
NUMBER_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
NUMBER = (
    rf"^[+-]?(?:(?:{NUMBER_DIGITS}(?:[.,](?:{NUMBER_DIGITS})?)?|[.,]{NUMBER_DIGITS})"
    rf"(?:[eE][+-]?{NUMBER_DIGITS})?|(?i:inf|infinity|nan))$"
)
LONG_DIGITS = r"^[\p{Nd}\x{00b9}\x{00b2}\x{00b3}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]{4,}$"
ROMAN = r"^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
SHORT_TEXT = 2
FALLBACK_MIN_CHARS = 10
# Reason -> pattern, tested in this order at the start of the stripped text.
PRESERVE = {
    "number_prefix": r"^\p{Nd}+",
    "roman": r"^[iIvVxXlLcCdDmM]+$",
    "code": r"^[A-Z]\p{Nd}+$",
    "iso_date": r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}$",
    "slash_date": r"^(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|1[0-2])/\p{Nd}{4}$",
}
# A proper name is a run of capitalised words, each followed by at most one
# blank: it opens with a capital and nothing in it breaks the pattern.
PROPER_NAME_OPENS = r"^[A-Z]"
PROPER_NAME_BREAKS = rf"[^A-Za-z{SPACE}]|[{SPACE}]{{2}}|[{SPACE}][a-z]"

# --- protected spans ---------------------------------------------------------
URL = (
    rf"https?://(?:[-{WORD}.]+|%[\p{{Nd}}a-fA-F]{{2}})+"
    rf"(?:/[-{WORD}%!$&'()*+,;=:@/~]*)?"
    rf"(?:\?[-{WORD}%!$&'()*+,;=:@/~]*)?"
    rf"(?:#[-{WORD}%!$&'()*+,;=:@/~]*)?"
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DOMAIN = (
    rf"(?<![{WORD}])(?:www\.)?[a-zA-Z0-9][-a-zA-Z0-9]*"
    rf"(?:\.[a-zA-Z0-9][-a-zA-Z0-9]*)+(?![{WORD}])"
)
LINK_KINDS = (("URL", URL), ("EMAIL", EMAIL), ("DOMAIN", DOMAIN))
FORMAT_PATTERNS = (
    rf"https?://[^{SPACE}]+",
    rf"www\.[^{SPACE}]+\.[a-zA-Z]{{2,}}[^{SPACE}]*",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    rf"[a-zA-Z]:\\[^{SPACE}]+",
    r"/[a-zA-Z0-9_/.-]+",
    rf"(?<![{WORD}])\p{{Nd}}+[A-Za-z]+-[A-Za-z0-9]+(?![{WORD}])",
    r"___[A-Z]+_\p{Nd}+___",
    rf"(?<![{WORD}])[A-Z]+\p{{Nd}}+[A-Z]+-[A-Z]+(?![{WORD}])",
)
# Borders at which words stick together: what stands on either side.
SPACED_BORDERS = (
    ("[a-z]", "[A-Z]"),
    ("[a-zA-Z][a-zA-Z]", r"\p{Nd}"),
    (r"\p{Nd}", "[a-zA-Z][a-zA-Z]"),
    ("[a-zA-Z]", rf"[^{WORD}{SPACE}]"),
    (rf"[^{WORD}{SPACE}]", "[a-zA-Z]"),
)
SPACED_PREFIXES = ("pre", "post", "dis", "over", "under", "sub", "inter", "trans")

# --- model answers -----------------------------------------------------------
REVERT_MARKERS = (
    "I'm sorry",
    "Sorry,",
    "but the text",
    "Please provide",
    "does not contain",
    "appears to be incomplete",
    "not in a recognizable",
    "not translatable",
)
NO_TEXT_MARKERS = (
    "It seems that there is no text provided",
    "Please provide the text you would like",
    "There is no text to translate",
    "No content to translate",
)
REMOVED_PHRASES = (
    "I'm sorry",
    "Sorry",
    "There is no text provided",
    "Translate this text to",
    "Here is the translation",
    "Translation:",
)
OCR_EMPTY = "EMPTY"
OCR_NO_TEXT = ("no text", "i don't see any text")
OCR_OPENINGS = (
    "I don't see any text",
    "There is no text",
    "No text is visible",
    "The image does not contain",
    "The image shows",
    "This image contains",
    "The image appears to",
    "There appears to be no",
    "I cannot identify any",
)

# --- requests ----------------------------------------------------------------
DOCX_DEFAULTS = {"model": "gpt-4o-mini", "temperature": 0.3, "workers": 4, "style": "General"}
FRAGMENT_DEFAULTS = {"name": "Unknown", "code": "und", "text": ""}
FRAGMENT_ERROR = {"name": "Error", "code": "err", "text": "Failed to parse analysis result"}

# --- ledger ------------------------------------------------------------------
START_CREDITS = 5000
ACCOUNT_TYPE = "standard"
ACCOUNT_TYPES = ("0", "1", "2")
LOCAL_OFFSET_HOURS = 7
CACHE_SECONDS = 3600
CACHE_SIZE = 2000
CACHE_DROPPED_SHARE = 0.2

# --- media -------------------------------------------------------------------
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg")
AUDIO_SUFFIXES = (".mp3", ".mp4", ".mpeg", ".mpga", ".m4a", ".wav", ".webm")
AUDIO_MAX_BYTES = 25 * 1024 * 1024
DOCUMENT_SUFFIX = ".docx"

# --- text chunks -------------------------------------------------------------
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 400
SEPARATORS = ("\n\n", "\n", " ", ".", ",", "\u200b", "\uff0c", "\u3001", "\uff0e", "\u3002", "")

# --- OCR geometry ------------------------------------------------------------
MERGE_HORIZONTAL = 30
MERGE_VERTICAL = 10
DETECTION_PADDING = 5
FALLBACK_CONFIDENCE = 0.5
FALLBACK_MIN_STD = 10
