"""Language codes and names of the OCR readers and of the translator."""

# name -> OCR code, in the readers' own order. Where several names share a code,
# the first one is the code's display name.
NAME_TO_OCR = {
    "Abaza": "abq",
    "Adyghe": "ady",
    "Afrikaans": "af",
    "Angika": "ang",
    "Arabic": "ar",
    "Assamese": "as",
    "Avar": "ava",
    "Azerbaijani": "az",
    "Belarusian": "be",
    "Bulgarian": "bg",
    "Bihari": "bh",
    "Bhojpuri": "bho",
    "Bengali": "bn",
    "Bosnian": "bs",
    "Chinese": "ch_sim",
    "Chinese Simplified": "ch_sim",
    "Simplified Chinese": "ch_sim",
    "Chinese Traditional": "ch_tra",
    "Traditional Chinese": "ch_tra",
    "Chechen": "che",
    "Czech": "cs",
    "Welsh": "cy",
    "Danish": "da",
    "Dargwa": "dar",
    "German": "de",
    "English": "en",
    "Spanish": "es",
    "Estonian": "et",
    "Persian": "fa",
    "Farsi": "fa",
    "French": "fr",
    "Irish": "ga",
    "Goan Konkani": "gom",
    "Hindi": "hi",
    "Croatian": "hr",
    "Hungarian": "hu",
    "Indonesian": "id",
    "Ingush": "inh",
    "Icelandic": "is",
    "Italian": "it",
    "Japanese": "ja",
    "Kabardian": "kbd",
    "Kannada": "kn",
    "Korean": "ko",
    "Kurdish": "ku",
    "Latin": "la",
    "Lak": "lbe",
    "Lezghian": "lez",
    "Lithuanian": "lt",
    "Latvian": "lv",
    "Magahi": "mah",
    "Maithili": "mai",
    "Maori": "mi",
    "Mongolian": "mn",
    "Marathi": "mr",
    "Malay": "ms",
    "Maltese": "mt",
    "Nepali": "ne",
    "Newari": "new",
    "Dutch": "nl",
    "Norwegian": "no",
    "Occitan": "oc",
    "Pali": "pi",
    "Polish": "pl",
    "Portuguese": "pt",
    "Romanian": "ro",
    "Russian": "ru",
    "Serbian": "rs_cyrillic",
    "Serbian Cyrillic": "rs_cyrillic",
    "Serbian Latin": "rs_latin",
    "Nagpuri": "sck",
    "Slovak": "sk",
    "Slovenian": "sl",
    "Albanian": "sq",
    "Swedish": "sv",
    "Swahili": "sw",
    "Tamil": "ta",
    "Tabassaran": "tab",
    "Telugu": "te",
    "Thai": "th",
    "Tajik": "tjk",
    "Tagalog": "tl",
    "Turkish": "tr",
    "Uyghur": "ug",
    "Ukrainian": "uk",
    "Urdu": "ur",
    "Uzbek": "uz",
    "Vietnamese": "vi",
}

# Codes that differ between ISO and the OCR readers; every other reader code is
# its own ISO code.
ISO_TO_OCR_RENAMED = {"zh": "ch_sim", "zh_tw": "ch_tra", "rs": "rs_cyrillic", "rs_lat": "rs_latin"}

DEFAULT_OCR = "en"

# Target codes the translator knows by English name.
TRANSLATOR_NAMES = {
    "vi": "Vietnamese",
    "en": "English",
    "fr": "French",
    "de": "German",
    "ja": "Japanese",
    "ko": "Korean",
    "zh": "Chinese",
    "es": "Spanish",
    "ru": "Russian",
    "it": "Italian",
    "pt": "Portuguese",
    "nl": "Dutch",
    "ar": "Arabic",
    "hi": "Hindi",
    "th": "Thai",
    "id": "Indonesian",
    "ms": "Malay",
}


def name_rows() -> list[tuple[str, str, int]]:
    """(name, OCR code, position) for every reader language."""
    return [(name, code, position) for position, (name, code) in enumerate(NAME_TO_OCR.items())]


def iso_rows() -> list[tuple[str, str]]:
    """(ISO code, OCR code)."""
    renamed = set(ISO_TO_OCR_RENAMED.values())
    same = sorted({code for _, code, _ in name_rows()} - renamed)
    return [(code, code) for code in same] + list(ISO_TO_OCR_RENAMED.items())
