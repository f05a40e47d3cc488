"""Texts: white space, labels, language tags, word normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def speaker_label(speaker: Column) -> Column:
    """``Speaker n + 1`` for SPEAKER_n, ``Speaker`` for none, other names as they are."""
    number = F.regexp_extract(speaker, r"^SPEAKER_(\d+)$", 1)
    return (
        F.when(F.coalesce(speaker, F.lit("")) == "", "Speaker")
        .when(number != "", F.concat(F.lit("Speaker "), (number.try_cast("long") + 1).cast("string")))
        .otherwise(speaker)
    )


def resolved_label(speaker: Column, name: Column) -> Column:
    """A user's name for the speaker unless it is empty, else the label."""
    return F.coalesce(F.nullif(name, F.lit("")), speaker_label(speaker))


def valid_language(tag: Column) -> Column:
    return F.coalesce(tag.rlike("^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})?$"), F.lit(False))


def normal_words(text: Column) -> Column:
    """Lower case, all but letters, digits and underscores blanks, single blanks; any script."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def safe_arrow(text: Column) -> Column:
    return F.replace(text, F.lit("-->"), F.lit("->"))


def has_numeral(text: Column) -> Column:
    return text.rlike(r"[0-9%$£]")


def number_option(text: Column) -> Column:
    """A string of digits as a number, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def text_option(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


#: Language codes and names.
LANGUAGES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish", "ru": "russian", "ko": "korean", "fr": "french", "ja": "japanese", "pt": "portuguese",
    "tr": "turkish", "pl": "polish", "ca": "catalan", "nl": "dutch", "ar": "arabic", "sv": "swedish", "it": "italian", "id": "indonesian", "hi": "hindi", "fi": "finnish",
    "vi": "vietnamese", "he": "hebrew", "uk": "ukrainian", "el": "greek", "ms": "malay", "cs": "czech", "ro": "romanian", "da": "danish", "hu": "hungarian", "ta": "tamil",
    "no": "norwegian", "th": "thai", "ur": "urdu", "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian", "la": "latin", "mi": "maori", "ml": "malayalam", "cy": "welsh",
    "sk": "slovak", "te": "telugu", "fa": "persian", "lv": "latvian", "bn": "bengali", "sr": "serbian", "az": "azerbaijani", "sl": "slovenian", "kn": "kannada",
    "et": "estonian", "mk": "macedonian", "br": "breton", "eu": "basque", "is": "icelandic", "hy": "armenian", "ne": "nepali", "mn": "mongolian", "bs": "bosnian",
    "kk": "kazakh", "sq": "albanian", "sw": "swahili", "gl": "galician", "mr": "marathi", "pa": "punjabi", "si": "sinhala", "km": "khmer", "sn": "shona", "yo": "yoruba",
    "so": "somali", "af": "afrikaans", "oc": "occitan", "ka": "georgian", "be": "belarusian", "tg": "tajik", "sd": "sindhi", "gu": "gujarati", "am": "amharic",
    "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese", "ht": "haitian creole", "ps": "pashto", "tk": "turkmen", "nn": "nynorsk", "mt": "maltese",
    "sa": "sanskrit", "lb": "luxembourgish", "my": "myanmar", "bo": "tibetan", "tl": "tagalog", "mg": "malagasy", "as": "assamese", "tt": "tatar", "haw": "hawaiian",
    "ln": "lingala", "ha": "hausa", "ba": "bashkir", "jw": "javanese", "su": "sundanese", "yue": "cantonese",
}
#: Further names.
ALIASES = {
    "burmese": "my", "valencian": "ca", "flemish": "nl", "haitian": "ht", "letzeburgesch": "lb", "pushto": "ps", "panjabi": "pa", "moldavian": "ro", "moldovan": "ro",
    "sinhalese": "si", "castilian": "es",
}
#: Languages that are written without blanks between words.
UNSPACED = ("ja", "zh")


def language_rows() -> list[tuple[str, str]]:
    """(spelling, code) for each code, name and alias."""
    return [(code, code) for code in LANGUAGES] + [(name, code) for code, name in LANGUAGES.items()] + list(ALIASES.items())


def suppressed(tokens: Column, configured: list[str]) -> Column:
    """The tokens that have a numeral, and those configured, once each."""
    return F.array_union(F.filter(tokens, has_numeral), F.array(*map(F.lit, configured)))


def coerced(value: Column, allowed: list[str], default: str) -> Column:
    """The value if it is one of those allowed, else the default."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))
