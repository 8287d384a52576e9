"""Languages of subtitles as their file names tell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of two letters with those of three, and names of the latter.
CODES = {
    "en": "eng", "es": "spa", "fr": "fra", "de": "deu", "it": "ita", "pt": "por", "ja": "jpn", "zh": "zho", "ru": "rus", "ar": "ara", "ko": "kor",
    "nl": "nld", "hi": "hin", "tr": "tur", "pl": "pol", "sv": "swe", "no": "nor", "da": "dan", "fi": "fin", "cs": "ces", "el": "ell", "he": "heb",
    "hu": "hun", "id": "ind", "ro": "ron", "th": "tha", "vi": "vie", "uk": "ukr", "bg": "bul", "hr": "hrv", "sk": "slk", "sl": "slv", "et": "est",
    "lv": "lav", "lt": "lit", "ca": "cat", "ms": "msa", "fa": "fas", "bn": "ben", "ta": "tam", "te": "tel", "ml": "mal", "mr": "mar", "ur": "urd",
}
NAMES = {
    "eng": "English", "spa": "Spanish", "fra": "French", "deu": "German", "ita": "Italian", "por": "Portuguese", "jpn": "Japanese", "zho": "Chinese", "chi": "Chinese",
    "rus": "Russian", "ara": "Arabic", "kor": "Korean", "nld": "Dutch", "hin": "Hindi", "tur": "Turkish", "pol": "Polish", "swe": "Swedish", "nor": "Norwegian",
    "dan": "Danish", "fin": "Finnish", "ces": "Czech", "ell": "Greek", "heb": "Hebrew", "hun": "Hungarian", "ind": "Indonesian", "ron": "Romanian", "tha": "Thai",
    "vie": "Vietnamese", "ukr": "Ukrainian", "bul": "Bulgarian", "hrv": "Croatian", "slk": "Slovak", "slv": "Slovenian", "est": "Estonian", "lav": "Latvian",
    "lit": "Lithuanian", "cat": "Catalan", "msa": "Malay", "fas": "Persian", "ben": "Bengali", "tam": "Tamil", "tel": "Telugu", "mal": "Malayalam", "mar": "Marathi", "urd": "Urdu",
}
EXTENSIONS = ("srt", "ass", "ssa", "vtt")


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def language_code(code: Column) -> Column:
    """A language's code of three letters in lower case; codes that are not known, or not of two letters, only in lower case."""
    return F.coalesce(_looked_up(CODES, F.lower(code)), F.lower(code))


def language_name(code: Column) -> Column:
    """The English name of a code of three letters, null if unknown."""
    return _looked_up(NAMES, F.lower(code))


def subtitle_tags(stem: Column, name: Column) -> Column:
    """struct<language, title> of a subtitle file beside a film's: both may be empty.

    Of the parts between the film's stem and the extension the first of two or three letters is the language, all others are hints: the title is the language's name, with the hints in brackets. A name that is
    only stem and extension keeps the extension as its part, so that `Film.srt` has the language `srt`."""
    rest = F.regexp_replace(F.when(F.startswith(name, stem), F.substr(name, F.length(stem) + 1)).otherwise(name), r"^\.", "")
    parts = F.filter(F.split(F.regexp_replace(rest, r"^(.+)\.[^.]*$", "$1"), r"\."), lambda p: p != "")
    at = F.aggregate(F.transform(parts, lambda p, i: F.when(p.rlike(r"^\p{L}{2,3}$"), i)), F.lit(None).cast("int"), lambda a, i: F.coalesce(a, i))

    def said(found: Column) -> Column:
        code = F.coalesce(language_code(F.get(found["parts"], found["at"])), F.lit(""))
        hints = F.array_join(F.filter(found["parts"], lambda p, i: found["at"].isNull() | (i != found["at"])), " ")
        human = F.coalesce(language_name(code), F.lit(""))
        return F.struct(code.alias("language"), F.when(human == "", hints).when(hints == "", human).otherwise(F.concat(human, F.lit(" ("), hints, F.lit(")"))).alias("title"))

    return F.get(F.transform(F.array(F.struct(parts.alias("parts"), at.alias("at"))), said), F.lit(0))
