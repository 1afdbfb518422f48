"""Segmentation and syllables as regular expressions over NFC text; each is one expression that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_YOR_V, _YOR_C = "aeiouẹọAEIOUẸỌ", "bdfghjklmnprstvwyṣBDFGHJKLMNPRSTVWYṢ"
_IBO_V, _IBO_C = "aeiouịọụAEIOUỊỌỤ", "bcdfghjklmnprstvwyzBCDFGHJKLMNPRSTVWYZṅṄ"
#: T7. What is neither vowel nor consonant belongs to the syllable before it, at the beginning to one of its own.
YORUBA = f"[{_YOR_C}]?[{_YOR_V}][^{_YOR_V}{_YOR_C}]*|[{_YOR_C}][^{_YOR_V}{_YOR_C}]*|^[^{_YOR_V}{_YOR_C}]+"
_PAIRS = "[cCsS][hH]|[gG][bBhHwW]|[kK][pPwW]|[nN][wWyY]"
#: T8. Two letters that count as one consonant come first.
IGBO = f"(?:{_PAIRS})[{_IBO_V}]?[^{_IBO_V}{_IBO_C}]*|[{_IBO_C}]?[{_IBO_V}][^{_IBO_V}{_IBO_C}]*|[{_IBO_C}][^{_IBO_V}{_IBO_C}]*|^[^{_IBO_V}{_IBO_C}]+"
WORD_YOR, WORD_IBO = r"\p{L}'", r"\p{L}'\-"
PATTERNS = {"yor": YORUBA, "ibo": IGBO}
WORD_CHARS = {"yor": WORD_YOR, "ibo": WORD_IBO}


def syllabify(word: Column, lang: str = "yor") -> Column:
    """Array of syllables."""
    if lang not in PATTERNS:
        raise ValueError(f"no syllables for {lang}; there are: {', '.join(PATTERNS)}")
    return F.regexp_extract_all(word, F.lit(PATTERNS[lang]), 0)


def syllabify_yoruba(word: Column) -> Column:
    return syllabify(word, "yor")


def syllabify_igbo(word: Column) -> Column:
    return syllabify(word, "ibo")


def segment(text: Column, lang: str = "yor") -> Column:
    """Array of (token, is_word); words are runs of letters and apostrophes (in Igbo hyphens too), each other character is a token."""
    letters = WORD_CHARS[lang]
    tokens = F.regexp_extract_all(text, F.lit(f"(?s)[{letters}]+|."), 0)
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), t.rlike(f"^[{letters}]").alias("is_word")))


def char_class(c: Column, lang: str = "yor") -> Column:
    """Vowel, consonant (which takes n and m in) or NULL."""
    vowels, consonants = (_YOR_V, _YOR_C) if lang == "yor" else (_IBO_V, _IBO_C.rstrip("ṅṄ"))
    return F.when(c.rlike(f"^[{vowels}]$"), "vowel").when(c.rlike(f"^[{consonants}]$"), "consonant").when(c.rlike("^[nmNM]$" if lang == "yor" else "^[mnMNṅṄ]$"), "nasal")
