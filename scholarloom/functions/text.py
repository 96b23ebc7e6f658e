"""String forms: whitespace, case folding, comparison and normal forms, headings, sentences."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from scholarloom import settings

# Java's Unicode white space plus the four separators Python's str.split() also takes.
SPACE = r"(?U)[\s\x1c-\x1f]+"
ASCII_TEXT = r"^[\x00-\x7F]*$"
# Letters whose compatibility form is themselves: ASCII and the Latin-1 letters.
PLAIN_TEXT = "^[\\x00-\\x7FÀ-ÖØ-öø-ÿ]*$"


def collapse_space(text: Column) -> Column:
    """Single blanks between words, none around them."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean(text: Column) -> Column:
    """Collapsed text, NULL when nothing is left."""
    return F.nullif(collapse_space(text), F.lit(""))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """What case folding changes beyond lower-casing, derived from the Unicode rule."""
    single: dict[str, str] = {}
    several: list[tuple[str, str]] = []
    for code in range(0x110000):
        low = chr(code)
        folded = low.casefold()
        if folded == low or low.lower() != low:
            continue
        if len(folded) == 1:
            single[low] = folded
        else:
            several.append((low, folded))
    return "".join(single), "".join(single.values()), several


def _ranges(codes: list[int], gap: int = 128) -> str:
    """Character class of few ranges around ``codes``; a long list of single characters is slow to match."""
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def casefold(text: Column) -> Column:
    """Full Unicode case folding with built-in expressions.

    ``lower`` does nearly all of it; the few characters that fold further are translated. Of those
    that fold to several characters only the sharp s is common; the others are looked for first.
    """
    frm, to, several = _fold_tables()
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    rare = [(a, b) for a, b in several if a != "ß"]
    # One literal text, character and expansion glued together, keeps the expression small.
    pairs = F.split(F.lit(" ".join(a + b for a, b in rare)), " ")
    expand = F.aggregate(pairs, lowered, lambda acc, p: F.replace(acc, F.substring(p, 1, 1), F.substring(p, 2, 9)))
    has_rare = lowered.rlike(_ranges([ord(a) for a, _ in rare]))
    # Translating looks at every character; few texts hold one of these. No gap here takes in a Latin letter that is common.
    has_single = lowered.rlike(_ranges([ord(a) for a in frm], 16))
    folded = F.when(has_rare, F.translate(expand, frm, to)).when(has_single, F.translate(lowered, frm, to)).otherwise(lowered)
    return F.when(text.rlike(ASCII_TEXT), F.lower(text)).when(text.rlike(PLAIN_TEXT), lowered).otherwise(folded)


@pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def compatibility_form(text: Column) -> Column:
    """NFKC. Only text outside ASCII and the Latin-1 letters is sent to Python."""
    plain = text.rlike(PLAIN_TEXT)
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def normal_form(text: Column, *, exact: bool = True) -> Column:
    """Title and author normal form; NULL where nothing is left (the caller rejects it).

    ``exact=False`` leaves NFKC out, for columns known to be composed text.
    """
    composed = compatibility_form(text) if exact else text
    words = F.trim(F.regexp_replace(casefold(composed), r"[^\p{L}\p{N}]+", " "))
    return F.nullif(words, F.lit(""))


def comparison_form(text: Column) -> Column:
    """Form in which two narrative texts count as the same."""
    return F.btrim(collapse_space(casefold(text)), F.lit(" .,:;-"))


def text_hash(text: Column) -> Column:
    """Content address of a passage, blind to case and spacing."""
    return F.sha2(collapse_space(casefold(text)), 256)


def is_heading(text: Column) -> Column:
    few_words = F.size(F.split(text, " ")) <= settings.HEADING_MAX_WORDS
    return text.rlike(settings.HEADING_PATTERN) & few_words


def first_sentence(text: Column, fallback: str, limit: int = 240) -> Column:
    """First sentence, cut to ``limit`` characters with an ellipsis."""
    sentence = F.split(clean(text), r"(?<=[.!?])\s+", 2)[0]
    cut = F.concat(F.rtrim(F.substring(sentence, 1, limit - 3)), F.lit("…"))
    return F.coalesce(F.when(F.length(sentence) > limit, cut).otherwise(sentence), F.lit(fallback))


def label_form(value: Column, allowed: list[str]) -> Column:
    """The first allowed option a free-text label is, or starts with before a blank, colon or dash."""
    pattern = rf"^({'|'.join(allowed)})(?= |:|\z)"
    return F.coalesce(F.nullif(F.regexp_extract(casefold(F.trim(value)), pattern, 1), F.lit("")), value)


def search_tokens(text: Column) -> Column:
    """Distinct folded tokens: runs of letters and digits, accents removed."""
    plain = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), *_accent_tables())  # all there is to do for the Latin-1 letters
    folded = F.when(text.rlike(ASCII_TEXT), F.lower(text)).when(text.rlike(PLAIN_TEXT), plain).otherwise(fold_accents(casefold(text)))
    parts = F.split(folded, r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(parts), "")


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str]:
    """Latin letters with marks -> base letter, by canonical decomposition."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


def fold_accents_text(text: str) -> str:
    """The same folding for a text at hand, such as a query."""
    bare = "".join(c for c in text if unicodedata.category(c) != "Mn")
    return bare.translate(str.maketrans(*_accent_tables()))


def fold_accents(text: Column) -> Column:
    frm, to = _accent_tables()
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), frm, to)


def stable_key(*parts: Column) -> Column:
    """Deterministic key: sha256 over the parts joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256)


def sorted_json(value_map: Column) -> Column:
    """Map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value_map))))
