"""Text functions on columns. Built-in expressions wherever they can state the meaning; the rest are Arrow-fed."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------------------------------------ tokens


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)


def query_terms(text: Column) -> Column:
    """Runs of Unicode word characters, as they are."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def words(text: Column) -> Column:
    """What Unicode white space parts."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda x: x != "")


def normalized(text: Column) -> Column:
    """Lower-case ASCII words joined by single spaces; of case-folded text, so `ß` counts as `ss`."""
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def contains_tokens(tokens: Column, wanted: Column) -> Column:
    """Whether the array `wanted` stands in the array `tokens` without a gap; an empty one never does."""
    space = F.lit(" ")
    around = lambda a: F.concat(space, F.array_join(a, " "), space)
    return (F.size(wanted) > 0) & F.contains(around(tokens), around(wanted))


#: Fixed value: a figure in a text.
NUMBER = r"(?<![\w.])-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def numbers(text: Column) -> Column:
    """Figures with thousands' commas taken out, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def close_numbers(value: Column, reference: Column) -> Column:
    """Whether two figures agree within 0.01, a thousandth of the reference, or a relative 1e-9."""
    relative = F.greatest(F.abs(value), F.abs(reference)) * 1e-9
    return F.abs(value - reference) <= F.greatest(relative, F.lit(0.01), F.abs(reference) * 0.001)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def base_name(path: Column) -> Column:
    """The last part of a path; null if blank."""
    last = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(F.trim(last) != "", last)


def human_size(size: Column) -> Column:
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024.0)).otherwise(F.format_string("%.1f MB", size / (1024.0 * 1024.0)))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("Page %d", start)).otherwise(F.format_string("Pages %d-%d", start, end))


def key_of(*parts: Column) -> Column:
    """SHA-256 in hex of the parts with a zero character between them; a null part counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fingerprint(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 12)


# ------------------------------------------------------------------------------------------------ Arrow-fed functions


def _each(function, text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else function(x) for x in text], dtype=object)


def compatible(text: str) -> str:
    """NFKC with white space made single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(T.StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case kept: the form in which recognised text is compared."""
    return _each(compatible, text)


@F.pandas_udf(T.StringType())
def entity_form(text: pd.Series) -> pd.Series:
    """NFKC, then case-folded, white space collapsed: the form in which entities are matched."""
    return _each(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()), text)


@F.pandas_udf(T.StringType())
def case_folded(text: pd.Series) -> pd.Series:
    return _each(str.casefold, text)


@F.pandas_udf(T.LongType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in words; null if either text is."""
    return pd.Series([None if x is None or y is None else _distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def index_terms(text: pd.Series) -> pd.Series:
    """Terms of the full-text index: letters and digits of any script, without accents, lower case, stemmed."""
    return pd.Series([None if x is None else stemmed_terms(x) for x in text], dtype=object)


def index_tokens(text: str) -> list[str]:
    """Runs of letters, digits and marks; accents of Latin letters are folded, `ß` stays."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return [t.lower() for t in re.findall(r"[^\W_]+", flat)]


def stemmed_terms(text: str) -> list[str]:
    return [porter_stem(t) for t in index_tokens(text)]


# ------------------------------------------------------------------------------------------------ Porter's stemmer (1980)

#: The suffix tables of the published algorithm.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize"
_TABLES = [sorted((tuple(p.split(":")) for p in t.split()), key=lambda p: -len(p[0])) for t in (STEP_2, STEP_3)]
_LAST = sorted(STEP_4.split(), key=len, reverse=True)


def _shape(stem: str) -> str:
    """The stem's letters as c (consonant) and v (vowel); y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(stem):
        out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    """The stem of an ASCII lower-case word; words of one or two letters and others stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")) or _measure(word) == 1 and _short(word):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in _TABLES:
        hit = next((p for p in table if word.endswith(p[0])), None)
        if hit and _measure(word[: -len(hit[0])]):
            word = word[: -len(hit[0])] + hit[1]
    end = next((s for s in _LAST if word.endswith(s)), None)
    if end:
        stem = word[: -len(end)] + (end[0] if end in ("sion", "tion") else "")
        if _measure(stem) > 1:
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
