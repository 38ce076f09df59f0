"""Problem 2: one consistent form for texts that look the same and differ in their characters.

Every token's letters are resolved to the scripts they could stand for: their own and, for look-alikes, those of the
letters they look like, Latin or not. A token of letters from more than one script takes the spelling of the script that
all of them could be; where several are left, that of most words of the text that can be of one only, then that of most
of its letters. A token that is wholly of look-alikes takes the script of the words around it. Full-width forms,
ligatures, loose accents, invisible characters and unusual spaces are then folded.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts and the Latin letters that they look like.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝкмтнвҮѴѵԌԜԚӀӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwkmthbYVvGWQIl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικτϳͿ", "ABEZHIKMNOPTYXavopuiktjJ")
ARMENIAN = ("ՕՍԼՏօսոհցզ", "OULSounhgq")
CHEROKEE = ("ᎪᎳᎷᏀᏃᏒᏚᏢᎠᎡᎢᎫᎬᎻᎽᏔᏙᏞᏟᏦᏴ", "AWMGZRSPDRTJEHYWVLCKB")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
TABLES = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Lisu": LISU}
LOOK_ALIKES = {ord(a): b for own, latin in TABLES.values() for a, b in zip(own, latin, strict=True)}
#: The same the other way round, by script: the first of several letters that look alike.
INTO = {script: {ord(b): a for a, b in reversed(list(zip(own, latin, strict=True)))} for script, (own, latin) in TABLES.items()}
#: Scripts that are told apart; the rest count as one.
SCRIPTS = ("Latin", *TABLES, "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Georgian", "Hangul", "Hiragana", "Katakana", "Han", "Coptic", "Ethiopic")
SCRIPT = regex.compile("|".join(rf"(?P<{script}>\p{{Script={script}}})" for script in SCRIPTS))

#: A token: letters, digits and what may hide between them.
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}͏]+")
WIDE = regex.compile(r"[！-｠￠-￦ﬀ-ﬆﬓ-ﬗ]")
LOOSE = regex.compile(r"(?<=\p{L}\p{M}*)\p{Mn}")
INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠㅤﾠ]")
SPACE = regex.compile(r"[^\P{Zs} ]")
#: Joiners keep their place between letters of scripts that need them and between pictures.
NEEDED_JOINER = regex.compile(r"(?<=[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Malayalam}\p{Sinhala}\p{Tamil}\p{Telugu}\p{Kannada}\p{So}\p{Sk}️]\p{M}*)[‌‍]")
#: What a text must hold to be worth a look; Java and Python read it alike.
SUSPECT = r"[^\x00-\x7e¡-¬®-ɏ‐-‧‰-⁞₠-₿]"
FORMS = ("wide", "loose_accent", "invisible", "space", "script", "latin")


@lru_cache(maxsize=100_000)
def own_script(letter: str) -> str | None:
    """The script of a letter by its Unicode property; None for what belongs to none, and for letters used as signs."""
    if not letter.isalpha() or unicodedata.category(letter) == "Lm" or unicodedata.normalize("NFKC", letter) != letter:
        return None
    match = SCRIPT.match(letter)
    return match.lastgroup if match else "other"


@lru_cache(maxsize=100_000)
def scripts(letter: str) -> frozenset[str]:
    """The scripts a character may be taken for; empty for what belongs to no script."""
    own = own_script(letter)
    if own is None:
        return frozenset()
    if own == "Latin":
        return frozenset((own, *(script for script, letters in INTO.items() if ord(letter) in letters)))
    return frozenset((own, "Latin")) if ord(letter) in LOOK_ALIKES else frozenset((own,))


@lru_cache(maxsize=200_000)
def token_scripts(token: str) -> tuple[frozenset[str], tuple[tuple[str, int], ...]]:
    """The scripts that all letters of a token could be of, and how many are of each, most first."""
    letters = [c for c in token if scripts(c)]
    own: dict[str, int] = {}
    for c in letters:
        own[own_script(c)] = own.get(own_script(c), 0) + 1
    common = frozenset.intersection(*map(scripts, letters)) if letters else frozenset()
    return common, tuple(sorted(own.items(), key=lambda x: (-x[1], x[0])))


def chosen_script(token: str, decided: dict[str, int]) -> str | None:
    """The script that a token of several scripts is to be spelt in; None if no script could be that of all its letters.

    Of several, that of most words in `decided`, then that of most of its own letters, then Latin.
    """
    common, own = token_scripts(token)
    counts = dict(own)
    return max(common, key=lambda s: (decided.get(s, 0), counts.get(s, 0), s == "Latin", s), default=None)


def respelt(token: str, script: str) -> str:
    """A token with the look-alikes of other scripts' letters in the letters of `script`."""
    latin = token.translate({k: v for k, v in LOOK_ALIKES.items() if own_script(chr(k)) != script})
    return latin if script == "Latin" else latin.translate(INTO[script])


def consistent(text: str) -> tuple[str, list[str]]:
    """The text in its consistent form, and which forms of FORMS it held: `script` for another script's letters among Latin
    ones, `latin` for Latin letters among another script's."""
    found = [name for name, pattern in (("wide", WIDE), ("loose_accent", LOOSE), ("invisible", INVISIBLE), ("space", SPACE)) if pattern.search(text)]
    if found:
        text = WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
        kept = {m.start() for m in NEEDED_JOINER.finditer(text)}
        text = INVISIBLE.sub(lambda m: m.group() if m.start() in kept else "", text)
        text = unicodedata.normalize("NFC", SPACE.sub(" ", text))
    words = [(m, *token_scripts(m.group())) for m in TOKEN.finditer(text)]
    words = [w for w in words if w[2]]
    if all(len(own) == 1 and own[0][0] == "Latin" for _, _, own in words):
        return text, found
    decided: dict[str, int] = {}
    for _, common, own in words:
        if len(own) == 1 and len(common) == 1:
            decided[own[0][0]] = decided.get(own[0][0], 0) + 1
    takes = [chosen_script(m.group(), decided) if len(own) > 1 else own[0][0] for m, _, own in words]
    out, at, forms = [], 0, set()
    for n, (m, common, own) in enumerate(words):
        into = takes[n] if len(own) > 1 else None
        if len(own) == 1 and own[0][0] != "Latin" and "Latin" in common:  # wholly of look-alikes
            near = takes[max(0, n - 1) : n] + takes[n + 1 : n + 2]
            into = "Latin" if near and all(x == "Latin" for x in near) else None
        if into:
            out += [text[at : m.start()], respelt(m.group(), into)]
            at = m.end()
            forms.add("script" if into == "Latin" else "latin")
    if out:
        text = "".join(out) + text[at:]
    return text, found + sorted(forms, reverse=True)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("forms", T.ArrayType(T.StringType()))]))
def _consistent(texts: pd.Series) -> pd.DataFrame:
    done = [(None, None) if x is None else consistent(x) for x in texts]
    return pd.DataFrame(done, columns=["text", "forms"])


def consistent_form(text: Column) -> Column:
    """struct<text, forms>: `text` in its consistent form and the kinds of deviating forms that it held.

    Texts of plain characters never leave the JVM's side of the Arrow exchange. Null gives a null text and no forms;
    empty and plain texts come back unchanged. Symbols, superscripts, fractions, dashes and quotation marks stay.
    """
    looked = _consistent(F.when(text.rlike(SUSPECT), text))
    return F.struct(F.coalesce(looked["text"], text).alias("text"), F.coalesce(looked["forms"], F.array().cast("array<string>")).alias("forms"))


def consistent_texts(texts: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """keys + (text, consistent, forms) of every row."""
    return texts.select(*keys, F.col(text_column).alias("text"), consistent_form(F.col(text_column)).alias("c")).select(*keys, "text", F.col("c.text").alias("consistent"), F.col("c.forms").alias("forms"))


def items(pages: DataFrame, mentions: DataFrame) -> DataFrame:
    of = lambda kind, df, column: df.select(F.lit(kind).alias("item_kind"), F.col("id").alias("item_id"), F.col(column).alias("text"))
    return of("page", pages, "text").unionAll(of("mention", mentions, "normalized_text"))


def deviating_items(pages: DataFrame, mentions: DataFrame) -> DataFrame:
    """(item_kind, item_id): pages and mentions whose text holds a deviating form, once each. Latin letters in words of
    another script are mended too, but are no case."""
    suspects = items(pages, mentions).where(F.col("text").rlike(SUSPECT))
    looked = consistent_texts(suspects, ["item_kind", "item_id"], "text")
    return looked.where(F.size(F.array_remove("forms", "latin")) > 0).select("item_kind", "item_id").distinct()
