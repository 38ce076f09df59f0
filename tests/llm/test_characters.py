import pytest

from quire.llm import characters


@pytest.mark.parametrize(
    "text,plain,forms",
    [
        ("Ｌｉｍｉｔｅｄ", "Limited", ["wide"]),
        ("ﬁnance oﬀset", "finance offset", ["wide"]),
        ("café", "café", ["loose_accent"]),
        ("Lim​ited co­op", "Limited coop", ["invisible"]),
        ("﻿start", "start", ["invisible"]),
        ("a b c　d", "a b c d", ["space"]),
        ("Cоmpany аnd thе", "Company and the", ["script"]),
        ("Krabimеcоn Κorp", "Krabimecon Korp", ["script"]),
        ("paid а sum", "paid a sum", ["script"]),
        ("Ｃоmpany​", "Company", ["wide", "invisible", "script"]),
    ],
)
def test_deviating(text, plain, forms):
    assert characters.consistent(text) == (plain, forms)
    assert characters.consistent(plain) == (plain, [])


@pytest.mark.parametrize("text", ["", "Площадка Лужинстрой остаётся закрытой", "Δ of β", "½ cup² ™ № 771 …", "“quoted” – and — ‘so’", "year-end 10 % €5", "naïve Müller ß", "a\tb\nc", "рост цен", "日本語 テキスト"])
def test_no_cases(text):
    assert characters.consistent(text) == (text, [])


def test_scripts_of_tokens():
    common = lambda token: characters.token_scripts(token)[0]
    assert "Latin" in common("C\u043empany") and "Cyrillic" not in common("C\u043empany") and common("закрытой") == {"Cyrillic"} and common("рост") == {"Cyrillic", "Latin"} and common("123") == set()
    assert common("Rжz") == set() and characters.chosen_script("Rжz", {}) is None
    assert {s for c in "xж" for s in characters.scripts(c)} >= {"Latin", "Cyrillic"} and characters.own_script("µ") is None and characters.own_script("ʰ") is None


@pytest.mark.parametrize(
    "text,plain",
    [
        ("в М\u006fскве", "в Москве"),  # a Latin o
        ("в\u006fда", "вода"),
        ("Совет дал \u006fтчёт о росте", "Совет дал отчёт о росте"),
        ("τ\u006f μέλλον", "το μέλλον"),
        ("\ua4eepple and pears", "Apple and pears"),  # Lisu
    ],
)
def test_the_words_own_script(text, plain):
    got, forms = characters.consistent(text)
    assert got == plain and forms and characters.consistent(plain) == (plain, [])


def test_text_decides_between_scripts():
    assert characters.consistent("sales of the C\u043ec\u043e brand rose")[0] == "sales of the Coco brand rose"
    assert characters.consistent("Продажи марки С\u006fс\u006f выросли")[0] == "Продажи марки Сосо выросли"


def test_tables_are_consistent():
    assert all(len(own) == len(latin) and len(set(own)) == len(own) for own, latin in characters.TABLES.values())
    assert all(characters.own_script(c) == script for script, (own, _) in characters.TABLES.items() for c in own)


def test_latin_letters_in_other_scripts_are_no_case(spark):
    pages = spark.createDataFrame([(1, "в М\u006fскве"), (2, "th\u0435 end")], "id bigint, text string")
    mentions = spark.createDataFrame([], "id bigint, normalized_text string")
    assert [tuple(r) for r in characters.deviating_items(pages, mentions).collect()] == [("page", 2)]


def test_tables(spark):
    pages = spark.createDataFrame([(1, "plain", "x"), (2, "thе", "x"), (2, "thе", "x"), (3, None, "x"), (4, "", "x"), (5, "ok " * 50000 + "​", "x")], "id bigint, text string, normalized_text string")
    mentions = spark.createDataFrame([(1, None, "ｗ"), (2, "thе", None), (3, "x", "plain")], "id bigint, text string, normalized_text string")
    assert sorted(map(tuple, characters.deviating_items(pages, mentions).collect())) == [("mention", 1), ("page", 2), ("page", 5)]
    out = {(r["item_kind"], r["item_id"]): r["consistent"] for r in characters.consistent_texts(characters.items(pages, mentions), ["item_kind", "item_id"], "text").collect()}
    assert out["page", 2] == "the" and out["page", 3] is None and out["page", 4] == "" and out["mention", 1] == "w"
    assert characters.deviating_items(pages.limit(0), mentions.limit(0)).count() == 0
