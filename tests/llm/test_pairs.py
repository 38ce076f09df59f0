import json

import pytest

from quire.llm import pairs


@pytest.mark.parametrize("text", ["a (b", "see [1", "“quoted", 'he said "so', "```\ncode", "use `x", "<b>bold", "<a href='x", "1. one\n2.", "„so", "{'a': ["])
def test_left_open(text):
    assert pairs.open_at_end(text)


@pytest.mark.parametrize("text", ["", "a (b) [c] {d}", "“so”", '"so"', "```x``` `y`", "<b>x</b><br>", "it's 5' 6\" tall", "1) first", "„so“", "a < b", ":)", "- item\n- item", "**bold** and *it*", "f(x[1])"])
def test_closed(text):
    assert not pairs.open_at_end(text)


def test_texts_of_broken_json():
    whole = json.dumps({"status": "answered", "claims": [{"text": 'He said "no".', "citation_ids": ["C1"]}, {"text": "B", "citation_ids": []}]})
    assert pairs.json_texts(whole) == (['He said "no".', "B"], False)
    for cut in range(len(whole)):
        texts, inside = pairs.json_texts(whole[:cut])
        assert 'He said "no".'.startswith(texts[0].rstrip("\\")) if texts else True
        assert not inside or texts
    assert pairs.json_texts(whole[:50])[1] and pairs.json_texts("") == ([], False) and pairs.json_texts("[]") == ([], False) and pairs.json_texts("nonsense") == ([], False)


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that.", "The passages found do not contain enough evidence.", "As a language model I am unable to give figures.", "I must decline.", "Je ne peux pas répondre à cette question.", "Ich kann diese Frage leider nicht beantworten.", "Lo siento, no puedo responder.", "No answer can be provided for this request.", "I would rather not comment on goodwill; please ask a qualified adviser.", "This is something the assistant is not permitted to discuss."])
def test_refusals(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["Sales declined to $5 million.", "The company is not permitted to pay dividends under the covenant.", "Goodwill could not be allocated.", "There is no evidence of impairment.", "The directors decided not to answer the claim in 2020."])
def test_no_refusals(text):
    assert not pairs.is_refusal(text)


def test_tiling():
    assert pairs.tiles("a b c d x e f g".split(), "e f g a b c d".split(), 3) == [(0, 3, 4), (5, 0, 3)]
    asked = "What was the goodwill in 2020?"
    for copy in (asked, asked.upper(), "“What was the goodwill in 2020”", "The question is: what was the goodwill in 2020...", "what  was the\ngoodwill in 2020", asked + " " + asked):
        assert pairs.copies_question(asked, copy)
    for answer in ("What was the goodwill in 2020: $5 million", "2020", "The goodwill in 2020 was $5 million", "in 2020"):
        assert not pairs.copies_question(asked, answer)


def test_languages():
    assert pairs.language("What was the goodwill in 2020?") == "en" and pairs.language("Wie hoch war der Umsatz im Jahr 2023?") == "de"
    assert pairs.language("Le montant demandé était de 5 millions en 2019") == "fr" and pairs.language("El importe solicitado fue de 475 millones en 2021") == "es"
    assert pairs.language("Nel 2023 l'importo richiesto era di 5 milioni") == "it" and pairs.language("Het gevraagde bedrag was in 2021 ongeveer 5 miljoen") == "nl"
    assert pairs.language("€5 million") is None and pairs.language("") is None and pairs.language("Сумма составила пять") == "CYRILLIC"


def test_table(spark):
    ask = "Which factor explains the change in goodwill in 2020?"
    fill = [(f"f{k}", ask, "answered", f"The change reflects higher freight rates and stricter credit checks for customers outside the union, item {k}.", None) for k in range(8)]
    rows = fill + [
        ("empty1", ask, "answered", "  -…", None), ("empty2", ask, "answered", None, None), ("empty3", ask, "answered", None, '{"status":"answered","claims":[]}'),
        ("refusal", ask, "answered", "I cannot answer that.", None), ("right refusal", ask, "insufficient_evidence", "I cannot answer that.", None), ("unknown", ask, None, "I cannot answer that.", None),
        ("copy", ask, "answered", ask.lower(), None), ("cut1", ask, "answered", "The change reflects higher freight rates for customers outside the …", None),
        ("cut2", ask, "answered", "The change reflects higher freight rates for customers", None), ("cut3", ask, "answered", "The change reflects higher frei", None),
        ("cut4", ask, "answered", None, '{"status": "answered", "claims": [{"text": "The change reflects'), ("no stop", ask, "answered", "The change reflects stricter credit checks for customers outside the union", None),
        ("language", ask, "answered", "Der Betrag lag im Jahr 2017 bei 353.5 Millionen", None), ("same language", "Wie hoch war der Umsatz im Jahr 2023?", "answered", "Der Betrag lag im Jahr 2017 bei 353.5 Millionen", None),
        ("name", ask, "answered", "The change was reported by Kalmalia Insurance plc", None), ("no question", None, "answered", "Der Betrag lag im Jahr 2017 bei 353.5 Millionen.", None), ("figure", ask, "answered", "$5", None), ("long", ask, "answered", "The change is fine. " * 5000, None),
    ]
    df = spark.createDataFrame(rows + rows[:3], "uid string, question string, expected_status string, answer string, raw_output string").selectExpr("*", "1 AS defect", "'x' AS text")
    got = {r["uid"]: r["defect"] for r in pairs.defective_pairs(df).collect()}
    assert got == {"empty1": "empty", "empty2": "empty", "empty3": "empty", "refusal": "refusal", "copy": "copied_question", "cut1": "truncated", "cut2": "truncated", "cut3": "truncated", "cut4": "truncated", "language": "other_language"}
    assert pairs.defective_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("answer,copied", [("{0} " * 9, True), ("The question is: {0} " * 9, True), ("{0} " * 400, True), ("{0} " * 9 + "What was", True), ("{0} " * 9 + "It was 5 million.", False), ("It was 5 million. " * 40, False), ("the question is " * 40, False)])
def test_question_copied_many_times(answer, copied):
    question = "What was the total revenue of the group in 2019?"
    assert pairs.copies_question(question, answer.format(question)) is copied


@pytest.mark.parametrize("text", ["1. first\n2. second\n3. and", "- sales rose.\n- costs fell.\n- margins", "1. one\n   a) sub\n   b)", "| a | b |\n|---|---|\n| 1 |", "| a | b |\n| 1 | 2", "so **bold", "the costs of A,", "it was due to …", "and more...", "between 2018 –", "see:", "~~gone"])
def test_left_open_lists_rows_and_marks(text):
    assert pairs.open_at_end(text)


@pytest.mark.parametrize("text", ["1. first\n2. second\n3. third", "- sales rose.\n- costs fell.\n- margins too.", "- a\n  - b\n  - c\n- d", "| a | b |\n|---|---|\n| 1 | 2 |", "**bold** ~~gone~~", "3*4 and 2**3", "Item 5.", "5.", "a) yes", "Sales rose.\n\nCosts fell", "well-known", "a, b; c"])
def test_closed_lists_rows_and_marks(text):
    assert not pairs.open_at_end(text)


@pytest.mark.parametrize("text", ["Revenue fell because the plant was not able to provide power.", "The bank is not permitted to provide loans above 5m.", "Sales must decline before they can rise.", "The auditors could not determine the value, so it was written off.", "Insufficient capital was the reason.", "The segment lies outside the scope of the tax rules.", "The contracts do not contain any data protection clause.", "The company refused to answer the claim.", "Management decided not to give figures."])
def test_what_others_cannot_do(text):
    assert not pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["Unfortunately, I am currently not able to provide this.", "We are unable to determine the amount.", "The documents provided do not contain enough information.", "There is insufficient evidence to say.", "I don't have access to that report.", "Unable to answer from the context.", "It is not possible for me to say.", "That is beyond what I can discuss.", "The question cannot be answered from the given passages."])
def test_more_refusals(text):
    assert pairs.is_refusal(text)


def test_the_parser_decides(spark, monkeypatch):
    """Without the parser, answers that end with something open are not found."""
    ask = "Which factor explains the change in goodwill in 2020?"
    rows = [(f"u{k}", ask, "answered", f"The change reflects {end}", None) for k, end in enumerate(["higher freight rates (mostly", "two things:\n1. freight rates\n2. and", "what it called “stricter checks", "freight rates, wages,", "**freight rates"])]
    df = spark.createDataFrame(rows, "uid string, question string, expected_status string, answer string, raw_output string")
    assert {r["defect"] for r in pairs.defective_pairs(df).collect()} == {"truncated"} and pairs.defective_pairs(df).count() == 5
    assert all(pairs.defect_of(r[1], r[3], None, "answered")[0] == "truncated" for r in rows)
    monkeypatch.setattr(pairs, "open_at_end", lambda text: [])
    assert sum(pairs.defect_of(r[1], r[3], None, "answered")[0] == "truncated" for r in rows) <= 1


@pytest.mark.parametrize("times", [1, 4, 5, 6, 7, 60])
def test_any_number_of_copies(times):
    assert pairs.copies_question("What was the goodwill in 2020?", "What was the goodwill in 2020? " * times)


def test_long_answers_are_tiled_quickly():
    words = ("the goodwill was what in 2020 " * 5000).split()
    assert sum(n for *_, n in pairs.tiles(words, "what was the goodwill in 2020".split(), 2)) > 0
    assert not pairs.copies_question("What was the goodwill in 2020?", "2020 in " * 10_000)
