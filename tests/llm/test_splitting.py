import random

import pytest
from pyspark.sql import functions as F

from quire.llm import splitting


def pieces(spark, texts, **limits):
    df = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "id int, text string, pieces string")
    return {r["id"]: r["pieces"] for r in splitting.split_texts(df, ["id"], **limits).collect()}


def check(text, found, words, chars, overlap):
    assert found, text
    covered = 0
    for n, p in enumerate(found):
        assert text[p["start"] : p["end"]] == p["text"]
        assert len(p["text"].split()) <= words and len(p["text"]) <= chars
        assert not text[covered : p["start"]].strip() or p["start"] <= covered
        assert p["end"] > covered or n == 0
        if n:
            assert p["overlap_words"] <= overlap and p["start"] <= covered or not text[covered : p["start"]].strip()
        covered = p["end"]
    assert not text[covered:].strip()


def test_limits_hold_and_nothing_is_lost(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        parts = [rng.choice(["word", "a", "long-er,", "end.", "“Quote.”", "😀é́", "x" * rng.randrange(1, 90)]) + rng.choice([" ", " ", " ", "\n", "\n\n", " ", "\t", "  "]) for _ in range(rng.randrange(1, 120))]
        texts.append("".join(parts))
    for words, chars, overlap in ((10, 60, 3), (120, 1200, 20), (7, 400, 0), (20, 50, 19)):
        found = pieces(spark, texts, max_words=words, max_chars=chars, overlap_words=overlap)
        for k, text in enumerate(texts):
            if len(text.split()) <= words and len(text) <= chars:
                assert [(p["start"], p["end"], p["text"]) for p in found[k]] == [(0, len(text), text)]
            else:
                check(text, found[k], words, chars, overlap)


def test_overlap_is_whole_where_words_allow(spark):
    text = " ".join(f"w{k}" for k in range(300))
    found = pieces(spark, [text])[0]
    assert [p["overlap_words"] for p in found] == [0] + [20] * (len(found) - 1)
    assert found[1]["text"].split()[:20] == found[0]["text"].split()[-20:]


def test_natural_boundaries_first(spark):
    sentences = " ".join(f"This is sentence number {k} of the long text." for k in range(60))
    assert all(p["text"].endswith(".") for p in pieces(spark, [sentences])[0])
    paragraphs = "\n\n".join("some words without a stop " * 12 for _ in range(6))
    assert all(p["text"].endswith("stop") for p in pieces(spark, [paragraphs])[0])


def test_long_word_and_odd_texts(spark):
    found = pieces(spark, ["=" * 5000, None, "", "   ", "x", " " * 3000])
    assert [len(p["text"]) for p in found[0]] and max(len(p["text"]) for p in found[0]) <= 1200 and "".join(p["text"] for p in found[0]) == "=" * 5000
    assert found[1] is None and found[2][0]["text"] == "" and found[3][0]["text"] == "   " and found[4][0]["text"] == "x" and len(found[5]) == 1


@pytest.mark.parametrize("limits", [{"max_words": 5, "overlap_words": 5}, {"overlap_words": -1}, {"max_chars": 1}])
def test_wrong_limits(limits):
    with pytest.raises(ValueError):
        splitting._check(**{"max_words": 120, "max_chars": 1200, "overlap_words": 20, **limits})


def test_found_items(spark):
    long = " ".join(["w"] * 121)
    blocks = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, " ".join(["w"] * 120), 1), (3, None, 1), (4, "y" * 1201, 1), (5, " ".join(["w"] * 121), 1)], "id bigint, text string, item_id int")
    chunks = spark.createDataFrame([("c", long, None), ("d", "", 2)], "id string, text string, item_kind int")
    got = sorted(map(tuple, splitting.oversized_items(blocks, chunks).collect()))
    assert got == [("block", "1"), ("block", "4"), ("block", "5"), ("chunk", "c")]
    rows = splitting.piece_rows(blocks, chunks)
    assert rows.where("item_id = '1'").count() == 2 and rows.where("item_id = '3'").count() == 0
    assert splitting.oversized_items(blocks.limit(0), chunks.limit(0)).count() == 0
    assert splitting.piece_rows(blocks, chunks).agg(F.max(F.length("text"))).first()[0] <= 1200


def test_found_by_the_limits(spark):
    texts = {"spaces around": " " * 400 + "word " * 100 + " " * 400, "blank": " " * 1201, "at the limit": "a" * 1200, "long": "a" * 1201, "words": "a " * 121, "null": None}
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    found = [tuple(r) for r in splitting.oversized_items(rows.limit(0), rows.unionAll(rows)).collect()]
    assert sorted(found) == [("chunk", "blank"), ("chunk", "long"), ("chunk", "spaces around"), ("chunk", "words")]


def test_rows_delivered_again(spark):
    rows = spark.createDataFrame([("block", "1", "a"), ("block", "1", "a"), ("block", "2", None), ("chunk", "1", "b")], "item_kind string, item_id string, text string")
    for most in (0, 10):
        assert sorted(splitting.once_each(rows, ["item_kind", "item_id"], most).collect(), key=str) == [("block", "1", "a"), ("block", "2", None), ("chunk", "1", "b")]


def test_found_by_the_splitting(spark, monkeypatch):
    """An item is found because the splitting cuts it: without the cuts at words, those of too many words are not."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["w", "a b", "x" * rng.randrange(1, 200), "end.\n\n", " " * rng.randrange(1, 90), " ", "é́", "\t"]) + rng.choice(["", " "]) for _ in range(rng.randrange(260))) for _ in range(200)]
    texts += [" " * 1201, " " * 1200, "a" * 1201, "a" * 1200, "a " * 120 + "a", "a " * 120, " " * 1100 + "a" + " " * 100, ""]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")
    wanted = {str(k) for k, t in enumerate(texts) if len(t) > 1200 or len(t.split()) > 120}
    found = lambda: {r["item_id"] for r in splitting.oversized_items(rows.limit(0), rows).collect()}
    assert found() == wanted
    monkeypatch.setattr(splitting, "word_pattern", lambda most: r"(?s).+")
    assert str(texts.index("a " * 120 + "a")) in wanted - found()
