import base64
import os
import random

import pytest

from quire.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    with open(encoding.VOCABULARY, "rb") as file:
        return encoding.TextEncoder(file.read())


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    with open(encoding.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "世界", "1", "23", "_", "____", "the", "ing", " ", " ", "<|endoftext|>", "🙂", "-", "ated", "…"]


def random_text(rng, most=25):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))


def test_same_as_another_library(encoder, other):
    rng = random.Random(1)
    for _ in range(2000):
        text = random_text(rng)
        assert encoder.encode(text) == other.encode_ordinary(text), repr(text)


def test_same_as_the_definition(encoder):
    rng = random.Random(2)
    own = encoder.encoder
    for _ in range(500):
        piece = bytes(rng.choice(b"etaoin shrdlu\xc3\xa9\xff\x00") for _ in range(rng.randrange(1, 14)))
        if piece not in own.ids:  # a whole pretoken of the vocabulary is its own token
            assert own.encode(piece) == [own.ids[t] for t in own.merged(piece)], piece


def test_prefixes_are_kept(encoder):
    own, last = encoder.encoder, []
    for end in range(1, 30):
        own.extend(b" unbelievably long pretokens"[:end], last)
        assert own.walk(last) == own.encode(b" unbelievably long pretokens"[:end])


def test_edits_and_appends(encoder, other):
    rng = random.Random(3)
    for _ in range(500):
        text = encoding.EncodedText(encoder, random_text(rng))
        for _ in range(3):
            start = rng.randrange(len(text.text) + 1)
            text.replace(start, min(len(text.text), start + rng.randrange(4)), random_text(rng, 4))
        text.append(random_text(rng, 4))
        assert text.ids == other.encode_ordinary(text.text)


def test_long_pretoken(encoder, other):
    text = "=" * 20000 + "ab" * 5000
    assert encoder.encode(text) == other.encode_ordinary(text)


def test_table(spark, encoder):
    rows = [(1, "Hello  world", "x"), (2, None, "y"), (3, "", None), (4, " ", "z"), (4, " ", "z"), (5, "word " * 5000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = encoding.encode_corpus(df.repartition(3))
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = sorted((r["doc_id"], r["ids"]) for r in out.collect())
    assert got == sorted((k, encoder.encode(t)) for k, t, _ in rows) and got[1][1] == [] and len(got) == 6
    assert encoding.encode_corpus(df.limit(0)).count() == 0
