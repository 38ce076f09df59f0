import random

from quire.llm import leakage

WORDS = [f"w{k}" for k in range(400)]


def passage(rng, n=80):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_occurrences_like_brute_force():
    rng = random.Random(1)
    tables = leakage.Passages([("a", passage(rng, 30)), ("b", passage(rng, 30)), ("short", "one two three")])
    tables.length == leakage.LENGTH
    for _ in range(30):
        words = [rng.choice(WORDS) for _ in range(40)] + tables.words[rng.randrange(2)][3:17] + ["one", "two", "three"] + [rng.choice(WORDS) for _ in range(10)]
        wanted = set()
        for p, own in enumerate(tables.words):
            size = min(leakage.LENGTH, len(own))
            for at in range(len(own) - size + 1):
                wanted |= {(p, at, k) for k in range(len(words) - size + 1) if words[k : k + size] == own[at : at + size]}
        assert set(tables.occurrences(words)) == wanted


def test_stock_phrases_are_no_leaks():
    """They are test strings of all their passages; laid along the document, what they find is too short."""
    stock = "this report contains statements about the future that involve risks"
    rng = random.Random(4)
    tables = leakage.Passages([("a", stock + " " + passage(rng, 30)), ("b", passage(rng, 30) + " " + stock)])
    assert {p for p, _, _ in tables.occurrences(stock.split())} == {0, 1}
    assert tables.leaks((passage(rng, 20) + " " + stock + " " + passage(rng, 20)).split()) == {}


def test_passages_within_others():
    rng = random.Random(5)
    text = passage(rng, 23)
    tables = leakage.Passages([("u1", text), ("u2", text + " more"), ("u3", "two words " + text)])
    assert set(tables.leaks((passage(rng, 30) + " " + text + " " + passage(rng, 30)).split())) == {"u1", "u2", "u3"}


def test_every_sixth_and_fifth_word_changed():
    rng = random.Random(6)
    for n, every in ((23, 6), (23, 5), (90, 6), (90, 5)):
        words = passage(rng, n).split()
        tables = leakage.Passages([("u", " ".join(words))])
        copy = [("zzz" if k % every == every - 1 else w) for k, w in enumerate(words)]
        assert set(tables.leaks(passage(rng, 40).split() + copy + passage(rng, 40).split())) == {"u"}


def test_blocks_of_passages(spark):
    rng = random.Random(7)
    texts = [passage(rng, 30) for _ in range(7)]
    assert [len(b) for b in leakage.blocks_of([("u", t) for t in texts], 65)] == [2, 2, 2, 1] and list(leakage.blocks_of([])) == []
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    passages = [(f"u{k}", t) for k, t in enumerate(texts)]
    assert sorted(map(tuple, leakage.leaking(docs, passages, most=65).collect())) == sorted(map(tuple, leakage.leaking(docs, passages).collect())) == [(k, f"u{k}", 1.0) for k in range(7)]


def test_what_leaks():
    rng = random.Random(2)
    text = passage(rng, 100)
    tables = leakage.Passages([("item", text), ("other", passage(rng, 100))])
    words = text.split()
    around = lambda part: passage(rng, 50) + " " + part + " " + passage(rng, 50)
    held = lambda part: tables.leaks(leakage.normal_words(around(part)))
    assert set(held(text)) == {"item"}
    assert set(held(" ".join(words[20:75]))) == {"item"}
    assert held(" ".join(words[20:55])) == {}  # a third
    changed = [("zzz" if k % 17 == 5 else w) for k, w in enumerate(words)]
    assert set(held(" ".join(changed))) == {"item"}
    gaps = [w for k, w in enumerate(words) if k % 23 != 7]
    assert set(held(" ".join(gaps))) == {"item"}
    assert set(held(text.upper().replace(" ", "\n", 30))) == {"item"}
    assert held(" ".join(sorted(words))) == {}
    assert held(" ".join(words[:25]) + " " + passage(rng, 40) + " " + " ".join(words[60:85])) == {}  # not together


def test_forms_of_characters():
    assert leakage.normal_words("Short-term, 24,048 “Ｗords” hеre…") == ["shortterm", "24048", "words", "here"]


def test_table(spark):
    rng = random.Random(3)
    text = passage(rng, 60)
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (4, passage(rng, 5000), 0), (5, "x " * 20000 + text, 0)], "doc_id bigint, text string, uid int")
    out = leakage.leaking(docs, [("u", text), ("u", passage(rng, 60)), ("v", text)])
    assert sorted((r["doc_id"], r["uid"], r["held"]) for r in out.collect()) == [(1, "u", 1.0), (1, "v", 1.0), (5, "u", 1.0), (5, "v", 1.0)]
    assert leakage.leaking(docs.limit(0), [("u", text)]).count() == 0 and leakage.leaking(docs, []).count() == 0
