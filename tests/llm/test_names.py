import random

import pytest

from quire.llm import names


def one_error(a, b):
    if a == b:
        return False
    out = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    letters = "abcdefghij"
    out |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters}
    return b in out


def test_trie_join_like_brute_force(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))) for _ in range(150)}
    for w in list(words)[:100]:
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdefghij") + w[k:], w[:k] + rng.choice("abcdefghij") + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]]))
    words = {w for w in words if len(w) >= 4}
    df = spark.createDataFrame([("x", w) for w in words] + [("y", "abcd"), ("y", "abc")], "kind string, word string")
    got = {(r["a"], r["b"]) for r in names.near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_error(a, b)}
    assert names.near_words(df.limit(0)).count() == 0


def test_automaton():
    trie = names.trie_of(["berg", "breg", "ber", "burg", "bergs", "b", "rebg"])
    assert set(names.Automaton("berg").walk(trie)) == {"berg", "breg", "ber", "burg", "bergs"}


@pytest.mark.parametrize(
    "name,read",
    [
        ("ostrevalle maritime holdings limited", ("ostrevalle", "holdings maritime", "ltd", "")),
        ("asset management tordisara plc", ("tordisara", "asset management", "plc", "")),
        ("the tordisara asset management public limited company", ("tordisara", "asset management", "plc", "")),
        ("norzekura-telecom co.", ("norzekura", "telecom", "co", "~")),
        ("yardasegen plc", ("yardasegen", "", "plc", "")),
        ("dorlovenix", ("dorlovenix", "", "", "")),
        ("torburoven transport & logistics inc.", ("torburoven", "logistics transport", "inc", "")),
        ("international", ("international", "", "", "")),
    ],
)
def test_organisations(name, read):
    assert names.read_organisation(name) == read


def test_people():
    assert names.read_person("dr deborah k. lorgenuss") == ["deborah", "lorgenuss"] and names.read_person("lorgenuss, d.") == ["lorgenuss", "d.", ","]
    assert names.read_person("a.n. parmokorsen") == ["a.", "parmokorsen"] and names.read_person("madonna") == ["madonna"] and names.read_person("") == []


def linked(spark, label, spelled):
    df = spark.createDataFrame([(label, n, "x", k) for k, (n, count) in enumerate(spelled) for _ in range(count)], "label string, normalized_text string, entity string, id int")
    return {(r["name_a"], r["name_b"]) for r in names.same_entity_pairs(df).collect()}


def groups(*sets):
    return {(a, b) for s in sets for a in s for b in s if a < b}


def test_variants_of_people(spark):
    jon = ["jonathan dorveloford", "jon dorveloford", "jon. dorveloford", "j. dorveloford", "dorveloford, j.", "jonathan droveloford", "dorveloford jonathan", "dr jonathan b. dorveloford", "jonаthan dorveloford"]
    peg = ["margaret prasibomann", "peggy prasibomann", "prasibomann, margaret", "m. prasibomann"]
    other = ["james gelzutass", "johannes gelzutass", "j. gelzutass"]  # one initial, two people
    ursula = ["ursula prasibomann", "ursula sellavundt"]  # one first name, two families
    spelled = [(n, 3) for n in jon[1:] + peg[1:] + other + ursula] + [(jon[0], 9), (peg[0], 9), ("johannes kaldoford", 3), ("jonathan salpesax", 3), ("margaret kaldoford", 2)]
    assert linked(spark, "PERSON", spelled) == groups(jon, peg)


def test_variants_of_organisations(spark):
    one = ["kalfidocon pharmaceuticals company", "kalfidocon pharma", "kalfidocon pharmaceuticals, co.", "kallfidocon pharmaceuticals co.", "pharmaceuticals kalfidocon co."]
    two = ["kalfidocon associates public limited company", "kalfidocon assoc plc"]
    hot = ["ostrevalle maritime holdings limited", "ostrevalle maritime", "ostrevale maritime holdings", "ostrevalle marit. hldgs", "ostrevalle"]
    spelled = [(n, 3) for n in one + two + hot + ["kalfidocon", "geltazutron holdings ltd", "geltazutron manufacturing ltd"]] + [(one[0], 9), (hot[0], 50)]
    assert linked(spark, "ORGANIZATION", spelled) == groups(one, two, hot)


def test_nothing_to_link(spark):
    df = spark.createDataFrame([("PERSON", None), ("PERSON", ""), ("PERSON", " "), ("LOCATION", "a b"), ("LOCATION", "b a"), ("ORGANIZATION", "., -"), (None, "x y"), ("PERSON", "z" * 3000)], "label string, normalized_text string")
    assert names.same_entity_pairs(df).count() == 0 and names.same_entity_pairs(df.limit(0)).count() == 0


def test_long_chains_have_one_root(spark):
    nodes = spark.createDataFrame([(k,) for k in range(100)], "k int")
    edges = spark.createDataFrame([(k, (k + 1,), k + 1) for k in range(99)], "k int, to struct<k:int>, to_weight int")
    assert {r["root"]["k"] for r in names._led(nodes, edges, ["k"]).collect()} == {99}


def test_shards_meet():
    """Any word and any other one error away share a shard, split ones too."""
    import random

    rng = random.Random(3)
    letters = "abcdefgh"
    for _ in range(4000):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 22)))
        k, kind = rng.randrange(len(word)), rng.randrange(4)
        other = (word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :])[kind]
        if len(other) < 4:
            continue
        common = set(names.shards(word)) & set(names.shards(other))
        assert common, (word, other)
        halves = {s for s in common if s[0] != "="}
        assert not halves or any(set(names.split_shard(word, s)) & set(names.split_shard(other, s)) for s in halves), (word, other)
        assert all(len(s) > 3 for s in names.shards(word))


def test_split_shards_give_the_same(spark):
    words = ["montgomery" + a + b for a in "abcdef" for b in "uvwxyz"] + ["mont", "monty", "month", "mouth"]
    df = spark.createDataFrame([("family", w) for w in words], "kind string, word string")
    whole = set(map(tuple, names.near_words(df).collect()))
    assert whole == set(map(tuple, names.near_words(df, most=5).collect())) and ("family", "mont", "month") in whole and ("family", "montgomeryau", "montgomeryav") in whole


def test_entities_and_pairs_agree(spark):
    rows = [("PERSON", n) for n in ("Ana Belmar", "ana belmar", "Belmar, Ana", "Ana Bellmar", "Rui Costa", None, " ")] + [("ORGANIZATION", n) for n in ("Kordan Bank plc", "Kordan Bank", "KORDAN BANK PLC")]
    df = spark.createDataFrame(rows, "label string, normalized_text string")
    linked = {(r["label"], r["name"]): r["entity"] for r in names.linked_names(df).collect()}
    pairs = {(r["label"], r["name_a"], r["name_b"]) for r in names.same_entity_pairs(df).collect()}
    assert pairs == {(a[0], a[1], b[1]) for a in linked for b in linked if a[0] == b[0] and linked[a] == linked[b] and a[1] < b[1]} and len(pairs) == 9
