import random

import numpy as np

from quire.llm import stuffing

KEYS = ["share tips", "payroll app", "toner refill", "penny stocks", "cash advance", "balance sheet template"]
EXTRA = "cheap best buy online free top new fast instant trusted download compare".split()
NAMES = ["ka", "lo", "mi", "zor", "ven", "tar", "bul", "dex"]


PATTERNS = (
    "The {} in {} of the group was due to {} in {}, and it is likely that the board will revise its plans.",
    "We do not think that {} of {} will last beyond {}, as {} has shown.",
    "A part of what was paid for {} has been set against {}; the rest will follow when {} of {} is known.",
    "Auditors asked why {} had not been told apart from {} before {} came to {}.",
    "Nobody on the board expected {} to move faster than {}, least of all {} and {}.",
    "Before {} we had planned for {}, yet {} left us with {} instead.",
    "It was only under {} that {} could be agreed with those who run {} and {}.",
    "Some of our customers wrote to say that {} matters more to them than {}, {} or {}.",
)
THINGS = "decrease,increase,sales,costs,goodwill,late harvests,higher freight rates,new hires,the spring,the third quarter,two of the depots,a milder winter,older vessels,the pension plan,bank fees,our lenders,the strike in June,three wind farms,spare parts,the northern sites,water rights,a change of law,the merger,staff training".split(",")


def sentence(rng):
    return rng.choice(PATTERNS).format(*rng.sample(THINGS, 4))


def spam(rng, kind):
    items = [f"{rng.choice(EXTRA)} {rng.choice(KEYS)}" for _ in range(60)]
    return {
        "commas": ", ".join(items), "bare": " ".join(rng.choice(KEYS) for _ in range(80)), "pipes": " | ".join(k.title() for k in items), "tags": " ".join("#" + "".join(w.title() for w in i.split()) for i in items),
        "links": "\n".join(f"https://{i.replace(' ', '-')}.example/{rng.randrange(99)}" for i in items), "html": "".join(f'<li><a href="http://x.example/p{rng.randrange(999)}">{i}</a></li>' for i in items), "joined": ";".join(i.replace(" ", "+") for i in items),
    }[kind]


KINDS = ("commas", "bare", "pipes", "tags", "links", "html", "joined")


def corpus():
    rng = random.Random(1)
    prose = lambda n: " ".join(sentence(rng) for _ in range(n))
    name = lambda: "".join(rng.choice(NAMES) for _ in range(4)).title()
    bad = [spam(rng, kind) for kind in KINDS for _ in range(4)] + [prose(1) + "\n" + spam(rng, "commas")]
    good = [prose(rng.randrange(2, 15)) for _ in range(120)]
    good += [prose(8) + "\nTags: share tips, payroll app, toner refill", prose(6) + " See https://ir.example.example/reports/2014"]
    good += ["\n".join(f"Net revenue {rng.randrange(999)}.{rng.randrange(9)} {rng.randrange(999)} ({rng.randrange(99)}" for _ in range(40))]
    good += [prose(1) + "\n" + "\n".join(f"{k}. {name()} {name()} Holdings Ltd, {rng.randrange(99)}% held" for k in range(40))]
    good += ["When we speak of goodwill, we mean the goodwill shown in the table, and goodwill of joint ventures is left out. " * 8]
    return bad, good


def around(spark):
    """Documents of a test table, whose counts tell what is common in such texts."""
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 100000 AS doc_id", "text", "'' AS links")


def test_found(spark):
    bad, good = corpus()
    rows = [(k, t, "x") for k, t in enumerate(bad + good)] + [(0, bad[0], "x"), (10_000, None, "x"), (10_001, "", "x"), (10_002, " \n", "x"), (10_003, "share tips " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, links string").unionAll(around(spark))
    got = [r["doc_id"] for r in stuffing.stuffed(docs).collect() if r["doc_id"] < 100_000]
    assert sorted(got) == [*range(len(bad)), 10_003]


def test_other_languages_are_no_listings(spark):
    text = "Совет директоров считает, что снижение выручки связано с поздним урожаем, но оно не повлияет на планы группы. Когда договор изменён, расходы признаются сразу, если только срок аренды не продлён до конца года."
    docs = spark.createDataFrame([(1, text, "")], "doc_id bigint, text string, links string").unionAll(around(spark))
    assert stuffing.stuffed(docs).where("doc_id = 1").count() == 0


def test_information_decides(spark):
    """Without the information of neighbouring words, other pages come out."""
    bad, good = corpus()
    known = stuffing.learned(stuffing.pair_counts(around(spark)))
    rows = np.array([f for t in bad + good if (f := stuffing.window_features(*stuffing.words_of(t), known)) is not None])
    blind = rows.copy()
    blind[:, :3] = stuffing.CENTRE[:3]
    assert (stuffing.is_stuffing(rows) != stuffing.is_stuffing(blind)).sum() > 5


def test_fit():
    rng = np.random.default_rng(1)
    rows = rng.normal(stuffing.CENTRE, stuffing.SCALE, (400, len(stuffing.CENTRE)))
    labels = (rows[:, 0] > stuffing.CENTRE[0]).astype(float)
    assert ((stuffing.quadratic(rows) @ stuffing.fit(rows, labels) > 0) == labels).mean() > 0.97


def test_counts_are_of_all_documents(spark):
    docs = spark.createDataFrame([("the cat sat",), ("the cat 5 sat",), (None,)], "text string")
    assert sorted(map(tuple, stuffing.pair_counts(docs).collect())) == [("cat", "sat", 2), ("the", "cat", 2)]
    assert stuffing.pair_counts(docs.limit(0)).count() == 0


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert stuffing.stuffed(docs).count() == 0
    assert stuffing.stuffed(spark.createDataFrame([(1, "1 2 3"), (2, "word")], "doc_id bigint, text string")).count() == 0
