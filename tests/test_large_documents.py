"""A document of many chunks and many judgments: their pairs are counted, but not made one by one."""

import random
import re
from collections import Counter

import pytest

from quire.operators import metrics
from quire.plans import catalog

duckdb = pytest.importorskip("duckdb")


def rows_made(spark, run):
    """The result of `run` and the most rows that any step of its plans gave."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsList().size()
    result = run()
    bus.waitUntilEmpty()
    executions = store.executionsList()
    shown = [store.planGraph(e.executionId()).makeDotFile(store.executionMetrics(e.executionId())) for e in (executions.apply(k) for k in range(before, executions.size()))]
    return result, max(int(n.replace(",", "")) for text in shown for n in re.findall(r"number of output rows: ([\d,]+)", text))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng, size = str(tmp_path_factory.mktemp("large")), random.Random(3), 300
    said = lambda p: " ".join(f"Firm {rng.choice('abcdefgh')}{rng.randrange(p - 2, p + 3)} said" for _ in range(4))
    chunks = [(f"c{k}", "large", said(k // 2), k // 2, k // 2 + k % 3) for k in range(size)] + [(f"s{k}", f"d{k}", said(1), 1, 1) for k in range(20)] + [("none", "large", None, None, 4)]
    names = [(c, p) for p in range(size // 2) for c in "ab"] + [(c, p + 40) for p in range(0, size // 3) for c in "ab"]
    mentions = [(n, "large", p, "ORGANIZATION", f"FIRM\n{c}{n % 150}", f"firm {c}{n % 150} {n}") for n, (c, p) in enumerate(names)] + [(1000 + k, f"d{k // 2}", 1, "ORGANIZATION", "Firm a1", f"firm a{k}") for k in range(40)] + [(2000, "large", 7, "ORGANIZATION", "--", "dash"), (2001, "large", 7, "ORGANIZATION", "Firm", None), (2002, "absent", 7, "ORGANIZATION", "Firm", "firm")]
    mentions += [(m[0], m[1], m[2] + 1, *m[3:]) for m in mentions[::3]] + mentions[::7]
    spark.createDataFrame(chunks, "id string, document_id string, text string, page_start int, page_end int").write.parquet(f"{path}/chunks.parquet")
    spark.createDataFrame(mentions, "id bigint, document_id string, page_number int, label string, text string, normalized_text string").write.parquet(f"{path}/entity_mentions.parquet")
    return path


@pytest.mark.parametrize("name", ["relevance_grades", "paired_rr_summary", "retrieval_metrics"])
def test_pairs_are_not_made(spark, folder, name):
    got, most = rows_made(spark, lambda: catalog.queries()[name](spark, folder).toPandas())
    db = duckdb.connect()
    for t in ("chunks", "entity_mentions"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    wanted = db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(map(tuple, got[list(wanted.columns)].round(5).values.tolist())) == sorted(map(tuple, wanted.round(5).values.tolist()))
    pairs = db.execute("SELECT (SELECT count(*) FROM chunks WHERE document_id = 'large') * (SELECT count(DISTINCT normalized_text) FROM entity_mentions WHERE document_id = 'large')").df().iloc[0, 0]
    assert pairs > 100_000 and most < 20_000


def test_relevant_chunks_are_those_of_a_grade(spark):
    """Against all pairs: chunks of any span (a billion pages, none, reversed), delivered twice, pages below zero, nulls."""
    rng = random.Random(5)
    page = lambda: rng.choice([None, *range(-9, 40)])
    chunks = [(f"c{k}", rng.choice(["x", "y", None]), rng.choice(["a b", "B-c d", None, ""]), s, None if s is None else s + rng.choice([0, 0, 1, 2, 5, 17, 10**9, -1])) for k in range(150) for s in [page()]]
    judged = [(f"q{k}", rng.choice(["x", "y", "z", None]), rng.choice([None, [], [page() for _ in range(rng.randrange(1, 7))]]), rng.choice([None, [], ["A  b", None], ["c D", "--"]])) for k in range(60)]
    chunks = spark.createDataFrame(chunks + chunks[::9], "id string, document_id string, text string, page_start int, page_end int")
    judged = spark.createDataFrame(judged, "query_id string, document_id string, relevant_pages array<int>, evidence_texts array<string>")
    every = Counter(map(tuple, metrics.relevance_grades(chunks, judged).collect()))
    assert Counter(map(tuple, metrics.relevant_chunks(chunks, judged).collect())) == Counter({r: n for r, n in every.items() if r[2] > 0}) and len(every) > 1000
    counts = Counter()
    for r, n in every.items():
        counts[r[2]] += n
    assert dict(map(tuple, metrics.grade_counts(chunks, judged).collect())) == dict(counts) and set(counts) == {0, 1, 2}
    assert metrics.grade_counts(chunks.limit(0), judged).count() == metrics.grade_counts(chunks, judged.limit(0)).count() == 0


def test_measures_of_graded_ranks(spark):
    rng = random.Random(7)
    rows = [(f"q{q}", f"m{r}", r, rng.choice([0, 0, 1, 2]) if q else 0) for q in range(30) for r in range(1, rng.randrange(2, 25))]
    rows = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, grade int")
    short = lambda df: sorted([x if x is None or isinstance(x, str) else round(x, 9) for x in r] for r in df.collect())
    assert short(metrics.graded_ranking_metrics(rows)) == short(metrics.ranking_metrics(rows.drop("grade"), rows.drop("rank")))
    with pytest.raises(ValueError):
        metrics.graded_ranking_metrics(rows, (0,))
