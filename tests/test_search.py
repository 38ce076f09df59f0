import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.operators import fusion, lexical, vectors


def texts(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, extra int")


def test_keyword_scores(spark):
    rows = texts(spark, [("a", "Low water at the sluice came early.", 1), ("b", "High water lasted until noon.", 2), ("c", None, 3), ("d", "", 4)])
    found = lexical.top(lexical.bm25(rows, "sluice", "id"), "id", 5).collect()
    assert [r["id"] for r in found] == ["a"]
    scaled = fusion.weighted_sum(lexical.bm25(rows, "sluice", "id"), lexical.bm25(rows, "sluice", "id").limit(0), "id", 1.0, 0.0).first()
    assert scaled["score"] == 1.0
    assert lexical.bm25(rows, " ", "id").count() == 0
    assert lexical.top(lexical.bm25(rows, "sluice", "id"), "id", 0).count() == 0
    assert lexical.bm25(rows.limit(0), "sluice", "id").count() == 0


def test_full_text_scores_equal_the_engine(spark):
    rows = [(str(k), t, k) for k, t in enumerate(["Dredged channels and channelling dredgers", "Tidal forecasts", "Élan of x_y: 0.9 million", "dredging", "unrelated words here", "the dredging of the weather"])]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, t, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine here")
    db.executemany("INSERT INTO f VALUES (?, ?)", [(i, t) for i, t, _ in rows])
    for query in ("dredging", "channels tidal", "elan", "the"):
        match = " OR ".join(f'"{q}"' for q in query.split())
        wanted = {i: -s for i, s in db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        found = {r["id"]: r["score"] for r in lexical.bm25(texts(spark, rows), query, "id", floored=True, stemmed=True).collect()}
        assert found.keys() == wanted.keys(), query
        assert all(abs(found[i] - wanted[i]) < 1e-6 for i in wanted), query
    assert [(r["id"], r["hits"]) for r in lexical.phrase_hits(texts(spark, rows), "x y", "id").collect()] == [("2", 1)]


def test_batch_equals_single(spark):
    rows = texts(spark, [(str(k), t, k) for k, t in enumerate(["a b c", "a a b", "c c", None, "", "d", "a b c"])])
    queries = spark.createDataFrame([("q1", "a b"), ("q2", "C"), ("q3", "zz"), ("q4", None), ("q5", "")], "uid string, question string")
    batch = {(r["uid"], r["id"]): (r["rank"], round(r["score"], 6)) for r in lexical.search_batch(rows, queries, "id", "uid", 3).collect()}
    for uid, query in (("q1", "a b"), ("q2", "C")):
        for r in lexical.top(lexical.bm25(rows, query.lower(), "id").withColumn("score", F.round("score", 9)), "id", 3).collect():
            assert batch[uid, r["id"]] == (r["rank"], round(r["score"], 6))
    assert {u for u, _ in batch} == {"q1", "q2"}
    assert lexical.search_batch(rows, queries.limit(0), "id", "uid", 3).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id bigint, embedding array<float>")
    near = [(r["vec_id"], round(r["distance"], 6)) for r in vectors.nearest(rows.where("vec_id < 6"), [1.0, 0.0], 2).collect()]
    assert near == [(1, 0.0), (3, 0.4)]
    batch = vectors.nearest_batch(rows, rows.where("vec_id IN (1, 3, 4)"), 2).collect()
    assert sorted((r["query"], r["rank"], r["vec_id"]) for r in batch) == [(1, 1, 1), (1, 2, 3), (3, 1, 3), (3, 2, 2)]


def ranks(spark, ids):
    return spark.createDataFrame([(c, k) for k, c in enumerate(ids, 1)], "chunk_id string, rank bigint")


def test_reciprocal_ranks(spark):
    order = lambda kw, sem: [r["chunk_id"] for r in fusion.best(fusion.reciprocal_rank_fusion(ranks(spark, ["A"]), ranks(spark, ["B", "A"]), "chunk_id", kw, sem), "chunk_id", 5).orderBy("rank").collect()]
    assert order(0.5, 0.5) == ["A", "B"]
    assert order(0.0, 1.0) == ["B", "A"]
    only = fusion.reciprocal_rank_fusion(ranks(spark, []), ranks(spark, ["x", "y", "z"]), "chunk_id")
    assert [r["chunk_id"] for r in fusion.best(only, "chunk_id", 2).orderBy("rank").collect()] == ["x", "y"]
    for bad in ((-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            fusion.reciprocal_rank_fusion(ranks(spark, ["A"]), ranks(spark, ["A"]), "chunk_id", *bad)
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(ranks(spark, ["A"]), ranks(spark, ["A"]), "chunk_id", k=-1)


def test_weighted_sum_without_positive_scores(spark):
    low = spark.createDataFrame([("a", -1.0), ("b", 0.0)], "id string, score double")
    assert {r["score"] for r in fusion.weighted_sum(low, low, "id").collect()} == {0.0}


def test_hydrate_keeps_rank_gaps(spark):
    chunks = spark.createDataFrame([("c1", "d1", "t", 1, 1), ("c2", "d2", "t", 1, 2)], "id string, document_id string, text string, page_start int, page_end int")
    documents = spark.createDataFrame([("d1", "failed"), ("d2", "ready")], "id string, status string")
    names = spark.createDataFrame([(1, "d2", "old.pdf"), (2, "d2", "new.pdf")], "id bigint, document_id string, original_filename string")
    out = fusion.hydrate(ranks(spark, ["c1", "c2"]), chunks, documents, names).collect()
    assert [(r["chunk_id"], r["rank"], r["document_name"]) for r in out] == [("c2", 2, "new.pdf")]


def test_cells(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    asked, cells = rows.where("vec_id % 100 = 0"), vectors.fit_cells(rows)
    index = vectors.placed_in_cells(rows, cells)
    assert index.count() == rows.count() and len(cells) <= 1 + rows.count() ** 0.5
    near = vectors.nearest_batch(rows, asked, 10)
    key = lambda df: sorted((r["query"], r["rank"], r["vec_id"], round(r["distance"], 6)) for r in df.collect())
    assert key(vectors.nearest_in_cells(index, asked, cells, 10, None)) == key(near)
    probes = vectors.calibrated_probes(rows, index, cells, 10)
    assert probes < len(cells) and vectors.recall(vectors.nearest_in_cells(index, asked, cells, 10, probes), near).first()["recall"] >= 0.9


def test_cells_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, None]), (7, [2.0, 0.0])], "vec_id bigint, embedding array<float>")
    cells = vectors.fit_cells(rows, 2)
    index = vectors.placed_in_cells(rows, cells)
    assert sorted(r["vec_id"] for r in index.collect()) == [1, 2, 7]
    got = vectors.nearest_in_cells(index, rows.where("vec_id IN (1, 3)"), cells, 2, None).collect()
    assert sorted((r["query"], r["rank"], r["vec_id"], r["distance"]) for r in got) == [(1, 1, 1, 0.0), (1, 2, 7, 0.0)]
    none = vectors.fit_cells(rows.limit(0))
    assert len(none) == 0 and vectors.nearest_in_cells(vectors.placed_in_cells(rows, none), rows, none, 2, None).count() == 0
