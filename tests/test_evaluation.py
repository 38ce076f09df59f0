import math

import pytest

from quire.operators import evaluation

RANKED = "query_id string, chunk_id string, rank int"


def test_modes(spark):
    keyword = spark.createDataFrame([("q", f"k{k}", k) for k in range(1, 13)], RANKED)
    semantic = spark.createDataFrame([("q", "k3", 1), ("q", "s1", 2)], RANKED)
    rows = evaluation.mode_rankings(keyword, semantic, limit=10).collect()
    by = {m: [r["chunk_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["mode"] == m] for m in evaluation.MODES}
    assert len(by["keyword"]) == 10 and by["semantic"] == ["k3", "s1"] and by["hybrid"][:3] == ["k3", "k1", "k2"] and len(by["hybrid"]) == 10
    grades = spark.createDataFrame([("q", "s1", 2), ("q", "k9", 1), ("none", "x", 0)], "query_id string, chunk_id string, grade int")
    got = {r["mode"]: r for r in evaluation.mode_metrics(evaluation.mode_rankings(keyword, semantic), grades).collect()}
    assert set(got) == set(evaluation.MODES) and got["semantic"]["mrr"] == 0.5 and math.isclose(got["keyword"]["mrr"], 1 / 9) and got["keyword"]["evidence_hit_10"] == 0
    assert (got["hybrid"]["relevant_chunks"], got["hybrid"]["evidence_chunks"]) == (2, 1)
    with pytest.raises(ValueError):
        evaluation.mode_metrics(keyword, grades, strict=True)
    assert evaluation.mode_metrics(evaluation.mode_rankings(keyword.limit(0), semantic.limit(0)), grades).count() == 3


def test_padding(spark):
    ranked = spark.createDataFrame([("q", "a", 1, 0), ("q", "b", 2, 2), ("whole", "c", 1, 1)], RANKED + ", grade int")
    counts = spark.createDataFrame([("q", 4, 2), ("whole", 1, 0), ("unseen", 2, 1)], "query_id string, relevant_chunks bigint, evidence_chunks bigint")
    got = {r["query_id"]: r for r in evaluation.padded_metrics(ranked, counts).collect()}
    assert got["q"]["recall_3"] == 0.25 and got["q"]["mrr"] == 0.5 and got["whole"]["ndcg"] == 1.0 and got["unseen"]["mrr"] == 0
    ideal = 3 + 3 / math.log2(3) + 1 / 2 + 1 / math.log2(5)
    assert math.isclose(got["q"]["ndcg"], 3 / math.log2(3) / ideal)


def test_rerank(spark):
    ranked = spark.createDataFrame([("q", "a", "d", 1, 1, 1, 0), ("q", "b", "d", 2, 3, 2, 1), ("r", "a", "d", 1, 1, 1, 1)], "query_id string, chunk_id string, document_id string, page_start int, page_end int, rank int, grade int")
    counts = spark.createDataFrame([("q", 1, 0), ("r", 1, 0), ("s", 1, 1)], "query_id string, relevant_chunks bigint, evidence_chunks bigint")
    named = spark.createDataFrame([("q",), ("r",)], "query_id string")
    matches = spark.createDataFrame([("q", "d", 3)], "query_id string, document_id string, page_number int")
    rows = evaluation.rerank_evaluation(ranked, named, matches, counts)
    got = {r["query_id"]: (r["has_entities"], r["has_matches"], r["changed"], r["mrr"], r["new_mrr"]) for r in rows.collect()}
    assert got == {"q": (True, True, True, 0.5, 1.0), "r": (True, False, False, 1.0, 1.0), "s": (False, False, False, 0.0, 0.0)}
    total = evaluation.query_coverage(rows).first()
    assert (total["queries"], total["with_entities"], total["with_matches"], total["rankings_changed"], total["mrr"], total["mrr_delta"]) == (3, 2, 1, 1, 0.5, pytest.approx(1 / 6))


def test_contexts(spark):
    asked = spark.createDataFrame([("in", "d", [4, 9]), ("out", "d", [5]), ("no pages", "d", []), ("no document", None, [1])], "query_id string, document_id string, relevant_pages array<int>")
    contexts = spark.createDataFrame([("in", "d", 8, 9), ("in", "e", 4, 4), ("out", "d", 1, 4), ("out", "e", 5, 5), ("no document", "d", 1, 1)], "query_id string, document_id string, page_start int, page_end int")
    assert {r["query_id"]: r["context_expected_status"] for r in evaluation.context_expectations(asked, contexts).collect()} == {"in": "answered", **dict.fromkeys(("out", "no pages", "no document"), "insufficient_evidence")}


def test_gold_and_unanswerable(spark):
    asked = spark.createDataFrame([("u1", "d1", "how deep"), ("u2", "d2", "how wide"), ("u3", "gone", "x")], "uid string, document_uid string, question string")
    gold = spark.createDataFrame([("u1", "how deep", "9 m"), ("u2", "how WIDE", "40 m")], "uid string, question string, answer string")
    known = spark.createDataFrame([("d1",), ("d2",), ("d2",)], "document_uid string")
    assert {r["uid"]: (r["answer"], r["agrees"]) for r in evaluation.with_gold(asked, gold, known, strict=False).collect()} == {"u1": ("9 m", True), "u2": ("40 m", False)}
    for wrong in (asked.where("uid = 'u2'"), asked.where("uid IN ('u1', 'u3')")):
        with pytest.raises(ValueError):
            evaluation.with_gold(wrong, gold, known)
    assert evaluation.with_gold(asked.where("uid = 'u1'"), gold, known).count() == 1
    rows = {r["uid"]: r for r in evaluation.with_unanswerable(asked, [("n1", "who swam")]).collect()}
    assert rows["n1"]["expected_status"] == "insufficient_evidence" and rows["n1"]["document_uid"] is None and rows["u1"]["expected_status"] == "answered"


def test_strata_and_types(spark):
    spans = "passage_id string, label string, start bigint, end bigint"
    refs = spark.createDataFrame([("p", "PERSON", 0, 3), ("p", "PERSON", 0, 3), ("r", "PERSON", 5, 9)], spans)
    preds = spark.createDataFrame([("p", "PERSON", 0, 3), ("p", "LOCATION", 4, 6)], spans)
    strata = spark.createDataFrame([("p", "prose"), ("r", "table"), ("z", "blank")], "passage_id string, stratum string")
    assert {r["stratum"]: (r["true_positives"], r["false_positives"], r["false_negatives"], r["precision"]) for r in evaluation.strict_by_stratum(refs, preds, strata).collect()} == {"prose": (1, 1, 0, 0.5), "table": (0, 0, 1, 0.0)}
    results = spark.createDataFrame([("a", "answered", 1.0), ("b", "answered", 0.0), ("c", "insufficient_evidence", 1.0), ("d", "answered", 0.5)], "uid string, expected_status string, reference_coverage double")
    manifest = spark.createDataFrame([("a", "span"), ("b", "span"), ("b", "span"), ("c", "span"), ("d", None)], "uid string, answer_type string")
    assert [tuple(r) for r in evaluation.coverage_by(results, manifest).collect()] == [("span", 2, 0.5)]
