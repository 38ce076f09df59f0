import math

import pytest
from pyspark.sql import functions as F

from quire.operators import entities, generation, metrics


def test_relevance(spark):
    said = "Berth fees rose by 3.75 percent after the dredging."
    chunks = spark.createDataFrame([("elsewhere", "harbour", said, 5, 6), ("page before", "port", said, 3, 4), ("page only", "port", "Cranes were painted.", 6, 7), ("both", "port", said, 4, 5)], "id string, document_id string, text string, page_start int, page_end int")
    judged = spark.createDataFrame([("fees", "port", [5, 6], ["3.75 PERCENT", "  "])], "query_id string, document_id string, relevant_pages array<int>, evidence_texts array<string>")
    assert {r["chunk_id"]: r["grade"] for r in metrics.relevance_grades(chunks, judged).collect()} == {"page before": 0, "page only": 1, "both": 2}


def test_ranking(spark):
    grades = spark.createDataFrame([("q", "m1", 2), ("q", "m2", 2), ("q", "m3", 1), ("q", "m4", 0), ("empty", "m1", 0), ("loose", "m5", 1)], "query_id string, chunk_id string, grade int")
    ranked = spark.createDataFrame([("q", "m3", 1), ("q", "m4", 2), ("q", "m1", 3), ("empty", "m1", 1), ("loose", "m9", 1)], "query_id string, chunk_id string, rank int")
    rows = {r["query_id"]: r for r in metrics.ranking_metrics(ranked, grades, (1, 3)).collect()}
    q = rows["q"]
    assert [q[c] for c in ("hit_1", "evidence_hit_1", "hit_3", "evidence_hit_3", "mrr")] == [1, 0, 1, 1, 1]
    assert math.isclose(q["recall_1"], 1 / 3) and math.isclose(q["recall_3"], 2 / 3)
    assert math.isclose(q["ndcg"], (1 + 3 / 2) / (3 + 3 / math.log2(3) + 1 / 2))
    assert rows["loose"]["evidence_hit_1"] is None and rows["loose"]["ndcg"] == 0 and "empty" not in rows
    with pytest.raises(ValueError):
        metrics.ranking_metrics(ranked, grades, (1, 3), strict=True)
    with pytest.raises(ValueError):
        metrics.ranking_metrics(ranked, grades, (0,))


def test_reciprocal_and_paired(spark):
    rows = lambda spec: spark.createDataFrame([(q, k, g) for q, grades in spec.items() for k, g in enumerate(grades, 1)], "query_id string, rank int, grade int")
    late = rows({"u": [0, 0, 0, 2, 0]})
    assert [metrics.reciprocal_rank(late, k).first()["rr"] for k in (3, 4, 5)] == [0, 0.25, 0.25]
    with pytest.raises(ValueError):
        metrics.reciprocal_rank(late, 0)
    clean, degraded = rows({"u": [0, 1], "v": [1], "w": [0, 0, 1], "x": [2]}), rows({"u": [1], "v": [1], "w": [0], "x": [0, 0, 0, 1]})
    s = metrics.paired_summary(metrics.reciprocal_rank(clean), metrics.reciprocal_rank(degraded)).first()
    assert (s["wins"], s["ties"], s["losses"], s["unpaired"], s["queries"]) == (1, 1, 2, 0, 4)
    assert math.isclose(s["clean_mrr"], (1 / 2 + 1 + 1 / 3 + 1) / 4) and math.isclose(s["degraded_mrr"], 2.25 / 4) and math.isclose(s["mean_delta"], s["degraded_mrr"] - s["clean_mrr"])
    with pytest.raises(ValueError):
        metrics.paired_summary(metrics.reciprocal_rank(clean), metrics.reciprocal_rank(late), strict=True)


SPANS = "passage_id string, seq bigint, label string, start bigint, end bigint"


def test_spans(spark):
    refs = spark.createDataFrame([("p", 1, "LOCATION", 3, 9), ("p", 2, "PERSON", 20, 31), ("p", 3, "PERSON", 40, 44)], SPANS)
    preds = spark.createDataFrame([("p", 1, "LOCATION", 3, 9), ("p", 2, "PERSON", 20, 30), ("p", 3, "LOCATION", 40, 44), ("p", 4, "PERSON", 40, 44)], SPANS)
    total = metrics.strict_span_metrics(refs, preds).where("label IS NULL").first()
    assert (total["true_positives"], total["false_positives"], total["false_negatives"], total["precision"]) == (2, 2, 1, 0.5)
    assert math.isclose(total["recall"], 2 / 3)
    nothing = metrics.strict_span_metrics(refs.limit(0), preds.limit(0)).collect()
    assert all(r["f1"] == 0 for r in nothing)


def test_overlaps_are_taken_in_order(spark):
    """Two references want the same prediction: the first takes the first that overlaps it, the second what is left."""
    refs = spark.createDataFrame([("p", 1, "PERSON", 0, 10), ("p", 2, "PERSON", 8, 20), ("p", 3, "PERSON", 50, 60)], SPANS)
    preds = spark.createDataFrame([("p", 1, "PERSON", 9, 12), ("p", 2, "PERSON", 2, 4), ("p", 3, "PERSON", 60, 65)], SPANS)
    r = metrics.relaxed_span_metrics(refs, preds).where("label IS NULL").first()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"]) == (1, 2, 2)


def test_recognised_text(spark):
    rows = spark.createDataFrame([("quay", "quoy", 4.0, None), ("tide table", "tide", 12.0, "torn"), ("sluice", "sluice", 8.0, None)], "reference string, prediction string, latency_ms double, error string")
    r = metrics.error_rates(metrics.error_counts(rows), [[]], []).first()
    assert math.isclose(r["cer"], 7 / 20) and math.isclose(r["wer"], 2 / 4) and (r["mean_ms"], r["p95_ms"], r["failures"]) == (8.0, 12.0, 1)
    c = metrics.error_counts(spark.createDataFrame([("Dredging ended in 1987", "Dredg ing ended in I987"), ("ebb", None)], "reference string, prediction string")).collect()
    assert [(x["characters"], x["character_edits"], x["words"], x["word_edits"]) for x in c] == [(22, 2, 4, 3), (3, 3, 1, 1)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_all_mentions_by_brute_force(spark, data):
    from quire.plans import catalog

    mentions = {r["id"]: r for r in spark.read.parquet(f"{data}/entity_mentions.parquet").collect()}.values()
    got = {r["label"]: r for r in catalog.queries()["edit_distance_rates_all"](spark, data).collect()}
    assert set(got) == {None, *(m["label"] for m in mentions)}
    assert any(not m["text"].isascii() for m in mentions) and any("\n" in m["text"] for m in mentions)
    for label, r in got.items():
        pairs = [(m["text"].lower(), m["normalized_text"] or "") for m in mentions if label in (None, m["label"])]
        cer = sum(edits(a, b) for a, b in pairs) / sum(len(a) for a, _ in pairs)
        wer = sum(edits(a.split(), b.split()) for a, b in pairs) / sum(len(a.split()) for a, _ in pairs)
        assert r["samples"] == len(pairs) and math.isclose(r["cer"], cer, abs_tol=1e-6) and math.isclose(r["wer"], wer, abs_tol=1e-6)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_answers(spark):
    texts = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    figures = lambda *t: F.array(*[F.lit(float(x)) for x in t]).cast("array<double>")
    cover = lambda p, t, f: value(spark, metrics.reference_coverage(F.lit(p).cast("string"), t, f))
    assert cover("Tolls made up 12% and pilotage 8.5%.", texts("12%", "8.5%"), figures()) == 1.0
    assert cover("The balance stood at -731.2 by then.", texts(), figures(-731.2)) == 1.0
    assert cover("Tolls only: 12%.", texts("12%", "8.5%"), figures(12, 99)) == 0.5
    assert cover(None, texts("tolls"), figures()) == 0.0
    f1 = lambda a, b: value(spark, metrics.token_f1(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert math.isclose(f1("north quay north shed", "the north quay shed"), 2 * 3 / 8)
    assert (f1("", ""), f1(None, "quay"), f1("quay", "shed")) == (1.0, 0.0, 0.0)


def test_scorecard(spark):
    rows = spark.createDataFrame([("answered", "answered", "answered", True, 1.0, 1.0, 0.5, 100.0), ("insufficient_evidence", "insufficient_evidence", "generation_failed", False, 0.0, 0.0, None, 200.0)], "expected_status string, context_expected_status string, status string, retrieval_evidence_available boolean, reference_coverage double, token_f1 double, evidence_page_citation_relevance double, latency_ms double")
    r = metrics.generation_scorecard(rows).first()
    assert (r["valid_generation_rate"], r["end_to_end_status_accuracy"], r["context_status_accuracy"], r["refusal_accuracy"], r["answerable_reference_coverage"], r["unsupported_answer_rate"], r["p95_ms"]) == (0.5, 0.5, 0.5, 0.0, 1.0, 0.0, 200.0)


def test_contract():
    check = generation.check_output
    good = '{"status": "answered", "claims": [{"text": " A. ", "citation_ids": ["C1", "C1"]}, {"text": "B.", "citation_ids": ["C2"]}]}'
    status, answer, claims, why = check(good, ["C1", "C2"])
    assert (status, answer, why) == ("answered", "A. B.", None) and claims[0]["citation_ids"] == ["C1"]
    assert check(good, ["C1"])[3] == "invalid_citations"
    assert check('{"status": "insufficient_evidence", "claims": []}', ["C1"])[:2] == ("insufficient_evidence", generation.REFUSAL)
    assert check(None, [])[0] == "insufficient_evidence"
    bad = ['{"status": "answered", "claims": []}', '{"status": "insufficient_evidence", "claims": [{"text": "x", "citation_ids": ["C1"]}]}', '{"status": "answered", "claims": [{"text": " ", "citation_ids": ["C1"]}]}', '{"status": "answered", "claims": [{"text": "x", "citation_ids": ["C1"]}], "extra": 1}', '{"status": "answered", "claims": [{"text": "x", "citation_ids": []}]}', "[]"]
    assert [check(b, ["C1"])[3] for b in bad] == ["schema_error"] * len(bad)
    assert check("{", ["C1"])[3] == "invalid_json"


def test_citation_relevance(spark):
    row = spark.sql("""SELECT array(named_struct('citation_ids', array('C1', 'C2', 'C1'))) AS claims,
        array(named_struct('context_id', 'C1', 'result', named_struct('document_id', 'd', 'page_start', 1, 'page_end', 2)), named_struct('context_id', 'C2', 'result', named_struct('document_id', 'e', 'page_start', 2, 'page_end', 2))) AS contexts""")
    rate = lambda expected: row.select(generation.citation_relevance(F.col("claims"), F.col("contexts"), F.lit("d"), F.array(F.lit(2)), F.lit(expected), F.lit("answered")).alias("x")).first()["x"]
    assert rate("answered") == 0.5 and rate("insufficient_evidence") is None


PAGES = "document_id string, page_number int, text string"
MENTIONS = "id bigint, document_id string, page_number int, label string, text string, normalized_text string, char_start int, char_end int, confidence double"


def test_mentions(spark):
    pages = spark.createDataFrame([("d", 7, "In Tarnhaven, Pilot Osk met Orwell Dredging plc.")], PAGES)
    rows = spark.createDataFrame([(1, "d", 7, "LOCATION", "Tarnhaven", "tarnhaven", 3, 12, None), (2, "d", 7, "ORGANIZATION", "Orwell Dredging plc", "orwell dredging plc", 28, 47, 0.25), (3, "d", 7, "PERSON", "Osk P", "osk p", 20, 25, 1.0), (4, "d", 8, "PERSON", "Osk", "osk", 0, 3, 0.9), (5, "d", 7, "SHIP", "Osk", "osk", 20, 23, 0.9), (6, "d", 7, "PERSON", "", "", 9, 9, 0.9), (7, "d", 7, "PERSON", "haven", "haven", 7, 12, 1.5)], MENTIONS)
    assert {r["id"]: r["problem"] for r in entities.mention_violations(rows, pages).collect()} == {3: "text", 4: "page", 5: "label", 6: "span", 7: "confidence"}
    assert {r["id"] for r in entities.overlapping_mentions(rows.where("id IN (1, 2, 7)")).collect()} == {7}
    documents = spark.createDataFrame([("d", "ready", "tagger@4")], "id string, metadata_status string, metadata_model string")
    keys = spark.createDataFrame([("ORGANIZATION", "orwell dredging plc"), ("LOCATION", "orwell dredging plc"), ("ORGANIZATION", "orwell")], "label string, normalized_text string")
    found = entities.exact_page_matches(rows, documents, keys, "tagger@4").collect()
    assert [(r["page_number"], r["label"]) for r in found] == [(7, "ORGANIZATION")]
    assert entities.exact_page_matches(rows, documents, keys, "tagger@5").count() == 0
    mapped = entities.mapped_labels(spark.createDataFrame([("GPE",), ("per",), ("SHIP",), (None,)], "label string"))
    assert [r["label"] for r in mapped.collect()] == ["LOCATION", "PERSON"]


def test_rerank(spark):
    ranking = spark.createDataFrame([(1, "k7", "log", 3, 4), (2, "k2", "chart", 9, 9), (3, "k5", "log", 1, 2), (4, "k9", "chart", 4, 8), (5, "k1", "log", 2, 2)], "rank int, chunk_id string, document_id string, page_start int, page_end int")
    order = lambda m: [r["chunk_id"] for r in entities.page_rerank(ranking, m).orderBy("new_rank").collect()]
    assert order(spark.createDataFrame([("log", 2), ("chart", 6), ("log", 2)], "document_id string, page_number int")) == ["k5", "k9", "k1", "k7", "k2"]
    assert order(spark.createDataFrame([], "document_id string, page_number int")) == ["k7", "k2", "k5", "k9", "k1"]