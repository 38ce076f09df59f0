import pytest
from pyspark.sql import functions as F

from quire.operators import integrity, sampling
from quire.session import table


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_line_categories(spark):
    kind = lambda t: value(spark, sampling.line_category(F.lit(t)))
    assert kind("The company recognises revenue when control passes to the buyer.") == "prose"
    assert kind("Outstanding shares in 2019 were 13,477,758 compared with 10,692,594 in 2018") == "number_heavy"
    assert kind("Short heading") is None


def test_passages(spark):
    ok = lambda t: value(spark, sampling.eligible_passage(F.lit(t).cast("string")))
    assert ok("one two three four five six seven eight nine") and not ok("one two three four five") and not ok(None) and not ok("x " * 1000)
    named = lambda t: value(spark, sampling.likely_entity(F.lit(t)))
    assert named("held by Example Holdings there") and named("the IFRS IC said") and not named("Example held it")


def samples(spark, data, parts):
    blocks, pages, documents = (table(spark, data, t) for t in ("blocks", "pages", "pdf_documents"))
    docs = table(spark, data, "documents").select("doc_id", "lang", "source")
    move = lambda df: df.repartition(parts)
    return [
        sampling.line_sample(move(blocks), move(pages)),
        sampling.passage_pairs(move(blocks), move(pages)),
        sampling.mixed_documents(move(documents), move(pages), 6, 3),
        sampling.first_per_stratum(move(docs), ["lang"], sampling.stable_key(sampling.SEED, F.col("doc_id")), 2),
        sampling.quota_sample(move(docs), "lang", {"en": 3, "fr": 1}, sampling.stable_key("other", F.col("doc_id"))),
    ]


def test_order_of_input_does_not_matter(spark, data):
    for a, b in zip(samples(spark, data, 2), samples(spark, data, 7), strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0


def test_quotas(spark):
    rows = spark.createDataFrame([(k, "a") for k in range(5)] + [(9, None)], "id int, s string")
    assert sampling.quota_sample(rows, "s", {"a": 2, "b": 1}, sampling.stable_key("x", F.col("id"))).count() == 2
    with pytest.raises(ValueError):
        sampling.first_per_stratum(rows, ["s"], sampling.stable_key("x", F.col("id")), 2, strict=True)
    with pytest.raises(ValueError):
        sampling.mixed_documents(rows, rows, 1, 2)
    assert sampling.first_per_stratum(rows.limit(0), ["s"], sampling.stable_key("x", F.col("id")), 2).count() == 0


def test_blinding(spark):
    rows = spark.createDataFrame([("m1", "q"), ("m2", "q"), ("m1", "r")], "model string, uid string")
    out = sampling.blinded(rows, "model", "uid").collect()
    assert {r["alias"] for r in out} == {"Candidate A", "Candidate B"} and len({r["review_id"] for r in out}) == 3


def test_constraints(spark, data):
    tables = {name: table(spark, data, name) for name in ("pages", "blocks", "chunks", "chunk_spans")}
    assert {r["violations"] for r in integrity.violations({"pages": tables["pages"], "chunks": tables["chunks"]}).collect()} == {0}
    assert integrity.span_violations(tables["chunk_spans"], tables["blocks"], tables["chunks"]).count() == 0
    bad = tables["pages"].unionAll(tables["pages"].limit(1).withColumn("method", F.lit("guess")).withColumn("page_number", F.lit(0)))
    found = {(r["check"]): r["violations"] for r in integrity.violations({"pages": bad}).collect()}
    assert found["domain:method"] == 1 and found["domain:page_number"] == 1 and found["unique:id"] == 1
    moved = tables["chunk_spans"].withColumn("chunk_start", F.col("chunk_start") + 1)
    assert integrity.span_violations(moved, tables["blocks"], tables["chunks"]).count() > 0
