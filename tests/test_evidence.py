import pytest

from quire.operators import evidence

BLOCKS = "document_id string, page_number int, block_order int, block_id string, text string"
QUESTIONS = "uid string, document_id string, mapping array<struct<block_id:string,char_start:int,char_end:int>>, facts array<string>"


def test_evidence(spark):
    blocks = spark.createDataFrame([("d", 1, 1, "first", "Nothing"), ("d", 2, 1, "target", "Tonnage was 50 barges"), ("d", 3, 1, "again", "TONNAGE again"), ("e", 1, 1, "target", "other")], BLOCKS)
    questions = spark.createDataFrame([("mapped", "d", [("target", 12, 14)], ["Tonnage"]), ("by fact", "d", [("gone", 0, 3)], ["tonnage", "tonnage", " "]), ("beyond", "d", [("target", 12, 99)], []), ("none", "d", None, None)], QUESTIONS)
    got = sorted((r["uid"], r["page_number"], r["text"], r["char_start"]) for r in evidence.resolve_evidence(questions, blocks).collect())
    assert got == [("by fact", 2, "Tonnage", 0), ("mapped", 2, "50", 12)]
    assert evidence.resolve_evidence(questions.limit(0), blocks.limit(0)).count() == 0


def test_annotations(spark):
    passages = spark.createDataFrame([("p", "Pilots of Orwell Marine plc."), ("q", "x")], "id string, text string")
    kind = "id string, annotation_status string, entities array<struct<label:string,start:int,end:int,text:string>>"
    good = spark.createDataFrame([("p", "preannotated", [("PERSON", 0, 6, "Pilots"), ("ORGANIZATION", 10, 27, "Orwell Marine plc")]), ("q", "reviewed", [])], kind)
    assert {r["annotation_status"] for r in evidence.merged_annotations(passages, good).collect()} == {"preannotated", "reviewed"}
    assert {r["annotation_status"] for r in evidence.merged_annotations(passages, good, set_reviewed=True).collect()} == {"reviewed"}
    bad = spark.createDataFrame([("p", "done", [("PERSON", 0, 6, "Pilote"), ("PERSON", 3, 8, "ots o"), ("DATE", 0, 1, "P"), ("PERSON", 5, 99, "x")]), ("z", "reviewed", []), ("z", "reviewed", [])], kind)
    assert sorted((r["id"], r["problem"]) for r in evidence.annotation_problems(passages, bad).collect()) == [("p", "bounds"), ("p", "label"), ("p", "overlapping"), ("p", "status"), ("p", "text"), ("q", "missing"), ("z", "repeated"), ("z", "unknown")]
    with pytest.raises(ValueError, match="missing"):
        evidence.merged_annotations(passages, good.where("id = 'p'"))
