import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.plans.engine import EvidenceEngine, HashEncoder
from quire.schemas import RELATIONS, upgrade
from quire.sources import files
from quire.sources.store import Store
from quire.streaming.ingest import ingest_stream, late_safe_counts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests

PDF = b"%PDF-1.7\n"


class CountingExtractor(files.PlainTextExtractor):
    def extract(self, content):
        if b"broken" in content:
            raise ValueError("no pages")
        return super().extract(content)


class Gazetteer:
    def __init__(self, name="gazetteer@1", shift=0):
        self.name, self.shift = name, shift

    def mentions(self, pages):
        start = F.instr("text", "Orwell Marine plc") - 1
        return pages.where(start >= 0).select(F.col("id"), "document_id", "page_number", F.lit("ORG").alias("label"), F.lit("Orwell Marine plc").alias("text"), (start + self.shift).cast("int").alias("char_start"), (start + len("Orwell Marine plc") + self.shift).cast("int").alias("char_end"), F.lit(None).cast("double").alias("confidence"))


class FailingEncoder(HashEncoder):
    def encoded(self, texts, key, text):
        raise RuntimeError("no model")


class Echo:
    def generate(self, question, prompt):
        return json.dumps({"status": "answered", "claims": [{"text": "As it says.", "citation_ids": ["C1"]}]})


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "first.pdf").write_bytes(PDF + b"Dredging works by Orwell Marine plc began.\fTide tables")
    (folder / "again.pdf").write_bytes(PDF + b"Dredging works by Orwell Marine plc began.\fTide tables")
    (folder / "other.pdf").write_bytes(PDF + b"Sluices close here.")
    (folder / "bad.pdf").write_bytes(b"hello")
    (folder / "broken.pdf").write_bytes(PDF + b"broken")
    return folder


def test_uploads(spark, inbox):
    rows = {r["original_filename"]: r for r in files.uploads(spark, str(inbox), max_bytes=60).collect()}
    assert rows["bad.pdf"]["error"] == "not_pdf" and rows["first.pdf"]["error"] == "too_large" and rows["first.pdf"]["id"] is None
    rows = {r["original_filename"]: r for r in files.uploads(spark, str(inbox)).collect()}
    assert rows["first.pdf"]["id"] == rows["again.pdf"]["id"] and rows["other.pdf"]["storage_key"].startswith("pdfs/" + rows["other.pdf"]["id"][:2])


def test_from_upload_to_reset(spark, inbox, tmp_path):
    engine = EvidenceEngine(spark, str(tmp_path / "store"), CountingExtractor(), HashEncoder(), Gazetteer(), Echo(), max_words=4, overlap=1)
    done = {r["status"]: r for r in engine.ingest(files.uploads(spark, str(inbox))).collect()}
    assert set(done) == {"ready", "failed"} and done["ready"]["metadata_status"] == "ready"
    listed = engine.documents().collect()
    assert len(listed) == 3 and {r["name"] for r in listed} >= {"other.pdf", "broken.pdf"}
    document = next(r["id"] for r in listed if r["name"] in ("first.pdf", "again.pdf"))
    assert engine.get(document).first()["pages"] == 2
    assert [m["normalized_text"] for m in engine.mentions(document).collect()] == ["orwell marine plc"]
    found = engine.search("dredging").collect()
    assert found[0]["document_id"] == document and found[0]["keyword_rank"] == 1 and found[0]["pages"] == "Page 1"
    assert engine.search(" ").count() == 0
    assert engine.search("sluice close").first()["document_name"] == "other.pdf"
    answer = engine.answer("What about dredging?")
    assert answer["status"] == "answered" and answer["claims"][0]["citation_ids"] == ["C1"]
    for bad in (lambda: engine.search("x", 0), lambda: engine.answer(" "), lambda: engine.answer("x", 11)):
        with pytest.raises(ValueError):
            bad()
    before = engine.store.read("chunks").count()
    # the same bytes again: nothing is made anew, the name is logged
    engine.ingest(files.uploads(spark, str(inbox)))
    assert engine.store.read("chunks").count() == before and engine.store.read("document_names").where(F.col("document_id") == document).count() == 4
    # another chunker version: new chunks, same pages
    EvidenceEngine(spark, str(tmp_path / "store"), CountingExtractor(), HashEncoder(), Gazetteer(), max_words=2, overlap=0).ingest(files.uploads(spark, str(inbox)))
    assert engine.store.read("chunks").count() > before and {r[0] for r in engine.store.read("chunks").select("chunker_version").distinct().collect()} == {"blocks-v1-2-0"}
    assert engine.delete(document) and not engine.delete(document)
    assert engine.search("dredging").where(F.col("document_id") == document).count() == 0 and engine.store.read("chunk_spans").join(engine.store.read("chunks"), F.col("chunk_id") == F.col("id"), "left_anti").count() == 0
    assert engine.reset() == 2 and engine.documents().count() == 0


def test_failures_stay_apart(spark, inbox, tmp_path):
    engine = EvidenceEngine(spark, str(tmp_path / "s"), CountingExtractor(), FailingEncoder(), Gazetteer(shift=1))
    status = {(r["status"], r["metadata_status"]) for r in engine.ingest(files.uploads(spark, str(inbox))).collect()}
    assert status == {("index_failed", "failed"), ("failed", "pending")}
    assert engine.search("zebra").count() == 0  # the gate leaves them out
    assert engine.answer("zebra")["status"] == "insufficient_evidence"


def test_stale_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.drop_stale_vectors("b") == []
    store.append("vectors", spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "c")], "document_id string, model_fingerprint string"))
    assert store.drop_stale_vectors("b") == ["a", "c"] and store.read("vectors").count() == 1
    store.write_report("r", spark.range(1))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.write_report("r", spark.range(1))
    with pytest.raises(KeyError):
        store.set_status(spark.createDataFrame([("nobody", "ready")], "id string, status string"))


def test_upgrade(spark):
    old = spark.createDataFrame([("a", "k", "m", 1, "ready")], "id string, storage_key string, media_type string, size_bytes bigint, status string")
    new = upgrade(old, "pdf_documents", 1)
    assert new.schema.fieldNames() == RELATIONS["pdf_documents"].fieldNames() and new.first()["metadata_status"] == "pending"
    with pytest.raises(ValueError):
        upgrade(old, "pdf_documents", 7)


def test_other_sources(spark, tmp_path):
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "My_first note.md").write_text("# Hi")
    (tmp_path / "t" / "deep" / "b.txt").write_text("x\ny")
    (tmp_path / "t" / "c.csv").write_text("no")
    rows = {r["doc_id"]: r for r in files.text_folder(spark, str(tmp_path / "t")).collect()}
    assert set(rows) == {"my_first-note", "b"} and rows["my_first-note"]["title"] == "My First Note" and rows["b"]["text"] == "x\ny"
    (tmp_path / "m.json").write_text(json.dumps({"documents": [], "queries": [{"uid": "q", "question": "Q?", "relevant_pages": [1]}]}))
    read = files.manifest(spark, str(tmp_path / "m.json"))
    assert len(read.first()["sha256"]) == 64 and files.manifest_queries(read).first()["uid"] == "q"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dev/x.json", "{}")
        z.writestr("dev/x.pdf", "p")
    (tmp_path / "b.zip").write_bytes(b"nonsense")
    got = {(r["name"], r["error"] is None) for r in files.archive_members(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {("dev/x.json", True), (None, False)}


def test_stream(spark, inbox, tmp_path):
    engine = EvidenceEngine(spark, str(tmp_path / "store"), CountingExtractor())
    for _ in range(2):
        ingest_stream(engine, str(inbox), str(tmp_path / "marks")).awaitTermination(120)
    assert engine.store.read("pdf_documents").count() == 3
    (inbox / "late.pdf").write_bytes(PDF + b"Late arrival")
    ingest_stream(engine, str(inbox), str(tmp_path / "marks")).awaitTermination(120)
    assert engine.search("arrival").first()["document_name"] == "late.pdf"


def test_window_counts(spark, data):
    from quire.session import table

    rows = table(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    assert late_safe_counts(rows).agg(F.sum("events")).first()[0] == rows.count()


def test_store_writes_only_what_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    page = lambda d, text: (1, d, 1, 100.0, 100.0, text, "direct")
    rows = lambda *r: spark.createDataFrame([page(*x) for x in r], RELATIONS["pages"])
    store.append("pages", rows(*[(f"d{k}", "old") for k in range(40)]))
    files_of = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "pages").rglob("*.parquet")}
    before = files_of()
    ids = spark.createDataFrame([("d7",), ("new",)], "id string")
    store.replace_document("pages", rows(("d7", "fresh"), ("new", "fresh")), ids)
    after = files_of()
    assert before.keys() & after.keys() and len(before.keys() - after.keys()) <= 2
    assert {r["document_id"]: r["text"] for r in store.read("pages").collect()} == {**{f"d{k}": "old" for k in range(40)}, "d7": "fresh", "new": "fresh"}
    store.swap("pages", store.read("pages").select("document_id"), "document_id")
    assert store.read("pages").count() == 0
    assert Store(spark, str(tmp_path / "s"), buckets=99).buckets == 8


def test_blobs(spark, tmp_path):
    import hashlib

    from quire.sources.blobs import BlobStore

    blobs, content = BlobStore(str(tmp_path)), b"%PDF- tide tables"
    name = hashlib.sha256(content).hexdigest()
    assert blobs.put(name, content) is False and blobs.put(name, content) is True and blobs.get(name) == content
    assert [p.name for p in (tmp_path / "pdfs" / name[:2]).iterdir()] == [f"{name}.pdf"]
    assert blobs.delete(name) is True and blobs.delete(name) is False and not (tmp_path / "pdfs" / name[:2]).exists()
    for wrong in ("x", name.upper(), "../" + name, None):
        with pytest.raises(ValueError):
            blobs.key_of(wrong)
    df = spark.createDataFrame([(name, content), (name, content), (None, b"x")], "id string, content binary")
    assert sorted(r["existed"] for r in blobs.put_all(df.coalesce(1)).collect()) == [False, True] and blobs.exists(name)
    assert [r["existed"] for r in blobs.delete_all(df.where("id IS NOT NULL").coalesce(1)).collect()] == [True, False]


def test_contents_are_kept_and_deleted(spark, inbox, tmp_path):
    engine = EvidenceEngine(spark, str(tmp_path / "store"), CountingExtractor())
    engine.ingest(files.uploads(spark, str(inbox)))
    document = next(r["id"] for r in engine.documents().collect() if r["name"] == "other.pdf")
    assert engine.store.blobs.get(document) == (inbox / "other.pdf").read_bytes()
    engine.delete(document)
    assert not engine.store.blobs.exists(document)
    engine.reset()
    assert not list((tmp_path / "store").rglob("*.pdf"))


def test_the_stored_index_scores_as_texts_do(spark, data, tmp_path):
    from quire.operators import lexical
    from quire.sources.store import BUCKET

    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.append("chunks", chunks)
    rows = lexical.index_rows(chunks)
    store.index_chunks(rows)
    lengths = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(rows.groupBy("chunk_id").agg(F.max("len").alias("len")), "chunk_id", "left")
    store.append("text_sizes", lengths.groupBy("document_id").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")))
    scores = lambda df: {r["chunk_id"]: round(r["score"], 6) for r in df.collect()}
    query = "administrative expenses of the segment"
    found = lexical.bm25_indexed(store.live_postings(), store.read("text_sizes"), query, BUCKET, 8)
    assert scores(found) == scores(lexical.bm25(chunks.withColumnRenamed("id", "chunk_id"), query, "chunk_id", floored=True, stemmed=True))
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket#", "_bucket#") or "PartitionFilters: [" in plan
    # what is buried is not found, what comes again is found once
    first = chunks.select("document_id").limit(1)
    gone = {r["id"] for r in chunks.join(first, "document_id", "left_semi").collect()}
    store.bury(first)
    assert not gone & scores(lexical.bm25_indexed(store.live_postings(), store.read("text_sizes"), query, BUCKET, 8)).keys()
    store.index_chunks(lexical.index_rows(chunks.join(first, "document_id", "left_semi")))
    assert scores(lexical.bm25_indexed(store.live_postings(), store.read("text_sizes"), query, BUCKET, 8)) == scores(found)
    store.bury(first)
    store.compact_index()
    assert store.read("dead_chunks").count() == 0 and not gone & {r["chunk_id"] for r in store.read("postings").collect()}
    assert lexical.bm25_indexed(store.live_postings(), store.read("text_sizes"), " ").count() == 0
