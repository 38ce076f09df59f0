"""The engine as one object: ingest, list, get, delete, reset, search and answer over a store."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import ascii_tokens, entity_form, page_label
from quire.operators import chunking, entities, fusion, generation, lexical, vectors
from quire.session import checkpointed, ship
from quire.sources.files import PageExtractor, PlainTextExtractor, extract_pages
from quire.sources.store import BUCKET, Store, latest_names


class TextEncoder(Protocol):
    """Makes unit vectors of documents and of queries. `encoded` runs in the workers; models are plugged in behind it."""

    name: str

    def encoded(self, texts: DataFrame, key: str, text: str) -> DataFrame: ...

    def query(self, text: str) -> list[float]: ...


class EntityExtractor(Protocol):
    """Finds mentions in pages (document_id, page_number, text); `name` tells models and versions apart."""

    name: str

    def mentions(self, pages: DataFrame) -> DataFrame: ...


class HashEncoder:
    """A stand-in for tests: signed counts of hashed tokens, so texts of like words are near. No model parity."""

    def __init__(self, size: int = 64):
        self.size, self.name = size, f"hash-{size}@r1"

    def vector(self, tokens: list[str]) -> list[float]:
        out = [0.0] * self.size
        for t in tokens:
            h = zlib.crc32(t.encode())
            out[h % self.size] += 1.0 if h >> 31 else -1.0
        length = sum(x * x for x in out) ** 0.5
        return [x / length for x in out] if length else out

    def encoded(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        make = self.vector

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(tokens: pd.Series) -> pd.Series:
            return pd.Series([make(list(t)) if t is not None else None for t in tokens], dtype=object)

        return texts.select(key, run(ascii_tokens(F.col(text))).alias("embedding"))

    def query(self, text: str) -> list[float]:
        return self.vector([t.lower() for t in re.findall("[a-zA-Z0-9]+", text)])


class EvidenceEngine:
    """Each stage of ingest is skipped for documents that have it already in the version it would make: pages once and
    for all, chunks by chunker version, vectors and mentions by model. A failure marks its document and no other."""

    def __init__(self, spark: SparkSession, folder: str, extractor: PageExtractor | None = None, encoder: TextEncoder | None = None, recogniser: EntityExtractor | None = None, generator: generation.Generator | None = None, max_words: int = chunking.MAX_WORDS, overlap: int = chunking.OVERLAP, keyword_weight: float = 0.5, semantic_weight: float = 0.5):
        ship(spark)
        self.spark, self.store = spark, Store(spark, folder)
        self.extractor, self.encoder, self.recogniser, self.generator = extractor or PlainTextExtractor(), encoder, recogniser, generator
        self.max_words, self.overlap = max_words, overlap
        self.weights = keyword_weight, semantic_weight

    # ------------------------------------------------------------------------------------------ write path

    def ingest(self, files: DataFrame) -> DataFrame:
        """Takes uploads (sources.files.uploads) through all stages; (id, status, metadata_status) of their documents."""
        files = checkpointed(files)
        self.store.blobs.put_all(files.where("error IS NULL").dropDuplicates(["id"])).count()
        self.store.record_uploads(files)
        ids = checkpointed(files.where("error IS NULL").select("id").distinct())
        version = chunking.version_of(self.max_words, self.overlap)
        known = self.store.read("pdf_documents").join(ids, "id", "left_semi")
        self._extract(files.where("error IS NULL").select("id", "content").dropDuplicates(["id"]).join(known.where("status IN ('stored', 'processing', 'failed')").select("id"), "id", "left_semi"))
        known = self.store.read("pdf_documents").join(ids, "id", "left_semi").where("status <> 'failed'")
        stale = checkpointed(known.where(F.coalesce(F.col("chunker_version") != version, F.lit(True)) | ~F.col("status").isin("indexed_lexical", "ready", "index_failed")).select("id"))
        self._chunk(stale, version)
        if self.encoder is not None:
            known = self.store.read("pdf_documents").join(ids, "id", "left_semi").where("status <> 'failed'")
            self._embed(checkpointed(known.where(F.coalesce(F.col("embedding_model") != self.encoder.name, F.lit(True)) | (F.col("status") != "ready")).select("id")))
        else:
            self._set(stale, status="ready")
        if self.recogniser is not None:
            known = self.store.read("pdf_documents").join(ids, "id", "left_semi").where("status <> 'failed'")
            self._enrich(checkpointed(known.where(F.coalesce(F.col("metadata_model") != self.recogniser.name, F.lit(True)) | (F.col("metadata_status") != "ready")).select("id")))
        return self.store.read("pdf_documents").join(ids, "id", "left_semi").select("id", "status", "metadata_status")

    def _set(self, ids: DataFrame, **values: str | None) -> None:
        if not ids.isEmpty():
            self.store.set_status(ids.select("id", *[F.lit(v).cast("string").alias(k) for k, v in values.items()]))

    def _extract(self, files: DataFrame) -> None:
        rows = checkpointed(extract_pages(files, self.extractor))
        if rows.isEmpty():
            return
        text = F.trim(F.coalesce("text", F.lit(""))) != ""
        per = checkpointed(rows.groupBy(F.col("document_id").alias("id")).agg(F.max("error").alias("error"), F.max(text).alias("has_text")))
        good = per.where("error IS NULL AND has_text").select("id")
        kept = rows.join(good.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        number = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("bigint")
        page_id = number("document_id", F.col("page_number").cast("string"))
        line = F.struct("block_order", "text")
        pages = kept.groupBy("document_id", "page_number").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("method").alias("method"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), line))), lambda x: x["text"]), "\n").alias("text"))
        pages = pages.select(page_id.alias("id"), "document_id", F.col("page_number").cast("int").alias("page_number"), "width", "height", "text", "method")
        blocks = kept.where("text IS NOT NULL").select(number("document_id", F.col("page_number").cast("string"), F.col("block_order").cast("string")).alias("id"), page_id.alias("page_id"), "document_id", F.col("block_order").cast("int").alias("block_order"), "text", "x0", "top", "x1", "bottom", "method", "confidence")
        self.store.replace_document("pages", pages, good)
        self.store.replace_document("blocks", blocks, good)
        # new pages end what was found on the old ones
        for name in ("entity_mentions",):
            if self.store.exists(name):
                self.store.replace_document(name, self.store.read(name).limit(0), good)
        self._set(good, status="extracted", error_message=None, metadata_status="pending")
        bad = per.where("error IS NOT NULL OR NOT has_text").select("id", F.lit("failed").alias("status"), F.coalesce("error", F.lit("no searchable text")).alias("error_message"))
        if not bad.isEmpty():
            self.store.set_status(bad)

    def _chunk(self, ids: DataFrame, version: str) -> None:
        if ids.isEmpty():
            return
        of = ids.select(F.col("id").alias("document_id"))
        chunks = checkpointed(chunking.provenance_chunks(self.store.read("pages").join(of, "document_id", "left_semi"), self.store.read("blocks").join(of, "document_id", "left_semi"), self.max_words, self.overlap))
        old = checkpointed(self.store.read("chunks").join(of, "document_id", "left_semi").select(F.col("id").alias("chunk_id")))
        self.store.bury(of)
        self.store.swap("chunk_spans", old, "chunk_id", checkpointed(chunking.chunk_spans(chunks)))
        self.store.replace_document("chunks", chunks.drop("spans"), ids)
        rows = checkpointed(lexical.index_rows(chunks))
        self.store.index_chunks(rows)
        lengths = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(rows.groupBy("chunk_id").agg(F.max("len").alias("len")), "chunk_id", "left")
        self.store.replace_document("text_sizes", checkpointed(lengths.groupBy("document_id").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))), ids)
        self._set(ids, status="indexed_lexical", chunker_version=version)

    def _embed(self, ids: DataFrame) -> None:
        if ids.isEmpty():
            return
        of = ids.select(F.col("id").alias("document_id"))
        try:
            chunks = self.store.read("chunks").join(of, "document_id", "left_semi")
            made = self.encoder.encoded(chunks, "id", "text").withColumnRenamed("id", "chunk_id").join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_start", "page_end"), "chunk_id")
            self.store.replace_document("vectors", checkpointed(made.withColumn("model_fingerprint", F.substring(F.sha2(F.lit(self.encoder.name), 256), 1, 12))), ids)
        except Exception as problem:  # noqa: BLE001 - lexical search goes on without vectors
            self._set(ids, status="index_failed", error_message=f"{type(problem).__name__}: {problem}"[:300])
            return
        self._set(ids, status="ready", embedding_model=self.encoder.name, error_message=None)

    def _enrich(self, ids: DataFrame) -> None:
        if ids.isEmpty():
            return
        pages = self.store.read("pages").join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        try:
            found = checkpointed(entities.mapped_labels(self.recogniser.mentions(pages)).withColumn("normalized_text", entity_form("text")))
            if not entities.mention_violations(found, pages).isEmpty():
                raise ValueError("mentions do not fit their pages")
            self.store.replace_document("entity_mentions", found, ids)
        except Exception as problem:  # noqa: BLE001 - metadata never hides evidence
            self._set(ids, metadata_status="failed", metadata_error=f"{type(problem).__name__}: {problem}"[:200])
            return
        self._set(ids, metadata_status="ready", metadata_model=self.recogniser.name, metadata_error=None)

    # ------------------------------------------------------------------------------------------ read path

    def documents(self) -> DataFrame:
        """The catalogue with each document's latest name and page count, newest first."""
        catalogue = self.store.read("pdf_documents")
        names = latest_names(self.store.read("document_names"), catalogue)
        pages = self.store.read("pages").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("pages"))
        return catalogue.join(names, "id").join(pages, "id", "left").fillna(0, ["pages"]).orderBy(F.col("created_at").desc(), "id")

    def get(self, document: str) -> DataFrame:
        return self.documents().where(F.col("id") == document)

    def mentions(self, document: str) -> DataFrame:
        return self.store.read("entity_mentions").where(F.col("document_id") == document).orderBy("page_number", "char_start", "char_end", "label")

    def delete(self, document: str) -> bool:
        return self.store.delete([document]) > 0

    def reset(self) -> int:
        return self.store.delete()

    def search(self, query: str, limit: int = 5, entities_of: DataFrame | None = None) -> DataFrame:
        """(rank, chunk_id, document_id, document_name, text, page_start, page_end, pages, score, keyword_rank,
        semantic_rank): the best chunks of searchable documents; none for a blank query. `entities_of` (label,
        normalized_text) moves chunks on pages that mention them ahead."""
        if not 1 <= limit <= 50:
            raise ValueError("limit must be between 1 and 50")
        cap = fusion.candidate_limit(limit)
        chunks = self.store.read("chunks")
        keyword = lexical.top(lexical.bm25_indexed(self.store.live_postings(), self.store.read("text_sizes"), query, BUCKET, self.store.buckets), "chunk_id", cap).select("chunk_id", "rank")
        if self.encoder is not None and self.store.exists("vectors") and query.strip():
            semantic = vectors.nearest(self.store.read("vectors"), self.encoder.query(query), cap, "chunk_id").select("chunk_id", "rank")
        else:
            semantic = keyword.limit(0)
        fused = fusion.reciprocal_rank_fusion(keyword, semantic, "chunk_id", *self.weights)
        rows = fusion.hydrate(fused, chunks, self.store.read("pdf_documents"), self.store.read("document_names"))
        order = fusion.result_order("chunk_id", cap)
        best = rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
        if entities_of is not None and self.recogniser is not None:
            matches = entities.exact_page_matches(self.store.read("entity_mentions"), self.store.read("pdf_documents"), entities_of, self.recogniser.name)
            best = entities.page_rerank(best, matches).drop("rank", "matched").withColumnRenamed("new_rank", "rank")
        return best.select("rank", "chunk_id", "document_id", "document_name", "text", "page_start", "page_end", page_label(F.col("page_start"), F.col("page_end")).alias("pages"), "score", "keyword_rank", "semantic_rank").orderBy("rank")

    def answer(self, question: str, limit: int = 5) -> dict:
        """A grounded answer: status, answer, claims, failure_reason and the contexts it may cite."""
        if not question.strip() or not 1 <= limit <= 10:
            raise ValueError("a question and a limit between 1 and 10 are needed")
        found = [row.asDict() for row in self.search(question, limit).collect()]
        contexts = [{"context_id": f"C{k}", "result": row} for k, row in enumerate(found, 1)]
        known = [c["context_id"] for c in contexts]
        raw = None
        if contexts:
            if self.generator is None:
                raise RuntimeError("no generator is plugged in")
            prompt = "\n\n".join(f"[{c['context_id']}] Source: {c['result']['document_name']}; pages {c['result']['page_start']}-{c['result']['page_end']}\n{c['result']['text']}" for c in contexts)
            raw = self.generator.generate(question, prompt)
        status, answer, claims, why = generation.check_output(raw, known)
        return {"status": status, "answer": answer, "claims": claims, "failure_reason": why, "contexts": contexts}
