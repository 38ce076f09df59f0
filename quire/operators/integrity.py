"""Constraints of the store as queries for the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAINS: dict[str, dict[str, str]] = {
    "pdf_documents": {"size": "size_bytes < 0"},
    "pages": {"page_number": "page_number <= 0", "size": "width <= 0 OR height <= 0", "method": "method NOT IN ('direct', 'ocr')"},
    "blocks": {"block_order": "block_order <= 0", "method": "method NOT IN ('direct', 'ocr')", "confidence": "confidence NOT BETWEEN 0 AND 100"},
    "chunks": {"ordinal": "ordinal <= 0", "pages": "page_start <= 0 OR page_end < page_start"},
    "chunk_spans": {"span_order": "span_order <= 0", "block_span": "block_start < 0 OR block_end < block_start", "chunk_span": "chunk_start < 0 OR chunk_end < chunk_start"},
    "entity_mentions": {"page_number": "page_number <= 0", "label": "label NOT IN ('PERSON', 'ORGANIZATION', 'LOCATION')", "span": "char_start < 0 OR char_end <= char_start", "confidence": "confidence NOT BETWEEN 0 AND 1"},
}
UNIQUE = {
    "pdf_documents": (("id",), ("storage_key",)), "document_names": (("id",),), "pages": (("id",), ("document_id", "page_number")), "blocks": (("id",), ("page_id", "block_order")),
    "chunks": (("id",), ("document_id", "ordinal", "chunker_version")), "chunk_spans": (("chunk_id", "span_order"),), "entity_mentions": (("id",), ("document_id", "page_number", "label", "char_start", "char_end")),
}
REFERENCES = {
    ("document_names", ("document_id",)): ("pdf_documents", ("id",)), ("pages", ("document_id",)): ("pdf_documents", ("id",)), ("blocks", ("page_id",)): ("pages", ("id",)),
    ("chunks", ("document_id",)): ("pdf_documents", ("id",)), ("chunk_spans", ("chunk_id",)): ("chunks", ("id",)), ("chunk_spans", ("block_id",)): ("blocks", ("id",)),
    ("entity_mentions", ("document_id", "page_number")): ("pages", ("document_id", "page_number")),
}


def _row(relation: str, check: str, n: Column) -> list[Column]:
    return [F.lit(relation).alias("relation"), F.lit(check).alias("check"), n.cast("bigint").alias("violations")]


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, check, violations): a row per constraint of the relations given, with how many rows or keys break it.

    A null breaks no domain check. Keys are counted once however often they are repeated. Relations are scanned once
    for all their domain checks.
    """
    out = []
    for relation, df in tables.items():
        domains = DOMAINS.get(relation, {})
        if domains:
            counted = df.agg(*[F.count_if(F.coalesce(F.expr(test), F.lit(False))).alias(name) for name, test in domains.items()])
            stacked = F.explode(F.array(*[F.struct(F.lit(f"domain:{name}").alias("check"), F.col(name).alias("n")) for name in domains])).alias("x")
            out.append(counted.select(stacked).select(F.lit(relation).alias("relation"), F.col("x.check").alias("check"), F.col("x.n").cast("bigint").alias("violations")))
        for key in UNIQUE.get(relation, ()):
            repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
            out.append(repeated.agg(F.count("*").alias("n")).select(*_row(relation, "unique:" + ",".join(key), F.col("n"))))
    for (relation, key), (parent, target) in REFERENCES.items():
        if relation in tables and parent in tables:
            keys = tables[parent].select(*[F.col(t).alias(k) for t, k in zip(target, key, strict=True)])
            # keys are counted before they are shuffled: a row per key and partition meets the parents
            orphans = tables[relation].groupBy(*key).agg(F.count("*").alias("m")).join(keys.distinct(), list(key), "left_anti")
            out.append(orphans.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).select(*_row(relation, "reference:" + ",".join(key), F.col("n"))))
    return reduce(DataFrame.unionAll, out)


def span_violations(spans: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, span_order, block_id) of spans whose part of the chunk is not their part of the block, or whose chunk
    or block is missing."""
    block = blocks.select(F.col("id").alias("block_id"), F.col("text").alias("block_text")).dropDuplicates(["block_id"])
    chunk = chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    joined = spans.join(block, "block_id", "left").join(chunk, "chunk_id", "left")
    part = lambda text, a, b: F.substring(F.col(text), F.col(a) + 1, F.col(b) - F.col(a))
    same = part("block_text", "block_start", "block_end") == part("chunk_text", "chunk_start", "chunk_end")
    return joined.where(~F.coalesce(same, F.lit(False))).select("chunk_id", "span_order", "block_id")
