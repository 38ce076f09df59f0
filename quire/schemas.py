"""The relations of the store, their versions, and the upgrade of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 6


def _struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.strip().rsplit(" ", 1) for x in text.split(","))])


RELATIONS: dict[str, T.StructType] = {
    "pdf_documents": _struct(
        "id string, storage_key string, media_type string, size_bytes bigint, status string, error_message string, created_at timestamp, updated_at timestamp, "
        "embedding_model string, chunker_version string, metadata_status string, metadata_model string, metadata_error string"
    ),
    "document_names": _struct("id bigint, document_id string, original_filename string, uploaded_at timestamp"),
    "pages": _struct("id bigint, document_id string, page_number int, width double, height double, text string, method string"),
    "blocks": _struct("id bigint, page_id bigint, document_id string, block_order int, text string, x0 double, top double, x1 double, bottom double, method string, confidence double"),
    "chunks": _struct("id string, document_id string, ordinal int, text string, page_start int, page_end int, chunker_version string"),
    "chunk_spans": _struct("chunk_id string, block_id bigint, span_order int, block_start int, block_end int, chunk_start int, chunk_end int"),
    "postings": _struct("term string, chunk_id string, document_id string, tf bigint, len bigint"),
    "dead_chunks": _struct("chunk_id string"),
    "text_sizes": _struct("document_id string, chunks bigint, tokens bigint"),
    "entity_mentions": _struct("id bigint, document_id string, page_number int, label string, text string, normalized_text string, char_start int, char_end int, confidence double"),
}

#: Columns that a version added to a relation; files of older versions get them as nulls, or with the value given.
ADDED = {
    2: {"pages": {}, "blocks": {}},
    3: {"chunks": {}, "chunk_spans": {}},
    4: {"pdf_documents": {"embedding_model": None}},
    5: {"pdf_documents": {"chunker_version": None}},
    6: {"pdf_documents": {"metadata_status": "pending", "metadata_model": None, "metadata_error": None}, "entity_mentions": {}},
}


def upgrade(df: DataFrame, relation: str, version: int) -> DataFrame:
    """`df` of `relation` as of `version`, with the columns of the current one in their order.

    A version above the current one is refused; columns that the relation does not know are dropped.
    """
    if version > SCHEMA_VERSION:
        raise ValueError(f"version {version} is newer than {SCHEMA_VERSION}")
    fills = {column: value for v, added in ADDED.items() if v > version for column, value in added.get(relation, {}).items()}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(fills.get(f.name))).cast(f.dataType).alias(f.name) for f in RELATIONS[relation]])
