"""Entity mentions: validation against page text, exact page matches, and page-aware reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("PERSON", "ORGANIZATION", "LOCATION")
#: Labels of common recognisers and what they are here; others are dropped.
LABEL_MAP = {"PERSON": "PERSON", "PER": "PERSON", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "LOCATION": "LOCATION"}


def mapped_labels(mentions: DataFrame, label: str = "label") -> DataFrame:
    """Mentions with their label in this engine's terms; those of other labels are dropped."""
    pairs = F.create_map(*[F.lit(x) for pair in LABEL_MAP.items() for x in pair])
    return mentions.withColumn(label, F.try_element_at(pairs, F.upper(label))).where(F.col(label).isNotNull())


def mention_violations(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, document_id, page_number, problem) of mentions that do not fit: a wrong label, confidence or span, no such
    page, or a text that is not what the page holds there. A mention has one row, for the first that applies."""
    text = pages.select("document_id", "page_number", F.col("text").alias("page_text"))
    held = F.substring(F.col("page_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    problem = (
        F.when(F.col("label").isNull() | ~F.col("label").isin(*LABELS), "label")
        .when(F.col("confidence") < 0, "confidence")
        .when(F.col("confidence") > 1, "confidence")
        .when((F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")), "span")
        .when(F.col("page_text").isNull(), "page")
        .when(held != F.col("text"), "text")
    )
    joined = mentions.dropDuplicates(["id"]).join(text, ["document_id", "page_number"], "left")
    return joined.select("id", "document_id", "page_number", problem.alias("problem")).where("problem IS NOT NULL")


def exact_page_matches(mentions: DataFrame, documents: DataFrame, keys: DataFrame, model: str) -> DataFrame:
    """(document_id, page_number, label, normalized_text): pages that mention one of `keys` (label, normalized_text),
    of documents whose metadata is ready and made by `model`. A semi-join per side; nothing is multiplied."""
    ready = documents.where((F.col("metadata_status") == "ready") & (F.col("metadata_model") == model)).select(F.col("id").alias("document_id"))
    found = mentions.select("document_id", "page_number", "label", "normalized_text").join(keys.select("label", "normalized_text").dropDuplicates(), ["label", "normalized_text"], "left_semi")
    return found.join(ready, "document_id", "left_semi").select("document_id", "page_number", "label", "normalized_text").dropDuplicates()


def query_entity_matches(query_entities: DataFrame, mentions: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """(uid, document_id, page_number, label, normalized_text) for a block of queries' entities (uid, label, normalized_text)."""
    wanted = query_entities.select("uid", "label", "normalized_text").dropDuplicates()
    pages = exact_page_matches(mentions, documents, wanted, model)
    return wanted.join(pages, ["label", "normalized_text"]).select("uid", "document_id", "page_number", "label", "normalized_text")


def page_rerank(ranking: DataFrame, matches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The ranking (by, rank, document_id, page_start, page_end, ...) with new_rank: rows that cover a matched page
    (by, document_id, page_number) first, otherwise in the old order; unchanged without a match."""
    spans = matches.select(*by, "document_id", "page_number").dropDuplicates()
    keyed = ranking.withColumn("_row", F.struct(*by, "rank"))
    hits = keyed.join(spans, [*by, "document_id"]).where(F.col("page_number").between(F.col("page_start"), F.col("page_end"))).select("_row").dropDuplicates().withColumn("matched", F.lit(True))
    marked = keyed.join(hits, "_row", "left").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("_row")
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("matched").desc(), "rank")
    return marked.withColumn("new_rank", F.row_number().over(order).cast("bigint"))


def label_counts(mentions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return mentions.dropDuplicates(["id"]).groupBy(*by, "label").agg(F.count("*").alias("mentions"), F.countDistinct("normalized_text").alias("names"))


def overlapping_mentions(mentions: DataFrame) -> DataFrame:
    """(document_id, page_number, id, char_start, before_end): mentions that begin before one ahead of them on the page
    ends. The furthest end so far counts, so a long mention shows every one inside it."""
    order = Window.partitionBy("document_id", "page_number").orderBy("char_start", "char_end", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = mentions.dropDuplicates(["id"]).withColumn("before_end", F.max("char_end").over(order))
    return seen.where("char_start < before_end").select("document_id", "page_number", "id", "char_start", "before_end")
