"""Fusion of rankings: weighted reciprocal ranks and weighted sums of scores normalised by their maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def candidate_limit(limit: int) -> int:
    """How many candidates each ranking gives for a result of `limit` rows."""
    return max(20, 4 * limit)


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, key: str, keyword_weight: float = 0.5, semantic_weight: float = 0.5, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """by + (key, score, keyword_rank, semantic_rank) of every row of either ranking (by + key, rank).

    A ranking without the row adds nothing. Scores are rounded to 12 places, so that they rank alike on any engine.
    """
    if keyword_weight < 0 or semantic_weight < 0 or keyword_weight + semantic_weight <= 0:
        raise ValueError("weights must not be negative and not both zero")
    if k < 0:
        raise ValueError("k must not be negative")
    a = keyword.select(*by, key, F.col("rank").alias("keyword_rank"))
    b = semantic.select(*by, key, F.col("rank").alias("semantic_rank"))
    part = lambda weight, rank: F.coalesce(F.lit(float(weight)) / (k + F.col(rank)), F.lit(0.0))
    score = F.round(part(keyword_weight, "keyword_rank") + part(semantic_weight, "semantic_rank"), 12)
    return a.join(b, [*by, key], "full_outer").select(*by, key, score.alias("score"), "keyword_rank", "semantic_rank")


def result_order(key: str, cap: int) -> list[Column]:
    """Best score, then keyword rank, then semantic rank (a missing one last), then key."""
    return [F.col("score").desc(), F.coalesce("keyword_rank", F.lit(cap + 1)), F.coalesce("semantic_rank", F.lit(cap + 1)), F.col(key)]


def best(fused: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` rows of a fused ranking with their rank, from a result capped at `candidate_limit`."""
    order = result_order(key, candidate_limit(limit))
    return fused.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def max_normalised(score: Column, over: Window | None = None) -> Column:
    """Scores in parts of the largest, negative ones 0; all 0 if none is positive. Null counts as 0."""
    top = F.max(score).over(over if over is not None else Window.partitionBy())
    return F.when(top > 0, F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)) / top).otherwise(0.0)


def weighted_sum(keyword: DataFrame, semantic: DataFrame, key: str, keyword_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """(key, score, keyword_score, semantic_score) of all rows of either (key, score), normalised by their maxima.

    The maxima are one aggregate row of the joined scores that is broadcast, so no window gathers all rows in one task,
    and the joined sides are shuffled once for both.
    """
    sides = keyword.select(key, F.col("score").alias("a")).join(semantic.select(key, F.col("score").alias("b")), key, "full_outer")
    both = sides.join(F.broadcast(sides.agg(F.max("a").alias("top_a"), F.max("b").alias("top_b"))))
    scaled = lambda score, top: F.when(F.col(top) > 0, F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0)) / F.col(top)).otherwise(0.0)
    both = both.select(key, scaled("a", "top_a").alias("keyword_score"), scaled("b", "top_b").alias("semantic_score"))
    return both.select(key, (keyword_weight * F.col("keyword_score") + semantic_weight * F.col("semantic_score")).alias("score"), "keyword_score", "semantic_score")


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame, names: DataFrame, statuses: tuple[str, ...] = ("indexed_lexical", "ready")) -> DataFrame:
    """The ranked chunks (chunk_id, ...) with their text, pages and document name, if the document may be searched.

    The gate comes after ranking: ranks keep their gaps and fewer rows than asked for may come out. `ranked` is a short
    list, so it is the side to broadcast; the name is the latest upload's, or the document's id.
    """
    latest = names.groupBy("document_id").agg(F.max_by("original_filename", "id").alias("latest_name"))
    rows = chunks.select(F.col("id").alias("chunk_id"), "document_id", "text", "page_start", "page_end").join(F.broadcast(ranked), "chunk_id")
    gated = rows.join(documents.where(F.col("status").isin(*statuses)).select(F.col("id").alias("document_id")), "document_id")
    return gated.join(latest, "document_id", "left").withColumn("document_name", F.coalesce("latest_name", "document_id")).drop("latest_name")
