"""Evaluation of whole searches and benchmarks: every query in every mode, reranking, contexts, strata, and their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import entities, fusion, metrics

MODES = ("keyword", "semantic", "hybrid")


def mode_rankings(keyword: DataFrame, semantic: DataFrame, limit: int = 10, query: str = "query_id", item: str = "chunk_id", keyword_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """(mode, query, item, rank) up to `limit` of either ranking (query, item, rank) and of both fused.

    The single modes are cut at `limit`; for the fused one both rankings should hold fusion.candidate_limit(limit) rows.
    """
    cap = fusion.candidate_limit(limit)
    fused = fusion.reciprocal_rank_fusion(keyword.where(F.col("rank") <= cap), semantic.where(F.col("rank") <= cap), item, keyword_weight, semantic_weight, by=(query,))
    hybrid = fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*fusion.result_order(item, cap))).cast("bigint"))
    of = lambda mode, df: df.where(F.col("rank") <= limit).select(F.lit(mode).alias("mode"), query, item, F.col("rank").cast("bigint").alias("rank"))
    return of("keyword", keyword).unionAll(of("semantic", semantic)).unionAll(of("hybrid", hybrid))


def mode_metrics(rankings: DataFrame, grades: DataFrame, modes: tuple[str, ...] = MODES, query: str = "query_id", item: str = "chunk_id", strict: bool = False) -> DataFrame:
    """(mode, query, relevant_chunks, evidence_chunks, measures of metrics.ranking_metrics) of every query with a relevant item.

    A query without one has no row, or raises with `strict`; a mode that finds nothing for a query has a row of zeros.
    """
    relevant = grades.where("grade > 0")
    if strict and not grades.select(query).distinct().join(relevant, query, "left_anti").isEmpty():
        raise ValueError("a query has no relevant item")
    key = F.concat_ws("\0", "mode", query).alias("_key")
    by_mode = relevant.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))).select(key, item, "grade")
    rows = metrics.ranking_metrics(rankings.select(key, item, "rank"), by_mode, query="_key", item=item)
    counts = relevant.groupBy(query).agg(F.count("*").alias("relevant_chunks"), F.count_if(F.col("grade") == 2).alias("evidence_chunks"))
    parts = F.split("_key", "\0", 2)
    return rows.select(parts[0].alias("mode"), parts[1].alias(query), *[c for c in rows.columns if c != "_key"]).join(counts, query)


def padded_metrics(ranked: DataFrame, counts: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """metrics.ranking_metrics of rankings that carry their own grades (query, item, rank, grade).

    counts (query, relevant_chunks, evidence_chunks) tells how many items are relevant and how many of those are evidence
    in the whole corpus; those that a ranking lacks are made up, so that recall and the ideal ranking stay the corpus's.
    """
    own = ranked.groupBy(query).agg(F.count_if(F.col("grade") > 0).alias("own_relevant"), F.count_if(F.col("grade") == 2).alias("own_evidence"))
    lacking = counts.join(own, query, "left").fillna(0, ["own_relevant", "own_evidence"])
    twos = F.greatest(F.lit(0), F.col("evidence_chunks") - F.col("own_evidence")).cast("int")
    ones = F.greatest(F.lit(0), F.col("relevant_chunks") - F.col("evidence_chunks") - (F.col("own_relevant") - F.col("own_evidence"))).cast("int")
    made = lacking.select(query, F.explode(F.concat(F.array_repeat(F.lit(2), twos), F.array_repeat(F.lit(1), ones))).alias("grade"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("grade").desc()))
    padding = made.select(query, F.concat(F.lit("\0missing "), place.cast("string")).alias(item), "grade")
    return metrics.ranking_metrics(ranked.select(query, item, "rank"), ranked.select(query, F.col(item).cast("string").alias(item), "grade").unionAll(padding), query=query, item=item)


def rerank_evaluation(ranked: DataFrame, query_entities: DataFrame, matches: DataFrame, counts: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, has_entities, has_matches, changed, mrr, ndcg, new_mrr, new_ndcg): each query's ranking before and after its
    chunks on matched pages are moved ahead.

    ranked: query, chunk_id, document_id, page_start, page_end, rank, grade. query_entities: query. matches: query,
    document_id, page_number. counts as for padded_metrics, a row per query.
    """
    moved = entities.page_rerank(ranked, matches, (query,))
    changed = moved.groupBy(query).agg(F.max(F.col("new_rank") != F.col("rank")).alias("changed"))
    before = padded_metrics(ranked, counts, query).select(query, "mrr", "ndcg")
    after = padded_metrics(moved.drop("rank").withColumnRenamed("new_rank", "rank"), counts, query).select(query, F.col("mrr").alias("new_mrr"), F.col("ndcg").alias("new_ndcg"))
    flag = lambda df, name: df.select(query).distinct().withColumn(name, F.lit(True))
    rows = counts.select(query).join(flag(query_entities, "has_entities"), query, "left").join(flag(matches, "has_matches"), query, "left").join(changed, query, "left").join(before, query, "left").join(after, query, "left")
    return rows.fillna(False, ["has_entities", "has_matches", "changed"]).select(query, "has_entities", "has_matches", "changed", "mrr", "ndcg", "new_mrr", "new_ndcg")


def query_coverage(evaluated: DataFrame) -> DataFrame:
    """One row of rerank_evaluation's queries: how many have entities and matches, how many rankings changed, the means of
    both sides and their difference."""
    rows = evaluated.agg(F.count("*").alias("queries"), *[F.count_if(c).alias(n) for c, n in (("has_entities", "with_entities"), ("has_matches", "with_matches"), ("changed", "rankings_changed"))], *[F.avg(c).alias(c) for c in ("mrr", "ndcg", "new_mrr", "new_ndcg")])
    return rows.withColumns({"mrr_delta": F.col("new_mrr") - F.col("mrr"), "ndcg_delta": F.col("new_ndcg") - F.col("ndcg")})


def context_expectations(questions: DataFrame, contexts: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, retrieval_evidence_available, context_expected_status) of questions (query, document_id, relevant_pages).

    Evidence is available if one of the question's contexts (query, document_id, page_start, page_end) is of its document
    and covers a relevant page. A question without a document or contexts has none.
    """
    pages = questions.select(query, "document_id", F.explode("relevant_pages").alias("page"))
    hits = contexts.select(query, "document_id", "page_start", "page_end").join(pages, [query, "document_id"]).where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    rows = questions.select(query).distinct().join(hits.select(query).distinct().withColumn("hit", F.lit(True)), query, "left")
    available = F.coalesce("hit", F.lit(False))
    return rows.select(query, available.alias("retrieval_evidence_available"), F.when(available, "answered").otherwise("insufficient_evidence").alias("context_expected_status"))


def with_gold(queries: DataFrame, gold: DataFrame, documents: DataFrame, strict: bool = True) -> DataFrame:
    """`queries` (uid, document_uid, question, ...) with gold's other columns and `agrees`, whether both have the same question.

    gold: uid, question, .... Queries whose document is not in `documents` (document_uid) or that gold lacks are left out;
    these, and questions that differ, raise with `strict`.
    """
    known = queries.join(documents.select("document_uid").distinct(), "document_uid", "left_semi")
    joined = known.join(gold.withColumnRenamed("question", "gold_question"), "uid").withColumn("agrees", F.col("question").eqNullSafe(F.col("gold_question"))).drop("gold_question")
    if strict:
        if not joined.where("NOT agrees").isEmpty():
            raise ValueError("a question differs from its gold one")
        if not queries.join(joined.select("uid"), "uid", "left_anti").isEmpty():
            raise ValueError("a query has no gold answer or document")
    return joined


def with_unanswerable(selected: DataFrame, questions: list[tuple[str, str]]) -> DataFrame:
    """`selected` (uid, question, answer_type, document_uid, ...) with expected_status `answered`, and after them `questions`
    (uid, question) that no document answers."""
    rows = selected.withColumn("expected_status", F.lit("answered"))
    asked = selected.sparkSession.createDataFrame(questions, "uid string, question string").withColumns({"answer_type": F.lit("unanswerable"), "expected_status": F.lit("insufficient_evidence")})
    return rows.unionByName(asked, allowMissingColumns=True)


def coverage_by(results: DataFrame, manifest: DataFrame, key: str = "uid", by: str = "answer_type") -> DataFrame:
    """(by, results, reference_coverage): mean coverage of the answerable results by what `manifest` (key, by) says of them.

    A left join: results that the manifest does not know, or has no `by` for, are left out of the means.
    """
    joined = results.where("expected_status = 'answered'").join(manifest.select(key, by).where(F.col(by).isNotNull()).dropDuplicates(), key, "left")
    return joined.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("results"), F.avg("reference_coverage").alias("reference_coverage"))


def strict_by_stratum(references: DataFrame, predictions: DataFrame, strata: DataFrame, passage: str = "passage_id") -> DataFrame:
    """(stratum, true_positives, ..., f1): strict span measures of all labels together, by the stratum of their passage.

    strata: passage, stratum. Strata without a span on either side have no row.
    """
    placed = lambda df: df.join(strata.select(passage, "stratum"), passage).select("stratum", passage, "label", "start", "end").distinct()
    both = placed(references).withColumn("r", F.lit(1)).join(placed(predictions).withColumn("p", F.lit(1)), ["stratum", passage, "label", "start", "end"], "full_outer")
    counted = both.groupBy("stratum").agg(F.count_if(F.col("r").isNotNull() & F.col("p").isNotNull()).alias("true_positives"), F.count_if(F.col("r").isNull()).alias("false_positives"), F.count_if(F.col("p").isNull()).alias("false_negatives"))
    return metrics.scored(counted)
