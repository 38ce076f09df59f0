"""Measures of retrieval, entity recognition, recognised text and answers, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ascii_tokens, close_numbers, contains_tokens, normalized, numbers, word_edits

CUTOFFS = (1, 3, 5, 10)

# ------------------------------------------------------------------------------------------------ retrieval


def relevance_grades(chunks: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query_id, chunk_id, grade) of every chunk in a judged document; in other documents the grade is 0 and left out.

    judgments: query_id, document_id, relevant_pages (array), evidence_texts (array). 1 if the chunk covers a relevant
    page, 2 if it also holds the tokens of an evidence text. A join on the document, not of all chunks with all queries.
    """
    pairs = chunks.select(F.col("id").alias("chunk_id"), "document_id", ascii_tokens(F.col("text")).alias("tokens"), "page_start", "page_end").join(judgments.select("query_id", "document_id", "relevant_pages", F.transform("evidence_texts", ascii_tokens).alias("wanted")), "document_id")
    covers = F.exists("relevant_pages", lambda p: p.between(F.col("page_start"), F.col("page_end")))
    holds = F.exists("wanted", lambda w: contains_tokens(F.col("tokens"), w))
    return pairs.select("query_id", "chunk_id", F.when(~F.coalesce(covers, F.lit(False)), 0).when(F.coalesce(holds, F.lit(False)), 2).otherwise(1).alias("grade"))


def covering_pairs(chunks: DataFrame, judgments: DataFrame) -> DataFrame:
    """The columns of both sides, but relevant_pages, of the pairs of a document whose chunk covers a relevant page: those that
    relevance_grades grades above 0, without the many others of a large document being made.

    A chunk's pages lie in one or two cells, aligned runs of 2**level pages, of the least level that is as long as they are;
    each relevant page looks into its cell of every level there is (broadcast, at most 33). A pair is taken at the first of
    its relevant pages only, so that each row of chunks counts once. Both sides keep their columns, of different names.
    """
    span = F.col("page_end").cast("bigint") - F.col("page_start")
    level = F.when(span > 0, F.length(F.bin(span))).otherwise(0).alias("_level")
    spans = chunks.where("page_start <= page_end")
    cells = spans.select("*", level).select("*", F.explode(F.expr("array_distinct(array(shiftright(bigint(page_start), _level), shiftright(bigint(page_end), _level)))")).alias("_cell"))
    pages = F.array_sort(F.array_distinct(F.filter("relevant_pages", lambda p: p.isNotNull()))).cast("array<bigint>")
    others = [c for c in judgments.columns if c != "relevant_pages"]
    looked = judgments.select(*others, F.explode(F.arrays_zip(pages.alias("page"), F.concat(F.array(F.lit(None).cast("bigint")), pages).alias("before"))).alias("_at")).where("_at.page IS NOT NULL")
    looked = looked.join(F.broadcast(spans.select(level).distinct())).withColumn("_cell", F.expr("shiftright(_at.page, _level)"))
    first = F.col("_at.page").between(F.col("page_start"), F.col("page_end")) & F.coalesce(F.col("_at.before") < F.col("page_start"), F.lit(True))
    return looked.join(cells, ["document_id", "_level", "_cell"]).where(first).drop("_level", "_cell", "_at")


def relevant_chunks(chunks: DataFrame, judgments: DataFrame, *keep: str) -> DataFrame:
    """(query_id, chunk_id, grade, keep) of the pairs that relevance_grades grades above 0; `keep` are columns of chunks.

    The tokens of a chunk and of an evidence text are made once, and not again for each pair.
    """
    line = lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    wanted = F.array_distinct(F.transform(F.filter(F.transform("evidence_texts", ascii_tokens), lambda t: F.size(t) > 0), line))
    lines = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_start", "page_end", line(ascii_tokens(F.col("text"))).alias("line"), *keep)
    pairs = covering_pairs(lines, judgments.select("query_id", "document_id", "relevant_pages", wanted.alias("wanted")))
    holds = F.exists("wanted", lambda w: F.contains(F.col("line"), w))
    return pairs.select("query_id", "chunk_id", F.when(F.coalesce(holds, F.lit(False)), 2).otherwise(1).alias("grade"), *keep)


def grade_counts(chunks: DataFrame, judgments: DataFrame) -> DataFrame:
    """(grade, pairs) over what relevance_grades gives. Pairs of grade 0 are a document's chunks times its judgments, less
    those of the other grades, and are not made one by one."""
    found = relevant_chunks(chunks, judgments).groupBy("grade").agg(F.count("*").alias("pairs"))
    both = chunks.groupBy("document_id").agg(F.count("*").alias("n")).join(judgments.groupBy("document_id").agg(F.count("*").alias("m")), "document_id")
    parts = found.select(F.inline(F.array(F.struct("grade", "pairs"), F.struct(F.lit(0).alias("grade"), (-F.col("pairs")).alias("pairs"))))).unionAll(both.select(F.lit(0), F.col("n") * F.col("m")))
    return parts.groupBy("grade").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def ranking_metrics(ranked: DataFrame, grades: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, query: str = "query_id", item: str = "chunk_id", strict: bool = False) -> DataFrame:
    """A row per query: recall@k, hit@k, evidence_hit@k for each cutoff, mrr and ndcg at the largest.

    ranked: query, item, rank. grades: query, item, grade of all items, not only ranked ones, as recall and the ideal
    ranking need them; an ungraded item counts as 0. evidence_hit is null where no item has grade 2. A query without
    relevant items has no row, or raises with `strict`.
    """
    if not cutoffs or min(cutoffs) <= 0:
        raise ValueError("cutoffs must be positive")
    last = max(cutoffs)
    if strict and not grades.groupBy(query).agg(F.max("grade").alias("g")).where("g <= 0").isEmpty():
        raise ValueError("a query has no relevant item")
    relevant = grades.where("grade > 0")
    ideal = relevant.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.col("grade").desc(), item))).groupBy(query).agg(
        F.count("*").alias("n_relevant"), F.max((F.col("grade") == 2).cast("int")).alias("any_evidence"), F.sum(F.when(F.col("place") <= last, gain(F.col("grade")) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal")
    )
    hits = ranked.where(F.col("rank") <= last).select(query, item, "rank").join(relevant, [query, item])
    found = hits.groupBy(query).agg(
        F.min("rank").alias("first"), F.min(F.when(F.col("grade") == 2, F.col("rank"))).alias("first_evidence"), F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"), *[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in cutoffs]
    )
    return _metric_columns(ideal.join(found, query, "left"), cutoffs, query)


def graded_ranking_metrics(graded: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, query: str = "query_id") -> DataFrame:
    """What ranking_metrics gives, of rows (query, rank, grade) that hold every relevant item with its rank: nothing is joined,
    and rows of the same item count apart."""
    if not cutoffs or min(cutoffs) <= 0:
        raise ValueError("cutoffs must be positive")
    last = max(cutoffs)
    gained = lambda place: F.sum(F.when(F.col(place) <= last, gain(F.col("grade")) / F.log2(F.col(place) + 1)).otherwise(0.0))
    placed = graded.where("grade > 0").withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.col("grade").desc())))
    return _metric_columns(placed.groupBy(query).agg(
        F.count("*").alias("n_relevant"), F.max((F.col("grade") == 2).cast("int")).alias("any_evidence"), gained("place").alias("ideal"), F.min(F.when(F.col("rank") <= last, F.col("rank"))).alias("first"),
        F.min(F.when((F.col("rank") <= last) & (F.col("grade") == 2), F.col("rank"))).alias("first_evidence"), gained("rank").alias("dcg"), *[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in cutoffs]
    ), cutoffs, query)


def _metric_columns(both: DataFrame, cutoffs: tuple[int, ...], query: str) -> DataFrame:
    at = lambda column, k: F.coalesce((F.col(column) <= k).cast("double"), F.lit(0.0))
    columns = [c for k in cutoffs for c in (
        (F.coalesce(f"n_{k}", F.lit(0)) / F.col("n_relevant")).alias(f"recall_{k}"),
        at("first", k).alias(f"hit_{k}"),
        F.when(F.col("any_evidence") == 1, at("first_evidence", k)).alias(f"evidence_hit_{k}"),
    )]
    return both.select(query, *columns, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def mean_metrics(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means over the rows that have a value; null where none has."""
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def reciprocal_rank(ranked: DataFrame, cutoff: int = 5, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, rr) of ranked rows (by, rank, grade): 1 / rank of the first relevant one within the cutoff, else 0."""
    if cutoff <= 0:
        raise ValueError("cutoff must be positive")
    return ranked.groupBy(*by).agg(F.coalesce(1.0 / F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= cutoff), F.col("rank"))), F.lit(0.0)).alias("rr"))


def paired_summary(clean: DataFrame, degraded: DataFrame, strict: bool = False, query: str = "query_id") -> DataFrame:
    """One row: queries, mean rr of either side (query, rr), mean difference, wins, ties and losses of the degraded side.

    The same queries must be on both sides: one on a single side makes `unpaired` positive, or raises with `strict`.
    """
    both = clean.select(query, F.col("rr").alias("a")).join(degraded.select(query, F.col("rr").alias("b")), query, "full_outer")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("queries"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"), F.avg("a").alias("clean_mrr"), F.avg("b").alias("degraded_mrr"), F.avg(F.col("b") - F.col("a")).alias("mean_delta"), F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") == F.col("a")).alias("ties"), F.count_if(F.col("b") < F.col("a")).alias("losses"))
    if strict and out.first()["unpaired"]:
        raise ValueError("the two sides do not have the same queries")
    return out


# ------------------------------------------------------------------------------------------------ spans


def scored(rows: DataFrame) -> DataFrame:
    """Counts of true and false positives and negatives with precision, recall and f1, 0 where nothing is divided."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return rows.select("*", precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def strict_span_metrics(references: DataFrame, predictions: DataFrame, passage: tuple[str, ...] = ("passage_id",)) -> DataFrame:
    """(label, true_positives, false_positives, false_negatives, precision, recall, f1); label null is all of them.

    A span counts if label, start and end agree in the same passage; without `passage` columns the spans of all passages
    are pooled. Repeated spans count once.
    """
    key = [*passage, "label", "start", "end"]
    both = references.select(*key).distinct().withColumn("r", F.lit(1)).join(predictions.select(*key).distinct().withColumn("p", F.lit(1)), key, "full_outer")
    counted = both.groupingSets([[F.col("label")], []], F.col("label")).agg(F.count_if(F.col("r").isNotNull() & F.col("p").isNotNull()).alias("true_positives"), F.count_if(F.col("r").isNull()).alias("false_positives"), F.count_if(F.col("p").isNull()).alias("false_negatives"))
    return scored(counted)


def relaxed_span_metrics(references: DataFrame, predictions: DataFrame, passage: str = "passage_id") -> DataFrame:
    """Like strict_span_metrics, but an overlap of the same label counts: each reference, by `seq`, takes the first
    prediction, by `seq`, that overlaps it and is not taken. A passage's spans of a label are one group."""
    spans = lambda df: F.sort_array(F.collect_list(F.struct("seq", "start", "end")))
    r = references.groupBy(passage, "label").agg(spans(references).alias("r"))
    p = predictions.groupBy(passage, "label").agg(spans(predictions).alias("p"))
    empty = F.array().cast("array<struct<seq:bigint,start:bigint,end:bigint>>")
    kind = "array<struct<seq:bigint,start:bigint,end:bigint>>"
    both = r.join(p, [passage, "label"], "full_outer").select("label", F.coalesce(F.col("r").cast(kind), empty).alias("r"), F.coalesce(F.col("p").cast(kind), empty).alias("p"))

    def take(left: Column, ref: Column) -> Column:
        hit = F.try_element_at(F.filter(left, lambda x: (x["start"] < ref["end"]) & (ref["start"] < x["end"])), F.lit(1))
        return F.when(hit.isNull(), left).otherwise(F.filter(left, lambda x: x != hit))

    left = F.size(F.aggregate("r", F.col("p"), take))
    rows = both.select("label", (F.size("p") - left).alias("tp"), left.alias("fp"), (F.size("r") - (F.size("p") - left)).alias("fn"))
    return scored(rows.groupingSets([[F.col("label")], []], F.col("label")).agg(F.sum("tp").alias("true_positives"), F.sum("fp").alias("false_positives"), F.sum("fn").alias("false_negatives")))


# ------------------------------------------------------------------------------------------------ recognised text


def error_counts(rows: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """rows with characters, character_edits, words, word_edits; an absent prediction counts as empty."""
    guess = F.coalesce(F.col(prediction), F.lit(""))
    counted = rows.withColumns({"characters": F.length(reference), "character_edits": F.levenshtein(F.col(reference), guess), "words": F.regexp_count(reference, F.lit(r"(?U)\S+"))})
    return counted.withColumn("word_edits", word_edits(F.col(reference), guess))


def error_rates(counted: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Error rates over grouping sets: sums of edits over sums of lengths, failures, mean and nearest-rank p95 latency."""
    return counted.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.count("*").alias("samples"), F.try_divide(F.sum("character_edits"), F.sum("characters")).alias("cer"), F.try_divide(F.sum("word_edits"), F.sum("words")).alias("wer"), F.count_if(F.col("error").isNotNull()).alias("failures"), F.avg("latency_ms").alias("mean_ms"), F.percentile_disc(0.95).withinGroup(F.col("latency_ms")).alias("p95_ms") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms")
    )


# ------------------------------------------------------------------------------------------------ answers


def token_f1(prediction: Column, reference: Column) -> Column:
    """Harmonic mean of shared tokens over both; 1 if both are empty, 0 if one is."""
    of = lambda x: F.filter(F.split(normalized(F.coalesce(x, F.lit(""))), " "), lambda t: t != "")
    p, r = of(prediction), of(reference)
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    overlap = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(r, w)))
    return F.when((F.size(p) == 0) | (F.size(r) == 0), (F.size(p) == F.size(r)).cast("double")).otherwise(2.0 * overlap / (F.size(p) + F.size(r)))


def reference_coverage(prediction: Column, texts: Column, figures: Column) -> Column:
    """Share of the references found in the prediction: a text as a part of its words' line, a figure within tolerance.

    texts array<string>, figures array<double>; nulls in them count as not found; no prediction or reference gives 0.
    """
    line, own = normalized(prediction), numbers(prediction)
    text_hits = F.size(F.filter(texts, lambda t: (normalized(t) != "") & F.contains(line, normalized(t))))
    figure_hits = F.size(F.filter(figures, lambda f: F.exists(own, lambda v: close_numbers(v, f))))
    total = F.greatest(F.size(texts), F.lit(0)) + F.greatest(F.size(figures), F.lit(0))
    return F.when(prediction.isNull() | (prediction == "") | (total == 0), 0.0).otherwise((F.greatest(text_hits, F.lit(0)) + F.greatest(figure_hits, F.lit(0))).cast("double") / total)


def generation_scorecard(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per `by`) of rates over results; denominators of at least 1, so a rate over nothing is 0."""
    answerable, unanswerable = F.col("expected_status") == "answered", F.col("expected_status") == "insufficient_evidence"
    available = F.coalesce("retrieval_evidence_available", F.lit(False))
    rate = lambda hit, among: F.count_if(hit & among) / F.greatest(F.count_if(among), F.lit(1))
    mean = lambda value, among: F.coalesce(F.sum(F.when(among, F.col(value))), F.lit(0.0)) / F.greatest(F.count_if(among), F.lit(1))
    everything = F.lit(True)
    cited = answerable & F.col("evidence_page_citation_relevance").isNotNull()
    return results.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.count_if(answerable).alias("answerable_questions"),
        F.count_if(unanswerable).alias("unanswerable_questions"),
        rate(F.col("status") != "generation_failed", everything).alias("valid_generation_rate"),
        rate(F.col("status") == F.col("expected_status"), everything).alias("end_to_end_status_accuracy"),
        rate(F.col("status") == F.col("context_expected_status"), everything).alias("context_status_accuracy"),
        mean("reference_coverage", answerable).alias("answerable_reference_coverage"),
        mean("reference_coverage", answerable & available).alias("retrieval_conditioned_reference_coverage"),
        mean("token_f1", answerable).alias("answerable_token_f1"),
        rate(F.col("status") == "insufficient_evidence", unanswerable).alias("refusal_accuracy"),
        rate(F.col("status") == "answered", ~available).alias("unsupported_answer_rate"),
        mean("evidence_page_citation_relevance", cited).alias("evidence_page_citation_relevance"),
        rate(available, answerable).alias("retrieval_evidence_available_rate"),
        F.avg("latency_ms").alias("mean_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"),
    )
