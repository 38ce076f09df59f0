"""Benchmark evidence: which passages answer a question, and annotations held against their passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "preannotated", "reviewed")


def resolve_evidence(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(uid, block_id, page_number, char_start, char_end, text, block_text) of questions' evidence.

    questions: uid, document_id, mapping (array of block_id, char_start, char_end), facts (array of texts). blocks:
    document_id, page_number, block_order, block_id, text. Mapped spans are looked up by block; only a question none of
    whose spans has a block falls back to the first block of its document that holds each fact, in any case. Spans
    beyond their block and blank facts are left out.
    """
    place = blocks.select("document_id", "page_number", "block_order", "block_id", F.col("text").alias("block_text"))
    spans = questions.select("uid", "document_id", F.explode("mapping").alias("m")).select("uid", "document_id", "m.*").join(place, ["document_id", "block_id"])
    mapped = spans.where((F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("block_text")))
    mapped = mapped.withColumn("text", F.substring(F.col("block_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    rest = questions.join(mapped.select("uid").distinct(), "uid", "left_anti").select("uid", "document_id", F.explode(F.array_distinct("facts")).alias("fact")).where("trim(fact) <> ''")
    hits = rest.join(place, "document_id").where(F.contains(F.lower("block_text"), F.lower("fact")))
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("uid", "fact").orderBy("page_number", "block_order", "block_id"))).where("n = 1")
    found = first.withColumn("char_start", (F.expr("locate(lower(fact), lower(block_text))") - 1).cast("int")).withColumn("char_end", (F.col("char_start") + F.length("fact")).cast("int")).withColumn("text", F.substring(F.col("block_text"), F.col("char_start") + 1, F.length("fact")))
    columns = ["uid", "block_id", "page_number", "char_start", "char_end", "text", "block_text"]
    return mapped.select(*columns).unionByName(found.select(*columns))


def annotation_problems(passages: DataFrame, annotations: DataFrame, labels: tuple[str, ...] = ("PERSON", "ORGANIZATION", "LOCATION")) -> DataFrame:
    """(id, problem): what is wrong with annotations (id, annotation_status, entities) of passages (id, text).

    `missing` and `unknown` passages, `repeated` ids, a wrong `status`, and of the entities a wrong `label`, `bounds`
    outside the text, a `text` that is not what the passage holds there, and spans `overlapping` the one before.
    """
    ids = passages.select("id").distinct()
    missing = ids.join(annotations.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    unknown = annotations.select("id").distinct().join(ids, "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    repeated = annotations.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    status = annotations.where(~F.coalesce(F.col("annotation_status").isin(*STATUSES), F.lit(False))).select("id", F.lit("status").alias("problem"))
    spans = annotations.select("id", F.explode("entities").alias("e")).select("id", "e.label", "e.start", "e.end", F.col("e.text").alias("said")).join(passages.select("id", "text"), "id")
    bounds = (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("text"))
    held = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    before = F.max("end").over(Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    problem = F.when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "label").when(bounds, "bounds").when(held != F.col("said"), "text").when(F.col("start") < F.col("before"), "overlapping")
    wrong = spans.withColumn("before", before).select("id", problem.alias("problem")).where("problem IS NOT NULL")
    return missing.unionAll(unknown).unionAll(repeated).unionAll(status).unionAll(wrong)


def merged_annotations(passages: DataFrame, annotations: DataFrame, set_reviewed: bool = False) -> DataFrame:
    """passages (id, text) with annotation_status and entities; a set reviewed as a whole reviews every passage. Raises
    with the first problems if the annotations do not fit."""
    found = annotation_problems(passages, annotations).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in found))
    status = F.lit("reviewed") if set_reviewed else F.col("annotation_status")
    return passages.join(annotations.select("id", status.alias("annotation_status"), "entities"), "id")
