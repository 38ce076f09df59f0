"""Reproducible samples: rows ordered by a hash of a seed and their key, so that no order of input matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import compatibility_form, key_of, word_count

SEED = "quire-sample-v1"
#: Fixed value: two capitalised words, or words in capitals, one after the other.
PROPER_NAME = r"\b(?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,}))+\b"


def stable_key(seed: str, *parts: Column) -> Column:
    return key_of(F.lit(seed), *parts)


def first_per_stratum(rows: DataFrame, strata: list[str], key: Column, quota: int, strict: bool = False) -> DataFrame:
    """The `quota` rows of smallest key of every stratum, with `sample_key` and `place`; short strata give what they
    have, or raise with `strict`. Spark keeps only the first rows of each stratum before it shuffles them."""
    keyed = rows.withColumn("sample_key", key)
    ranked = keyed.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy("sample_key")).cast("bigint")).where(F.col("place") <= quota)
    if strict and not ranked.groupBy(*strata).count().where(F.col("count") < quota).isEmpty():
        raise ValueError("a stratum has fewer rows than its quota")
    return ranked


def quota_sample(rows: DataFrame, stratum: str, quotas: dict[str, int], key: Column) -> DataFrame:
    """For each value of `stratum` named in `quotas`, so many rows of smallest key; other values have none."""
    sizes = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    ranked = rows.where(F.col(stratum).isin(*quotas)).withColumn("sample_key", key).withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("sample_key")).cast("bigint"))
    return ranked.where(F.col("place") <= F.try_element_at(sizes, F.col(stratum)))


def mixed_documents(documents: DataFrame, pages: DataFrame, count: int, multipage: int, seed: str = SEED) -> DataFrame:
    """(document_id, page_count): `multipage` documents of several pages and the rest up to `count` of one page."""
    if not 0 <= multipage <= count:
        raise ValueError("multipage must be between 0 and count")
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("page_count")).join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    kinds = sizes.withColumn("kind", F.when(F.col("page_count") > 1, "several").otherwise("one"))
    return quota_sample(kinds, "kind", {"several": multipage, "one": count - multipage}, stable_key(seed, F.lit("document"), F.col("document_id"))).select("document_id", "page_count")


def eligible_passage(text: Column) -> Column:
    """40 to 1,500 characters and at least six words; null is not eligible."""
    return F.coalesce(F.length(text).between(40, 1500) & (word_count(text) >= 6), F.lit(False))


def likely_entity(text: Column) -> Column:
    return F.coalesce(text.rlike(PROPER_NAME), F.lit(False))


def passage_pairs(blocks: DataFrame, pages: DataFrame, seed: str = SEED) -> DataFrame:
    """(document_id, page_number, block_id, text, stratum): per document its first eligible passage with a likely name,
    as `challenge`, and its first other one, as `general`. Documents that lack either come out incomplete or not at all."""
    source = blocks.dropDuplicates(["id"]).join(pages.select(F.col("id").alias("page_id"), "page_number"), "page_id").select("document_id", "page_number", F.col("id").alias("block_id"), compatibility_form("text").alias("text"))
    keyed = source.where(eligible_passage(F.col("text"))).withColumn("sample_key", stable_key(seed, F.col("document_id"), F.col("page_number"), F.col("block_id"), F.col("text"))).withColumn("named", likely_entity(F.col("text")))
    challenge = keyed.where("named").groupBy("document_id").agg(F.min_by(F.struct("page_number", "block_id", "text"), "sample_key").alias("p"), F.min("sample_key").alias("challenge_key"))
    general = keyed.join(challenge.select("document_id", "challenge_key"), "document_id").where("sample_key <> challenge_key").groupBy("document_id").agg(F.min_by(F.struct("page_number", "block_id", "text"), "sample_key").alias("p"))
    both = challenge.select("document_id", "p", F.lit("challenge").alias("stratum")).unionAll(general.select("document_id", "p", F.lit("general").alias("stratum")))
    return both.select("document_id", "p.page_number", "p.block_id", "p.text", "stratum")


def line_category(text: Column) -> Column:
    """`number_heavy`, `prose` or null for a line: of 45 to 220 characters and six words or more, the first with four
    digits that are 8 % of its letters and digits, the second without digits and with 35 letters."""
    letters, digits = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Nd}"))
    fits = F.length(text).between(45, 220) & (word_count(text) >= 6)
    heavy = (digits >= 4) & (digits >= 0.08 * (letters + digits))
    return F.when(~fits, None).when(heavy, "number_heavy").when((digits == 0) & (letters >= 35), "prose")


def visible(x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column) -> Column:
    return (x0 >= 0) & (x0 < x1) & (x1 <= width) & (top >= 0) & (top < bottom) & (bottom <= height)


def line_sample(blocks: DataFrame, pages: DataFrame, per_category: int = 6, seed: str = SEED) -> DataFrame:
    """(category, document_id, block_id, text, place): per category so many visible lines, one per document at most."""
    page = pages.select(F.col("id").alias("page_id"), "page_number", "width", "height")
    lines = blocks.dropDuplicates(["id"]).join(page, "page_id").where(visible(*map(F.col, ("x0", "top", "x1", "bottom", "width", "height"))))
    lines = lines.withColumn("category", line_category(F.col("text"))).where("category IS NOT NULL").withColumn("sample_key", stable_key(seed, F.col("document_id"), F.col("page_number"), F.col("block_order"), F.col("text")))
    first = lines.groupBy("category", "document_id").agg(F.min_by(F.struct(F.col("id").alias("block_id"), "text"), "sample_key").alias("b"), F.min("sample_key").alias("sample_key"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("sample_key")).cast("bigint"))
    return ranked.where(F.col("place") <= per_category).select("category", "document_id", "b.block_id", "b.text", "place")


def blinded(rows: DataFrame, candidate: str, item: str, seed: str = SEED) -> DataFrame:
    """rows with `alias` (Candidate A, B, ... in hash order of the candidates) and `review_id`, sorted by nothing.

    There are few candidates: their aliases are one small table that is broadcast."""
    names = rows.select(candidate).distinct().withColumn("alias", F.concat(F.lit("Candidate "), F.char(F.lit(64) + F.row_number().over(Window.orderBy(stable_key(seed, F.col(candidate)))))))
    return rows.join(F.broadcast(names), candidate).withColumn("review_id", F.substring(stable_key(seed, F.col("alias"), F.col(item)), 1, 16))
