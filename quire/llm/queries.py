"""The queries of this subpackage and, where SQL can state one, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import characters, encoding, leakage, names, pairs, scans, splitting, stuffing
from quire.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_defects(table(spark, folder, "pages"), table(spark, folder, "blocks"), table(spark, folder, "entity_mentions"))


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.page_paragraphs(table(spark, folder, "pages"), table(spark, folder, "blocks"), table(spark, folder, "entity_mentions"), over_pages=True)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return characters.deviating_items(table(spark, folder, "pages"), table(spark, folder, "entity_mentions"))


def p2_consistent(spark: SparkSession, folder: str) -> DataFrame:
    items = characters.items(table(spark, folder, "pages"), table(spark, folder, "entity_mentions"))
    return characters.consistent_texts(items, ["item_kind", "item_id"], "text").select("item_kind", "item_id", "consistent")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    passages = table(spark, folder, "benchmark_queries").select(F.explode("evidence.block_text").alias("text"))
    return pairs.defective_pairs(table(spark, folder, "generation_results"), passages)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_entity_pairs(table(spark, folder, "entity_mentions"))


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.linked_names(table(spark, folder, "entity_mentions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_items(table(spark, folder, "blocks"), table(spark, folder, "chunks"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.piece_rows(table(spark, folder, "blocks"), table(spark, folder, "chunks"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    passages = leakage.passage_list(table(spark, folder, "benchmark_queries"))
    return leakage.leaking(table(spark, folder, "documents"), passages).select("doc_id", "uid")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_consistent, p3_found, p4_found, p4_entities, p5_found, p5_pieces, p6_ids, p7_found, p8_found)}


#: A word is what stands between Unicode white space, as in the operator.
WORDS = r"len(regexp_extract_all(text, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": rf"""
            SELECT DISTINCT item_kind, item_id FROM (
                SELECT 'page' AS item_kind, id AS item_id, text FROM pages
                UNION ALL SELECT 'mention', id, normalized_text FROM entity_mentions)
            WHERE regexp_matches(text, '[\x{{ff01}}-\x{{ff5e}}\x{{ffe0}}-\x{{ffe6}}\x{{fb00}}-\x{{fb06}}\x{{fb13}}-\x{{fb17}}]|\pL\pM*\p{{Mn}}|[\p{{Cf}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{3164}}\x{{ffa0}}]')
                OR regexp_matches(replace(text, ' ', ''), '\p{{Zs}}')
                OR len(list_filter(regexp_extract_all(text, '[\pL\pM\pN\p{{Cf}}]+'), lambda t:
                    regexp_matches(t, '\p{{Latin}}') AND regexp_matches(t, '[\p{{Cyrillic}}\p{{Greek}}\p{{Armenian}}\p{{Cherokee}}\p{{Lisu}}]'))) > 0""",
        "p5_found": f"""
            SELECT DISTINCT item_kind, item_id FROM (
                SELECT 'block' AS item_kind, CAST(id AS VARCHAR) AS item_id, text FROM blocks
                UNION ALL SELECT 'chunk', id, text FROM chunks)
            WHERE length(text) > 1200 OR {WORDS} > 120""",
    }
