"""Lexical search: postings as DataFrames and two BM25 scores, for one query or a block of queries at once."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import ascii_tokens, index_terms, index_tokens, query_terms, stemmed_terms

K1, B = 1.2, 0.75
#: The full-text engine's floor for a term that half of all texts hold.
FLOOR = 1e-6
#: A block of queries is scored in one pass over the texts.
QUERY_BLOCK = 2048


def postings(texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, len, term, tf): term counts of every text; texts without tokens have no rows."""
    listed = texts.select(F.col(key), tokens.alias("tokens")).select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return listed.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(texts: DataFrame, tokens: Column) -> DataFrame:
    """One row (n_texts, avg_len); a text without tokens counts with length 0."""
    return texts.select(F.coalesce(F.size(tokens), F.lit(0)).alias("len")).agg(F.count("*").alias("n_texts"), F.avg("len").alias("avg_len"))


def positive_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def floored_idf(n: Column, df: Column) -> Column:
    """The full-text engine's idf; where it is not positive, FLOOR."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(FLOOR)


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(texts: DataFrame, query: str, key: str, text: str = "text", floored: bool = False, stemmed: bool = False) -> DataFrame:
    """(key, score): every text that holds a term of the query; a term twice in the query counts twice.

    `floored` takes the full-text engine's idf, else the always positive one; `stemmed` its tokens and stems. Only the
    query's terms are looked for: each text is reduced to its length and their counts before anything is shuffled.
    """
    wanted = [t for q in query.split() for t in stemmed_terms(q)] if stemmed else [t for t in index_tokens(query) if t.isascii()]
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("score", T.DoubleType())])
    if not wanted:
        return texts.sparkSession.createDataFrame([], schema)
    terms = sorted(set(wanted))
    counts = _stemmed_counts(terms)(F.col(text)) if stemmed else _counts(F.col(text), terms)
    rows = texts.select(key, counts.alias("c")).select(key, F.coalesce("c.len", F.lit(0)).alias("len"), *[F.coalesce(F.col("c.tf")[k], F.lit(0)).alias(f"tf{k}") for k in range(len(terms))])
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    scored = rows.where(F.greatest(*[F.col(f"tf{k}") for k in range(len(terms))], F.lit(0)) > 0).join(F.broadcast(stats))
    idf = floored_idf if floored else positive_idf
    longest = F.col("len").cast("double") if floored else F.greatest(F.col("len"), F.lit(1)).cast("double")
    parts = [F.when(F.col(f"tf{k}") > 0, wanted.count(t) * idf(F.col("n"), F.col(f"df{k}")) * saturation(F.col(f"tf{k}"), longest, F.col("avg"))).otherwise(0.0) for k, t in enumerate(terms)]
    return scored.select(key, sum(parts[1:], parts[0]).alias("score"))


def _counts(text: Column, terms: list[str]) -> Column:
    """struct<len, tf>: a text's tokens, and how many of them are each of `terms` (ASCII, lower case).

    One expression looks for all terms at once, so what is counted one by one is only the few tokens that are wanted.
    """
    pattern = rf"(?i)(?<![a-zA-Z0-9])(?:{'|'.join(sorted(terms, key=len, reverse=True))})(?![a-zA-Z0-9])"
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
    tf = F.transform(F.array(hits), lambda h: F.array(*[F.size(F.filter(h, _is(t))) for t in terms]))[0]
    return F.struct(F.regexp_count(text, F.lit("[a-zA-Z0-9]+")).alias("len"), tf.alias("tf"))


def _is(term: str):
    return lambda x: x == term


def _stemmed_counts(terms: list[str]):
    """The same for tokens of the full-text index, which only Python can stem."""
    kind = T.StructType([T.StructField("len", T.IntegerType()), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = []
        for x in text:
            own = stemmed_terms(x) if x is not None else []
            rows.append((len(own), [own.count(t) for t in terms]))
        return pd.DataFrame(rows, columns=["len", "tf"])

    return run


def phrase_hits(texts: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """(key, hits): how often the query's terms stand one after the other, as a quoted phrase of the full-text index."""
    wanted = F.array(*[F.lit(t) for q in query.split() for t in stemmed_terms(q)])
    found = texts.select(key, index_terms(F.col(text)).alias("t")).withColumn("hits", F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t"))), lambda k: F.slice("t", k, F.size(wanted)) == wanted)))
    return found.where("hits > 0").select(key, "hits")


def top(scored: DataFrame, key: str, limit: int, score: str = "score") -> DataFrame:
    """(rank, key, score): the best `limit` rows, ties by key. The limit is taken before the single-partition ranking."""
    if limit <= 0:
        return scored.select(F.lit(0).cast("bigint").alias("rank"), key, score).limit(0)
    best = scored.orderBy(F.col(score).desc(), F.col(key)).limit(limit)
    return best.select(F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))).cast("bigint").alias("rank"), key, score)


def search_batch(texts: DataFrame, queries: DataFrame, key: str, query_key: str, limit: int, text: str = "text", question: str = "question", places: int = 9) -> DataFrame:
    """(query_key, key, score, rank): the best `limit` texts of every query, by the positive-idf score.

    Queries are taken in blocks; each block's terms are broadcast and every text is scored against all of them where it
    is read. Partitions hand on their best rows per query only, so the ranking shuffles limit x queries x partitions
    rows at most. Scores are rounded to `places` before they are ranked; ties go by key.
    """
    spark = texts.sparkSession
    listed = [(r[0], r[1]) for r in queries.select(query_key, ascii_tokens(F.col(question)).alias("t")).where("t IS NOT NULL").orderBy(query_key).toLocalIterator()]
    tokens = texts.select(F.col(key), F.coalesce(ascii_tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    out = None
    for at in range(0, len(listed), QUERY_BLOCK):
        block = listed[at : at + QUERY_BLOCK]
        terms = sorted({t for _, ts in block for t in ts})
        place = {t: k for k, t in enumerate(terms)}
        weight = np.zeros((len(terms), len(block)))
        for q, (_, ts) in enumerate(block):
            for t in ts:
                weight[place[t], q] += 1
        wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
        n, average = corpus_stats(texts, ascii_tokens(F.col(text))).first()
        df = dict(tokens.select(F.explode(F.array_intersect("tokens", wanted)).alias("t")).groupBy("t").count().collect())
        for t, k in place.items():
            weight[k] *= math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
        shared = spark.sparkContext.broadcast((place, weight, float(average or 1.0), [q for q, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            place, weight, average, names = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            kind = None
            for batch in batches:
                kind = batch.schema.field(0).type
                for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts: dict[int, int] = {}
                    for t in tokens:
                        k = place.get(t)
                        if k is not None:
                            counts[k] = counts.get(k, 0) + 1
                    if not counts:
                        continue
                    norm = K1 * (1 - B + B * max(1, len(tokens)) / average)
                    tf = np.fromiter(counts.values(), dtype=float)
                    scores = (tf * (K1 + 1) / (tf + norm)) @ weight[list(counts)]
                    for q in np.flatnonzero(scores > 0):
                        best[q].append((-round(float(scores[q]), places), name))
                for q, found in enumerate(best):
                    if len(found) > 4 * limit:
                        best[q] = sorted(found)[:limit]
            rows = [(names[q], name, -score) for q, found in enumerate(best) for score, name in sorted(found)[:limit]]
            if kind is not None:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], names=["q", "k", "score"])

        found = tokens.mapInArrow(run, f"q string, k {texts.schema[key].dataType.simpleString()}, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"{query_key} string, {key} {texts.schema[key].dataType.simpleString()}, score double, rank bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "k")).cast("bigint")
    return out.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")


# ------------------------------------------------------------------------------------------------ a stored index

#: Parts of a stored index: a term's postings are in the part of its CRC-32.
TERM_BUCKETS = 64


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return (F.crc32(term) % buckets).cast("int")


def index_rows(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, document_id, tf, len) of chunks (id, document_id, text): stems of the full-text index with their counts."""
    listed = chunks.select(F.col("id").alias("chunk_id"), "document_id", index_terms(F.col("text")).alias("t"))
    listed = listed.select("chunk_id", "document_id", F.size("t").cast("bigint").alias("len"), F.explode("t").alias("term"))
    return listed.groupBy("term", "chunk_id", "document_id", "len").agg(F.count("*").alias("tf")).select("term", "chunk_id", "document_id", "tf", "len")


def bm25_indexed(index: DataFrame, sizes: DataFrame, query: str, bucket: str | None = None, buckets: int = TERM_BUCKETS) -> DataFrame:
    """(chunk_id, score) of the full-text search from a stored index: what bm25(floored=True, stemmed=True) gives, without
    reading a text.

    index: rows of index_rows, with the column `bucket` if it is stored by term_bucket, so that only the parts of the
    query's terms are read. sizes (document_id, chunks, tokens) has a row per document.
    """
    wanted = [t for q in query.split() for t in stemmed_terms(q)]
    if not wanted:
        return index.sparkSession.createDataFrame([], "chunk_id string, score double")
    terms = sorted(set(wanted))
    if bucket is not None:
        index = index.where(F.col(bucket).isin(sorted({zlib.crc32(t.encode()) % buckets for t in terms})))
    hits = index.where(F.col("term").isin(terms)).select("term", "chunk_id", "tf", "len").dropDuplicates(["term", "chunk_id"])
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row per term of the query
    stats = sizes.agg(F.sum("chunks").alias("n"), (F.sum("tokens") / F.sum("chunks")).alias("avg"))
    times = F.create_map(*[F.lit(x) for t in terms for x in (t, float(wanted.count(t)))])
    part = times[F.col("term")] * floored_idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len").cast("double"), F.col("avg"))
    return hits.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy("chunk_id").agg(F.sum(part).alias("score"))


def search_text(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(rank, chunk_id, score) of the full-text search: stemmed terms joined by OR, floored idf. Blank gives none."""
    return top(bm25(chunks.withColumnRenamed("id", "chunk_id"), query, "chunk_id", floored=True, stemmed=True), "chunk_id", limit)


__all__ = ["bm25", "bm25_indexed", "index_rows", "corpus_stats", "floored_idf", "phrase_hits", "positive_idf", "postings", "query_terms", "saturation", "search_batch", "search_text", "top"]
