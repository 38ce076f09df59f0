"""Grounded answers: contexts, prompts, and the contract that a generator's output must keep."""

from __future__ import annotations

import json
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: said instead of an answer where the evidence does not carry one.
REFUSAL = "Insufficient evidence in the retrieved passages."
CLAIMS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("citation_ids", T.ArrayType(T.StringType()))]))
CHECKED = T.StructType([T.StructField("status", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("claims", CLAIMS), T.StructField("failure_reason", T.StringType())])


class Generator(Protocol):
    """Writes JSON for a question and its prompt; models are plugged in behind this."""

    def generate(self, question: str, prompt: str) -> str: ...


def contexts_of(ranked: Column) -> Column:
    """array<struct<context_id, ...>> of an array of results in order: C1, C2, ..."""
    return F.transform(ranked, lambda r, k: F.struct(F.concat(F.lit("C"), (k + 1).cast("string")).alias("context_id"), r.alias("result")))


def prompt_of(contexts: Column) -> Column:
    """The contexts as the text that goes before a question."""
    def one(c: Column) -> Column:
        r = c["result"]
        return F.concat(F.lit("["), c["context_id"], F.lit("] Source: "), r["document_name"], F.lit("; pages "), r["page_start"].cast("string"), F.lit("-"), r["page_end"].cast("string"), F.lit("\n"), r["text"])

    return F.array_join(F.transform(contexts, one), "\n\n")


def check_output(raw: str | None, known: list[str] | None) -> tuple[str, str | None, list | None, str | None]:
    """(status, answer, claims, failure_reason) of a generator's output, given the ids it may cite.

    Anything but an object of exactly `status` and `claims`, with claims of exactly a text and citation_ids, is a
    schema error; an answer needs claims and a refusal has none; blank texts and citations are errors. One unknown
    citation rejects the whole answer. Citations keep their order, each once; no contexts at all mean a refusal.
    """
    if not known:
        return "insufficient_evidence", REFUSAL, [], None
    failed = lambda why: ("generation_failed", None, [], why)
    try:
        given = json.loads(raw or "")
    except ValueError:
        return failed("invalid_json")
    if not isinstance(given, dict) or set(given) != {"status", "claims"} or given["status"] not in ("answered", "insufficient_evidence") or not isinstance(given["claims"], list):
        return failed("schema_error")
    claims = []
    for claim in given["claims"]:
        if not isinstance(claim, dict) or set(claim) != {"text", "citation_ids"} or not isinstance(claim["text"], str) or not claim["text"].strip():
            return failed("schema_error")
        ids = claim["citation_ids"]
        if not isinstance(ids, list) or not ids or any(not isinstance(i, str) or not i.strip() for i in ids):
            return failed("schema_error")
        claims.append({"text": claim["text"], "citation_ids": list(dict.fromkeys(ids))})
    if (given["status"] == "answered") != bool(claims):
        return failed("schema_error")
    if any(i not in known for c in claims for i in c["citation_ids"]):
        return failed("invalid_citations")
    if given["status"] == "insufficient_evidence":
        return "insufficient_evidence", REFUSAL, [], None
    return "answered", " ".join(c["text"].strip() for c in claims).strip(), claims, None


@F.pandas_udf(CHECKED)
def checked_output(raw: pd.Series, known: pd.Series) -> pd.DataFrame:
    rows = [check_output(r, None if k is None else list(k)) for r, k in zip(raw, known, strict=True)]
    return pd.DataFrame(rows, columns=CHECKED.fieldNames())


def answer_questions(questions: DataFrame, contexts: DataFrame, generator: Generator) -> DataFrame:
    """(uid, status, answer, claims, failure_reason) of questions (uid, question) with contexts (uid, contexts).

    The generator runs in the workers and is not called where there is no context.
    """
    def write(question: pd.Series, prompt: pd.Series) -> pd.Series:
        return pd.Series([generator.generate(q, p) if p else None for q, p in zip(question, prompt, strict=True)], dtype=object)

    ask = F.pandas_udf(write, T.StringType())
    joined = questions.join(contexts, "uid", "left").withColumn("prompt", prompt_of(F.col("contexts")))
    raw = joined.select("uid", F.transform("contexts", lambda c: c["context_id"]).alias("known"), ask("question", "prompt").alias("raw"))
    return raw.select("uid", checked_output("raw", "known").alias("c")).select("uid", "c.*")


def citation_relevance(claims: Column, contexts: Column, document: Column, pages: Column, expected: Column, status: Column) -> Column:
    """Share of distinct citations whose context is of the document and covers a relevant page; 0 without citations,
    null unless an answer was expected and given."""
    cited = F.array_distinct(F.flatten(F.transform(claims, lambda c: c["citation_ids"])))

    def hits(cite: Column) -> Column:
        return F.exists(contexts, lambda c: (c["context_id"] == cite) & (c["result"]["document_id"] == document) & F.exists(pages, lambda p: p.between(c["result"]["page_start"], c["result"]["page_end"])))

    share = F.coalesce(F.try_divide(F.size(F.filter(cited, hits)), F.size(cited)), F.lit(0.0))
    return F.when((expected == "answered") & (status == "answered"), share)
