import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking


def brute(document, blocks, most, overlap):
    """Greedy packing, one document at a time: (page, order, id, text) in, chunks of (text, first page, last page) out."""
    out, held, words = [], [], 0

    def flush():
        nonlocal held, words
        if held:
            out.append(("\n".join(t for _, t in held), min(p for p, _ in held), max(p for p, _ in held)))
        held, words = [], 0

    for page, _, _, text in sorted(blocks):
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        if not spans:
            continue
        parts = [(text, len(spans))]
        if len(spans) > most:
            parts = []
            for first in range(0, len(spans), most - overlap):
                own = spans[first : first + most]
                parts.append((text[own[0][0] : own[-1][1]], len(own)))
                if first + most >= len(spans):
                    break
        for part, n in parts:
            if held and words + n > most:
                flush()
            held.append((page, part))
            words += n
            if n >= most:
                flush()
    flush()
    return out


def tables(spark, documents):
    """{document: [(page, order, text)]} as pages and blocks with unneeded columns."""
    pages, blocks = [], []
    for d, rows in documents.items():
        for page in sorted({p for p, _, _ in rows}):
            pages.append((len(pages) + 1, d, page, "x"))
        where = {(d, p): k for k, d_, p, _ in pages for d in [d_]}
        for page, order, text in rows:
            blocks.append((len(blocks) + 1, where[d, page], d, order, text))
    return spark.createDataFrame(pages, "id bigint, document_id string, page_number int, text string"), spark.createDataFrame(blocks, "id bigint, page_id bigint, document_id string, block_order int, text string")


def test_windows_of_one_block(spark):
    pages, blocks = tables(spark, {"d": [(2, 1, "ropes coil on wet planks here")]})
    rows = chunking.provenance_chunks(pages, blocks, 4, 1).orderBy("ordinal").collect()
    assert [r["text"] for r in rows] == ["ropes coil on wet", "wet planks here"]
    assert {(r["page_start"], r["page_end"]) for r in rows} == {(2, 2)}
    span = rows[1]["spans"][0]
    assert "ropes coil on wet planks here"[span["block_start"] : span["block_end"]] == "wet planks here"
    assert rows[0]["id"] == hashlib.sha256("d\0blocks-v1-4-1\0001\0ropes coil on wet".encode()).hexdigest()


@pytest.mark.parametrize("page_range", [1, 2, 64])
def test_like_brute_force(spark, monkeypatch, page_range):
    monkeypatch.setattr(chunking, "PAGE_RANGE", page_range)
    rng = random.Random(page_range)
    documents = {}
    for d in ("a", "b", "c"):
        documents[d] = [(p, o, " ".join(rng.choice(["x", "né", "😀", "long word"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))) + rng.choice(["", " "])) for p in range(1, 9) for o in range(1, rng.randrange(2, 7))]
    pages, blocks = tables(spark, documents)
    doubled = blocks.unionAll(blocks.limit(5)).repartition(5)
    for most, overlap in ((10, 3), (7, 0), (12, 5)):
        rows = chunking.provenance_chunks(pages.repartition(3), doubled, most, overlap).orderBy("document_id", "ordinal").collect()
        for d, own in documents.items():
            wanted = brute(d, [(p, o, 0, t) for p, o, t in own], most, overlap)
            assert [(r["text"], r["page_start"], r["page_end"]) for r in rows if r["document_id"] == d] == wanted, (d, most)
        for r in rows:
            assert all(s["chunk_end"] - s["chunk_start"] == s["block_end"] - s["block_start"] for s in r["spans"])


def test_nothing_to_chunk(spark):
    pages, blocks = tables(spark, {"d": [(1, 1, " "), (1, 2, "")]})
    assert chunking.provenance_chunks(pages, blocks).count() == 0
    assert chunking.provenance_chunks(pages.limit(0), blocks.limit(0)).count() == 0
    assert chunking.provenance_chunks(pages, blocks.withColumn("text", F.lit(None).cast("string"))).count() == 0


@pytest.mark.parametrize("most,overlap", [(0, 0), (5, -1), (5, 5)])
def test_limits(spark, most, overlap):
    pages, blocks = tables(spark, {"d": [(1, 1, "x")]})
    with pytest.raises(ValueError):
        chunking.provenance_chunks(pages, blocks, most, overlap)


def test_passages(spark):
    assert chunking.passages_of("tide ebbs past the old quay wall every dusk", 5, 2) == ["tide ebbs past the old", "the old quay wall every", "wall every dusk"]
    assert chunking.passages_of("a b c\n\nd e f\n \ng", 5, 2) == ["a b c", "b c d e f", "e f g"]
    assert chunking.passages_of(" \n\n ", 5, 2) == []
    rows = spark.createDataFrame([(1, "a b c\n\nd e f", 0), (2, None, 0), (3, "", 0)], "doc_id bigint, text string, passage int")
    assert [(r["doc_id"], r["passage"], r["text"]) for r in chunking.text_passages(rows, max_words=5, overlap=2).collect()] == [(1, 0, "a b c"), (1, 1, "b c d e f")]


def test_lines(spark):
    words = [(1, "late", 50.0, 30.0, 70.0, 40.0), (1, "b", 30.0, 12.5, 40.0, 22.0), (1, "a", 10.0, 10.0, 20.0, 20.0), (1, "c", 50.0, 13.2, 60.0, 23.0)]
    rows = chunking.line_blocks(spark.createDataFrame(words, "page_id bigint, text string, x0 double, top double, x1 double, bottom double")).orderBy("block_order").collect()
    assert [(r["block_order"], r["text"], r["x0"], r["bottom"]) for r in rows] == [(1, "a b", 10.0, 22.0), (2, "c", 50.0, 23.0), (3, "late", 50.0, 40.0)]
    seen = [(1, 1, "Faded", 0, 0, 10, 5, 91.0, "1-1"), (1, 2, "ledger", 12, 1, 10, 5, 89.0, "1-1"), (1, 3, "", 0, 9, 1, 1, 50.0, "1-2"), (1, 4, "noise", 0, 9, 1, 1, -1.0, "1-2")]
    rows = chunking.recognised_blocks(spark.createDataFrame(seen, "page_id bigint, seq bigint, text string, left int, top int, width int, height int, confidence double, line_key string"), 0.5, 0.5).collect()
    assert [(r["text"], r["confidence"], r["x1"]) for r in rows] == [("Faded ledger", 90.0, 11.0)]
