"""Chunks: provenance chunks of page blocks, and passages of plain text.

Packing is greedy: a chunk takes segments while they fit, so where one begins depends on all that came before it in the
document. To keep a long document off a single task, its pages are cut into ranges. Each range works out, for every
number of words a pending chunk may bring into it, how many it leaves and how many chunks it begins; these small tables
are folded document by document, and each range is then packed on its own, knowing what comes in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import key_of, word_count

MAX_WORDS, OVERLAP, PASSAGE_OVERLAP = 120, 20, 25
#: Pages of one range.
PAGE_RANGE = 64


def version_of(max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> str:
    return f"blocks-v1-{max_words}-{overlap}"


def _check(max_words: int, overlap: int) -> None:
    if max_words <= 0:
        raise ValueError("max_words must be positive")
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be at least zero and less than max_words")


def window_sizes(n_words: int, max_words: int, overlap: int) -> list[tuple[int, int]]:
    """(first word, words) of the windows of a text of n words; a text within the limit is one window."""
    if n_words <= max_words:
        return [(0, n_words)] if n_words else []
    step = max_words - overlap
    count = 1 + -(-(n_words - max_words) // step)
    return [(k * step, min(max_words, n_words - k * step)) for k in range(count)]


def pack(sizes: list[int], pending: int, max_words: int) -> tuple[int, list[bool]]:
    """(words pending at the end, for each segment whether it begins a chunk), `pending` words coming in."""
    begins = []
    for size in sizes:
        begins.append(pending == 0 or pending + size > max_words)
        pending = size if begins[-1] else pending + size
        if size >= max_words:
            pending = 0
    return pending, begins


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, group by group; keys are the first columns."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != current:
                if rows:
                    yield current, rows
                current, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield current, rows


def provenance_chunks(pages: DataFrame, blocks: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, document: str = "document_id") -> DataFrame:
    """(id, document_id, ordinal, text, page_start, page_end, chunker_version, spans) of every document with words.

    Blocks go in order of page and place, each once however often delivered; null texts and texts without words vanish.
    A block of up to `max_words` words is one segment with all its white space; a longer one becomes overlapping windows.
    Spans say which part of which block is which part of the chunk, in code points.
    """
    _check(max_words, overlap)
    version = version_of(max_words, overlap)
    source = blocks.where("text IS NOT NULL").select("id", "page_id", "block_order", "text").dropDuplicates(["id"])
    source = source.join(pages.select(F.col("id").alias("page_id"), F.col(document).alias("document"), "page_number"), "page_id")
    source = source.withColumn("range", F.floor(F.col("page_number") / PAGE_RANGE)).withColumn("n", word_count(F.col("text"))).where("n > 0")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, part), rows in _grouped(batches, 2):
            sizes = [size for row in rows for _, size in window_sizes(row[4], max_words, overlap)]
            left, begun, seen = [], [], {}
            for words in range(max_words + 1):
                # every pending amount that the same first segment ends leads to the same packing from there on
                k, total = 0, words
                while k < len(sizes) and words and total + sizes[k] <= max_words and sizes[k] < max_words:
                    total += sizes[k]
                    k += 1
                if k == len(sizes):
                    left.append(total)
                    begun.append(0)
                    continue
                if not words:
                    k = 0
                if k not in seen:
                    after, starts = pack(sizes[k:], 0, max_words)
                    seen[k] = (after, sum(starts))
                left.append(seen[k][0])
                begun.append(seen[k][1])
            yield pa.RecordBatch.from_pydict({"document": [doc], "range": [part], "left": [left], "begun": [begun]}, schema=pa.schema([("document", pa.string()), ("range", pa.int64()), ("left", pa.list_(pa.int32())), ("begun", pa.list_(pa.int32()))]))

    sized = source.select("document", "range", "page_number", "block_order", "n").repartition("document", "range").sortWithinPartitions("document", "range", "page_number", "block_order")
    moves = sized.mapInArrow(tables, "document string, range long, left array<int>, begun array<int>")
    listed = moves.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("range", "left", "begun"))).alias("r"))
    start = F.struct(F.lit(0).alias("pending"), F.lit(0).alias("ordinal"), F.expr("cast(array() as array<struct<range:bigint,pending:int,ordinal:int>>)").alias("out"))

    def fold(state: Column, move: Column) -> Column:
        entry = F.struct(move["range"].alias("range"), state["pending"].alias("pending"), state["ordinal"].alias("ordinal"))
        return F.struct(F.get(move["left"], state["pending"]).alias("pending"), (state["ordinal"] + F.get(move["begun"], state["pending"])).alias("ordinal"), F.concat(state["out"], F.array(entry)).alias("out"))

    entries = listed.select("document", F.explode(F.aggregate("r", start, fold)["out"]).alias("e")).select("document", "e.range", "e.pending", "e.ordinal")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"\S+")
        for (doc, _), rows in _grouped(batches, 2):
            out: list[tuple] = []
            sizes = []
            for _, _, page, order, n, pending, ordinal, block, text in rows:
                if n <= max_words:
                    out.append((doc, page, order, 0, block, 0, len(text), text))
                    sizes.append(n)
                    continue
                found = [m.span() for m in word.finditer(text)]
                for k, (first, size) in enumerate(window_sizes(len(found), max_words, overlap)):
                    begin, end = found[first][0], found[first + size - 1][1]
                    out.append((doc, page, order, k, block, begin, end, text[begin:end]))
                    sizes.append(size)
            ordinal = rows[0][6]
            columns = [list(c) for c in zip(*out, strict=True)]
            numbers = []
            for begins in pack(sizes, rows[0][5], max_words)[1]:
                ordinal += begins
                numbers.append(ordinal)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32())] + [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["ordinal", "document", "page", "place", "window", "block_id", "block_start", "block_end", "text"])

    placed = source.join(entries, ["document", "range"]).select("document", "range", F.col("page_number").cast("int"), F.col("block_order").cast("int"), "n", "pending", "ordinal", "id", "text")
    placed = placed.repartition("document", "range").sortWithinPartitions("document", "range", "page_number", "block_order")
    parts = placed.mapInArrow(segments, "ordinal int, document string, page int, place int, window int, block_id long, block_start int, block_end int, text string")
    rows = parts.groupBy("document", "ordinal").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sort_array(F.collect_list(F.struct("page", "place", "window", "block_id", "block_start", "block_end", "text"))).alias("s"))
    ends = F.aggregate("s", F.expr("cast(array() as array<int>)"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, F.lit(0)) + F.length(x["text"]))))
    rows = rows.withColumn("ends", ends)
    spans = F.transform("s", lambda x, k: F.struct(x["block_id"].alias("block_id"), (k + 1).alias("span_order"), x["block_start"].alias("block_start"), x["block_end"].alias("block_end"), (F.get("ends", k) - F.length(x["text"])).alias("chunk_start"), F.get("ends", k).alias("chunk_end")))
    text = F.array_join(F.transform("s", lambda x: x["text"]), "\n")
    made = rows.select(F.col("document").alias("document_id"), "ordinal", text.alias("text"), "page_start", "page_end", F.lit(version).alias("chunker_version"), spans.alias("spans"))
    return made.select(key_of(F.col("document_id"), F.lit(version), F.col("ordinal"), F.col("text")).alias("id"), "*")


def chunk_spans(chunks: DataFrame) -> DataFrame:
    """A row per span of chunks with a `spans` column."""
    return chunks.select(F.col("id").alias("chunk_id"), F.explode("spans").alias("s")).select("chunk_id", "s.*")


def passages_of(text: str, max_words: int, overlap: int) -> list[str]:
    """Passages of whole paragraphs, parted by blank lines, that share up to `overlap` words with the one before.

    Paragraphs are put together while they fit. One that alone exceeds the limit ends what is pending and becomes
    windows, which nothing is added to. When the next does not fit, the last words of the passage are carried over, as
    many as leave room for it.
    """
    done, held = [], []
    for paragraph in re.split(r"\n\s*\n", text):
        own = paragraph.split()
        if len(own) > max_words:
            if held:
                done.append(held)
            done += [own[first : first + size] for first, size in window_sizes(len(own), max_words, overlap)]
            held = []
        elif own:
            if held and len(held) + len(own) > max_words:
                done.append(held)
                room = min(overlap, max_words - len(own))
                held = held[len(held) - room :] if 0 < room < len(held) else held if room else []
            held = held + own
    return [" ".join(p) for p in (*done, *([held] if held else []))]


def text_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS, overlap: int = PASSAGE_OVERLAP) -> DataFrame:
    """(key, passage, text): the passages of each row's text in order from 0; none for null and blank texts."""
    _check(max_words, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, texts = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for n, passage in enumerate(passages_of(text, max_words, overlap) if text else ()):
                    at.append(k)
                    numbers.append(n)
                    texts.append(passage)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=[key, "passage", "text"])

    source = documents.select(F.col(key), F.col(text).alias("text"))
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, passage long, text string")


# ------------------------------------------------------------------------------------------------ words to lines

LINE_TOLERANCE = 3.0


def line_blocks(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """(page_id, block_order, text, x0, top, x1, bottom) of words (page_id, text, x0, top, x1, bottom) in reading order.

    Words go by top, then x0. A word begins a line if its top is further than `tolerance` from that of the line's first
    word. A page's words are one group, whose size paper bounds.
    """
    each = F.sort_array(F.collect_list(F.struct("top", "x0", "text", "x1", "bottom"))).alias("w")
    kind = "array<struct<head:double,words:array<struct<top:double,x0:double,text:string,x1:double,bottom:double>>>>"

    def place(lines: Column, word: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fresh = F.concat(lines, F.array(F.struct(word["top"].alias("head"), F.array(word).alias("words"))))
        grown = F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.struct(last["head"].alias("head"), F.concat(last["words"], F.array(word)).alias("words"))))
        return F.when(last.isNull() | (F.abs(word["top"] - last["head"]) > tolerance), fresh).otherwise(grown)

    lines = words.groupBy("page_id").agg(each).select("page_id", F.posexplode(F.aggregate("w", F.expr(f"cast(array() as {kind})"), place)).alias("k", "line"))
    of = lambda name: F.transform("line.words", lambda w: w[name])
    return lines.select("page_id", (F.col("k") + 1).alias("block_order"), F.array_join(of("text"), " ").alias("text"), F.array_min(of("x0")).alias("x0"), F.array_min(of("top")).alias("top"), F.array_max(of("x1")).alias("x1"), F.array_max(of("bottom")).alias("bottom"))


def recognised_blocks(words: DataFrame, points_per_pixel_x: float, points_per_pixel_y: float) -> DataFrame:
    """Blocks of recognised words (page_id, seq, text, left, top, width, height, confidence, line_key).

    Words without text or of negative confidence are dropped. Lines keep the order in which their first word came;
    boxes are scaled to points and confidence is the words' mean.
    """
    kept = words.where("trim(text) <> '' AND confidence >= 0")
    lines = kept.groupBy("page_id", "line_key").agg(F.min("seq").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"), (F.min("left") * points_per_pixel_x).alias("x0"), (F.min("top") * points_per_pixel_y).alias("top"), (F.max(F.col("left") + F.col("width")) * points_per_pixel_x).alias("x1"), (F.max(F.col("top") + F.col("height")) * points_per_pixel_y).alias("bottom"), F.avg("confidence").alias("confidence"))
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("first"))
    return lines.select("page_id", order.alias("block_order"), "text", "x0", "top", "x1", "bottom", "confidence")


def needs_recognition(text: Column, least: int = 20) -> Column:
    """Whether a page holds too few letters and digits to be taken as it is; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")), F.lit(0)) < least
