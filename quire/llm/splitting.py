r"""Problem 5: splitting oversized texts at natural boundaries.

All of it is SQL array functions over bounded-quantifier regular expressions, so it runs in the JVM without a shuffle.
A first expression consumes words, a second one characters where the words were long; the alternatives of each are
ordered by the strength of the boundary they end at, with any word end and then any character as the last resort.
The overlap is found by looking back from each piece's start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import checkpointed

MAX_WORDS, MAX_CHARS, OVERLAP_WORDS = 120, 1200, 20

#: Boundaries from strong to weak, each as what stands before the cut and what stands after it.
BOUNDARIES = (
    (r"", r"(?=[\s&&[^\n]]*+\n\s*+\n)"),  # paragraph
    (r"(?<=[.!?…。！？][\"'”’»)\]]{0,3})", r"(?=\s)"),  # sentence
    (r"", r"(?=[\s&&[^\n]]*+\n)"),  # line
    (r"(?<=[,;:—–])", r"(?=\s)"),  # clause
)


def word_pattern(most: int) -> str:
    """Consumes up to `most` words with the white space before them; at a boundary from half of that on."""
    words = r"(?:\s*+\S++)"
    ways = [words + f"{{1,{most}}}" + r"+\s*+\z", *(words + f"{{{max(1, most // 2)},{most}}}" + before + after for before, after in BOUNDARIES), words + f"{{1,{most}}}+"]
    return "(?sU)" + "|".join(ways)


def char_pattern(most: int) -> str:
    """Consumes up to `most` characters, the last resort being not to part a mark from its letter, then any cut."""
    ways = [f".{{1,{most}}}" + r"\z", *(f".{{{max(1, most // 2)},{most}}}" + before + after for before, after in BOUNDARIES), f".{{1,{most}}}" + r"(?<=\S)(?=\s)", f".{{1,{most}}}" + r"(?!\p{M})", f".{{1,{most}}}"]
    return "(?sU)" + "|".join(ways)


def word_count(text: Column) -> Column:
    r"""Words parted by any Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def is_oversized(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    # a text of more than n words has at least 2n + 1 characters, so short ones need no counting
    return F.coalesce((F.length(text) > max_chars) | ((F.length(text) > 2 * max_words) & (word_count(text) > max_words)), F.lit(False))


def _check(max_words: int, max_chars: int, overlap_words: int) -> None:
    if not (0 <= overlap_words < max_words and max_chars > 1):
        raise ValueError("limits must be positive and the overlap smaller than the words of a piece")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of `value`, which is worked out once however often `then` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def pieces_of(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap_words: int = OVERLAP_WORDS) -> Column:
    """array<struct<start, end, text, overlap_words>>: the pieces with their code-point offsets in `text`.

    A text within both limits is one piece, as it is. Null gives null; an empty or blank text is one piece.
    Consumed parts hold `max_words - overlap_words` words, and their characters leave a fifth of `max_chars` for the
    overlap; a piece gets fewer overlapping words where more would break a limit (or none, inside a very long word).
    White space at a piece's ends is left out of it.
    """
    _check(max_words, max_chars, overlap_words)
    own_words, own_chars = max_words - overlap_words, max(1, max_chars - (max_chars // 5 if overlap_words else 0))
    lead_pattern, back_pattern = r"(?U)^\s*+", rf"(?U)^\s*+(?:\S++\s++){{0,{max(0, overlap_words - 1)}}}\S++(?=\s)"

    def consumed(by_words: Column) -> Column:
        return F.flatten(F.transform(by_words, lambda p: F.when(F.length(p) <= own_chars, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(char_pattern(own_chars)), F.lit(0)))))

    def ended(parts: Column) -> Column:  # running sums; parts follow one another without a gap
        return F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))

    def shared(part: Column, k: Column, start: Column, end: Column) -> Column:
        if not overlap_words:
            return F.lit("")
        spare = F.greatest(F.lit(0), F.lit(max_chars) - (end - start))
        # the space before the text lets its first word end at white space too; it is never taken
        window = F.reverse(F.right(F.concat(F.lit(" "), F.substring(text, F.lit(1), start)), spare + 1))
        inside = F.regexp_extract(part, r"(?U)^\S", 0) != ""  # cut inside a word: nothing whole stands before
        return F.when((k == 0) | inside | (end <= start), F.lit("")).otherwise(F.regexp_extract(window, back_pattern, 0))

    def piece(part: Column, k: Column, before: Column) -> Column:
        bounds = F.struct((before + F.length(F.regexp_extract(part, lead_pattern, 0))).alias("start"), (before + F.length(part) - F.length(F.regexp_extract(F.reverse(part), lead_pattern, 0))).alias("end"))

        def made(b: Column) -> Column:
            def out(overlap: Column) -> Column:
                first = b["start"] - F.length(overlap)
                return F.struct(first.alias("start"), b["end"].alias("end"), F.substring(text, first + 1, b["end"] - first).alias("text"), word_count(overlap).alias("overlap_words"))

            return _let(shared(part, k, b["start"], b["end"]), out)

        return _let(bounds, made)

    def cut_up(parts: Column) -> Column:
        return _let(ended(parts), lambda ends: F.filter(F.transform(parts, lambda p, k: piece(p, k, F.element_at(ends, k + 1))), lambda x: x["end"] > x["start"]))

    cut = _let(_let(F.regexp_extract_all(text, F.lit(word_pattern(own_words)), F.lit(0)), consumed), cut_up)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"), F.lit(0).alias("overlap_words")))
    return F.when(is_oversized(text, max_words, max_chars) & text.rlike(r"(?U)\S"), cut).when(text.isNotNull(), whole)


def split_texts(texts: DataFrame, keys: list[str], text_column: str = "text", max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """keys + pieces: every row's text as an array of pieces (see pieces_of). Other columns are left out."""
    return texts.select(*keys, pieces_of(F.col(text_column), max_words, max_chars, overlap_words).alias("pieces"))


def items(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_kind, item_id, text) of blocks and chunks."""
    of = lambda kind, df: df.select(F.lit(kind).alias("item_kind"), F.col("id").cast("string").alias("item_id"), "text")
    return of("block", blocks).unionAll(of("chunk", chunks))


def had_to_cut(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap_words: int = OVERLAP_WORDS) -> Column:
    """Whether the splitting does not leave `text` as the one piece it is, or leaves a piece beyond a limit (as of mere white
    space, which it cuts nowhere). Null counts as no."""

    def cut(pieces: Column) -> Column:
        return (F.size(pieces) != 1) | F.exists(pieces, lambda p: (p["start"] > 0) | (p["end"] < F.length(text)) | (p["end"] - p["start"] > max_chars))

    return F.coalesce(_let(pieces_of(text, max_words, max_chars, overlap_words), cut), F.lit(False))


def oversized_items(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_kind, item_id): the items that the splitting has to cut, once each however often they are delivered, and even
    where all but one of their pieces are white space or the whole of them is."""
    return items(blocks, chunks).where(had_to_cut(F.col("text"))).select("item_kind", "item_id").distinct()


#: So many keys of rows delivered again are told to every worker; where there are more, all rows are shuffled.
MOST_AGAIN = 1_000_000


def once_each(rows: DataFrame, keys: list[str], most: int = MOST_AGAIN) -> DataFrame:
    """`rows` with one row for each value of `keys`. Only the keys are counted; of the texts, only those of keys that come
    more than once are shuffled, unless these are many."""
    again = checkpointed(rows.groupBy(*keys).count().where("count > 1").select(*keys))
    if again.count() > most:
        return rows.dropDuplicates(keys)
    return rows.join(F.broadcast(again), keys, "left_anti").unionByName(rows.join(F.broadcast(again), keys, "left_semi").dropDuplicates(keys))


def piece_rows(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_kind, item_id, piece, start, end, text, overlap_words): a row per piece of every item."""
    once = once_each(items(blocks, chunks).where("item_id IS NOT NULL"), ["item_kind", "item_id"])
    return split_texts(once, ["item_kind", "item_id"]).select("item_kind", "item_id", F.posexplode("pieces").alias("piece", "p")).select("item_kind", "item_id", F.col("piece").cast("bigint").alias("piece"), F.col("p.start").cast("bigint").alias("start"), F.col("p.end").cast("bigint").alias("end"), "p.text", F.col("p.overlap_words").cast("bigint").alias("overlap_words"))
