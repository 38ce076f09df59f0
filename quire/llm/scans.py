"""Problem 1: noise in text from scanned pages, found and repaired.

Lines are placed in or outside the body by where they stand on the page. Words of all blocks are counted into a lexicon
with their bigrams. A word that recognition got wrong is looked for in a symmetric-delete index of the lexicon, keyed
by letter shapes so that letters and groups that scanners confuse fall together; an edit distance that makes such
confusions cheap and the bigrams around it choose the repair. All of this happens on distinct words and pairs; only
words that are not among the frequent sound ones travel with their blocks to be joined with the repairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.characters import SUSPECT, consistent
from quire.session import checkpointed

# ---------------------------------------------------------------------------------------------- letter shapes

#: Characters that recognition takes for one another, by what they are written as in a shape.
SHAPE_LETTERS = {"c": "ceé(", "t": "tf", "b": "bh8", "o": "oa0", "l": "il1!|j", "s": "s5$", "g": "g96q", "z": "z2", "n": "n"}
SHAPE = str.maketrans({c: to for to, many in SHAPE_LETTERS.items() for c in many})
#: Groups, written in shapes, and the single letter that they are taken for.
#: Groups overlap, so each order of taking them gives a shape of its own.
SHAPE_GROUPS = (
    (("rl", "n"), ("rn", "m"), ("cl", "d"), ("ll", "u"), ("vv", "w"), ("b", "u")),
    (("ll", "u"), ("rl", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("b", "u")),
)
#: What is read and what it stands for.
CONFUSIONS = {
    ("rn", "m"), ("m", "rn"), ("n", "ri"), ("ri", "n"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("h", "li"), ("li", "h"), ("lc", "k"), ("tl", "d"),
    ("0", "o"), ("o", "0"), ("0", "a"), ("1", "l"), ("1", "i"), ("l", "1"), ("l", "i"), ("i", "l"), ("i", "1"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("j", "i"), ("5", "s"), ("s", "5"), ("$", "s"),
    ("9", "g"), ("g", "9"), ("q", "g"), ("6", "g"), ("g", "6"), ("6", "b"), ("8", "b"), ("b", "8"), ("3", "e"), ("2", "z"), ("z", "2"), ("4", "a"), ("7", "t"), ("c", "e"), ("e", "c"), ("(", "c"), ("f", "t"), ("t", "f"),
    ("in", "m"), ("c1", "d"), ("h", "b"), ("b", "h"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"),
}
STRAY = "~|^*_\\`°¦§"
CONFUSED, STRAYED, CASE, WRONG = 0.2, 0.2, 0.1, 1.0
#: The most that a repair may cost by itself, and where the words beside it speak for it.
MOST_COST, MOST_COST_IN_CONTEXT = 0.95, 1.25


@lru_cache(maxsize=200_000)
def shapes(word: str) -> tuple[str, ...]:
    """The word with letters and groups that scanners confuse written alike, in each order of taking the groups."""
    letters, found = word.lower().translate(SHAPE), []
    for groups in SHAPE_GROUPS:
        out = letters
        for many, one in groups:
            out = out.replace(many, one)
        found.append(out)
    return tuple(dict.fromkeys(found))


#: No repair within the limits shifts letters by more places.
BAND = 7


@lru_cache(maxsize=200_000)
def repair_cost(read: str, meant: str) -> float:
    """Weighted edit distance from what was read to what is meant: confusions and stray marks are cheap. Beyond the most
    that a repair may cost it is only told to be so."""
    a, b = read.lower(), meant.lower()
    if abs(len(a) - len(b)) > BAND:
        return 99.0
    rows: list[dict[int, float]] = []
    for i in range(len(a) + 1):
        row: dict[int, float] = {}
        for j in range(max(0, i - BAND), min(len(b), i + BAND) + 1):
            best = 0.0 if not i and not j else 99.0
            if i and j:
                best = rows[i - 1].get(j - 1, 99.0) + (0.0 if a[i - 1] == b[j - 1] else CONFUSED if (a[i - 1], b[j - 1]) in CONFUSIONS else WRONG)
            if i:
                best = min(best, rows[i - 1].get(j, 99.0) + (STRAYED if a[i - 1] in STRAY else WRONG))
            if j:
                best = min(best, row.get(j - 1, 99.0) + WRONG)
            for m, n in ((2, 1), (1, 2)):
                if i >= m and j >= n and (a[i - m : i], b[j - n : j]) in CONFUSIONS:
                    best = min(best, rows[i - m].get(j - n, 99.0) + CONFUSED)
            row[j] = best
        if i and min(row.values()) > MOST_COST_IN_CONTEXT and min(rows[-1].values()) > MOST_COST_IN_CONTEXT:
            return 99.0
        rows.append(row)
    return rows[-1].get(len(b), 99.0)


#: Words of more letters are rare; their keys are both ends, one of which an error leaves alone.
LONG, END_LETTERS = 40, 16


def deletes(word: str) -> list[str]:
    """The keys of a word in the symmetric-delete index: its shapes, whole and with any one letter left out."""
    forms = shapes("".join(c for c in word if c not in STRAY) or word)
    if len(word) > LONG:
        return list({key for form in forms for key in ("<" + form[:END_LETTERS], ">" + form[-END_LETTERS:])})
    return list({key for form in forms for key in (form, *(form[:k] + form[k + 1 :] for k in range(len(form) if len(form) > 2 else 0)))})


# ---------------------------------------------------------------------------------------------- words of lines

HYPHENS = "-‐¬–­"
OUTER = "()[]{}\"'“”«»„.,;:%€£…—"
BEGIN, END = regex.compile(r"\A[" + regex.escape(OUTER) + r"$•·\-–]+"), regex.compile(r"[" + regex.escape(OUTER) + r"?!\-‐¬–­]+\Z")
LETTERS = regex.compile(r"\A[\p{L}\p{M}'’\-‐&/]+\Z")
FIGURE = regex.compile(r"\A(?=.*\d)(?:US\$|RM|[€£$¥(\[+\-])*\(?[\dOoIlSBZGgqb?!|]+(?:[.,/:\-][\dOoIlSBZGgqb?!|]+)*[)\]%]?\Z")
PURE_FIGURE = regex.compile(r"\A[\W\d_]*\Z|\A(?:US\$|RM)[\d.,]*\Z")


@lru_cache(maxsize=500_000)
def core(token: str) -> str:
    """A token without the punctuation around it; marks that may be misread letters stay."""
    return END.sub("", BEGIN.sub("", token))


ODD = regex.compile(SUSPECT)


def plain(text: str) -> str:
    return consistent(text)[0] if not text.isascii() and ODD.search(text) else text


#: Tokens, and different ones, that a worker holds as numbers before it counts them and hands the counts on.
HELD, HELD_WORDS = 4_000_000, 400_000


class _Counts:
    """Tokens of lines as numbers, and their counts and those of neighbours by the words in them."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {"": 0}  # parts lines
        self.runs: dict[str, list[np.ndarray]] = {"scanned": [], "direct": [], "edge": []}
        self.size = 0

    def add(self, kind: str, tokens: list[str]) -> None:
        place = self.place
        for token in dict.fromkeys(tokens):
            if token not in place:
                place[token] = len(place)
        self.runs[kind].append(np.fromiter(map(place.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
        self.size += len(tokens)

    def full(self) -> bool:
        return self.size > HELD or len(self.place) > HELD_WORDS

    def out(self) -> pa.RecordBatch:
        """(a, b, n, n_direct, n_edge); edge runs are a line's first and second token and an empty one each."""
        tokens = list(self.place)
        words: dict[str, int] = {"": 0}
        word = np.array([words.setdefault(core(t), len(words)) for t in tokens], dtype=np.int64)
        ends_in_digit = np.array([t[-1:].isdigit() for t in tokens])
        begins_with_digit = np.array([t[:1].isdigit() for t in tokens])
        listed = list(words)
        first = np.array([w != "" and not w[-1].isdigit() for w in listed])
        second = np.array([w[:1].isalpha() for w in listed])
        width, found, counts = len(listed), [], []
        for column, kind in ((0, "scanned"), (1, "direct"), (2, "edge")):
            run = np.concatenate([*self.runs[kind], np.zeros(1, dtype=np.int64)])
            left, right = run[:-1], run[1:]
            neighbours = (left > 0) & (right > 0) & ~ends_in_digit[left] & ~begins_with_digit[right] & first[word[left]] & second[word[right]]
            single = run
            if kind == "edge":  # only first tokens count by themselves, and with second ones that begin with a letter
                single = run[:-1:3]
                alpha = np.array([t[:1].isalpha() for t in tokens])
                neighbours &= alpha[right]
            for keys in (word[single] * (width + 1) + width, (word[left] * (width + 1) + word[right])[neighbours]):
                key, n = np.unique(keys, return_counts=True)
                key, n = key[key >= width + 1], n[key >= width + 1]  # without empty words
                rows = np.zeros((len(key), 3), dtype=np.int64)
                rows[:, column] = n
                found.append(key)
                counts.append(rows)
        key, at = np.unique(np.concatenate(found), return_inverse=True)
        total = np.zeros((len(key), 3), dtype=np.int64)
        np.add.at(total, at, np.concatenate(counts))
        names = pa.array([*listed, None], pa.string())
        columns = [names.take(pa.array(key // (width + 1))), names.take(pa.array(key % (width + 1))), pa.array(total[:, 0] + total[:, 1]), pa.array(total[:, 1]), pa.array(total[:, 2])]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "n_direct", "n_edge"])


def word_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, n_direct, n_edge): how often word a (b null), or word b after a, comes in blocks, and in direct ones.

    A line's first word, and its last if it ends in a hyphen, may be parts of words. The last is left out; the first,
    and its pair with the second, count in n_edge only, and only for scanned blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for batch in batches:
            # a batch is listed first, as numbering a long list is cheaper than many short ones
            listed: dict[str, list[str]] = {kind: [] for kind in held.runs}
            for text, method in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = plain(text).split() if text else None
                if not tokens:
                    continue
                if tokens[-1][-1] in HYPHENS:
                    tokens.pop()
                own = listed["direct" if method == "direct" else "scanned"]
                own += tokens[1:]
                own.append("")
                if method != "direct" and tokens:
                    listed["edge"] += (tokens[0], tokens[1] if len(tokens) > 1 else "", "")
            for kind, own in listed.items():
                held.add(kind, own)
            if held.full():
                yield held.out()
        yield held.out()

    raw = blocks.select("text", "method").mapInArrow(run, "a string, b string, n long, n_direct long, n_edge long")
    return raw.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("n_direct").alias("n_direct"), F.sum("n_edge").alias("n_edge"))


# ---------------------------------------------------------------------------------------------- lines of pages

#: Parts of a page's height in which a line may be outside the body, and the gap in line heights that sets it apart.
HEAD, FOOT, GAP = 0.12, 0.86, 1.3


def page_lines(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, page_id, document_id, page_number, block_order, text, method, zone, ...) of each block once.

    zone is `head`, `foot` or `body`. A line is at the head if it begins in the page's upper part and a gap follows
    it, or the head lines below it, before the body; at the foot likewise. Blocks without a page or text are left out, and
    so are rows delivered again, equal in every column.
    """
    own = blocks.where("trim(text) <> ''").select("id", "page_id", "block_order", "text", "top", "bottom", "x0", "x1", "method")
    # one shuffle by page serves the join, which needs no order, and the windows, whose order brings doubled rows together
    lines = own.repartition("page_id").join(pages.select(F.col("id").alias("page_id"), "document_id", "page_number", "height").hint("shuffle_hash"), "page_id")
    down = Window.partitionBy("page_id").orderBy("top", "block_order", "id")
    lines = lines.withColumn("again", F.coalesce(F.lag("id").over(down) == F.col("id"), F.lit(False))).where("NOT again").drop("again")
    height = F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0))
    line_height = F.least(height, F.lit(24.0))
    above = F.max("bottom").over(down.rowsBetween(Window.unboundedPreceding, -1))
    below = F.lead("top").over(down)
    lines = lines.withColumn("gap_above", F.coalesce(F.col("top") - above, F.lit(1e9)) >= GAP * line_height).withColumn("gap_below", F.coalesce(below - F.col("bottom"), F.lit(1e9)) >= GAP * line_height)
    in_head = F.col("top") < HEAD * F.col("height")
    in_foot = F.col("top") > FOOT * F.col("height")
    foot = F.max(F.col("gap_above") & in_foot).over(down.rowsBetween(Window.unboundedPreceding, 0))
    head = F.max(F.col("gap_below") & in_head & (F.col("bottom") < HEAD * F.col("height"))).over(down.rowsBetween(0, Window.unboundedFollowing))
    return lines.withColumn("zone", F.when(in_foot & foot, "foot").when(in_head & head & (F.col("top") < 0.095 * F.col("height")), "head").otherwise("body")).drop("gap_above", "gap_below")


FIRST_WORD = r"(?U)^\s*(\S+)"
#: Pages of a document that one task looks through for the next one with a body.
PAGE_RANGE = 256


def linked_lines(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_lines with next_word, the first word of the next line in the zone (null at its end), first, whether it is
    the zone's first line, and after_hyphen, whether the line before ends in a hyphen."""
    order = Window.partitionBy("page_id", "zone").orderBy("block_order", "id")
    before = F.lag("text").over(order)
    return page_lines(pages, blocks).withColumns({"next_word": F.lead(F.regexp_extract("text", FIRST_WORD, 1)).over(order), "first": before.isNull(), "after_hyphen": F.coalesce(F.rtrim(before).rlike(rf"[{HYPHENS}]$"), F.lit(False))})


def next_page_words(firsts: DataFrame) -> DataFrame:
    """(document_id, page_number, next_word): for each page with a body, the first body word of the next such page.

    `firsts` (document_id, page_number, word) has a row per page. Documents are looked through in ranges of pages, and
    then range by range, so that no task holds a whole document.
    """
    ranged = firsts.withColumn("range", F.floor(F.col("page_number") / PAGE_RANGE))
    ranges = ranged.groupBy("document_id", "range").agg(F.min_by("word", "page_number").alias("word"))
    ranges = ranges.select("document_id", "range", F.lead("word").over(Window.partitionBy("document_id").orderBy("range")).alias("range_word"))
    within = F.lead("word").over(Window.partitionBy("document_id", "range").orderBy("page_number"))
    return ranged.withColumn("next_word", within).join(ranges, ["document_id", "range"]).select("document_id", "page_number", F.coalesce("next_word", "range_word").alias("next_word"))


# ---------------------------------------------------------------------------------------------- page numbers

NUMBER = r"[\dOoIlSBZGg|!?]{1,6}"
ROMAN = r"[ivxlcIVXLC]{1,7}"
PAGE_NUMBER = regex.compile(
    rf"""\A[\W_]*(?:(?:p[aoe0]g[ec]s?|pg|pp?|s[ec]it[ec]|s|página|pagina|pág|pag|blatt|folio|fol|no|nr|n°|№)\b[\W_]*)?
    (?:(?:[A-Z]{{1,2}}|App|Annex)[\-–.]\s?)?(?:{NUMBER}|{ROMAN})(?:[\W_]*(?:o[ft]|von|d[ec]|sur|di|van|/|\|)?[\W_]*{NUMBER})?[\W_]*\Z""",
    regex.X | regex.I,
)
TRUE_ROMAN = regex.compile(r"\A(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\Z", regex.I)


def is_page_number(text: str) -> bool:
    return bool(PAGE_NUMBER.match(text.strip())) and any(c.isalnum() for c in text)


def wrong_page_number(text: str) -> bool:
    """Whether a page number holds letters where digits belong, or a word of it is spelt wrongly."""
    for word in regex.findall(r"[\w|!?]+", text):
        if regex.fullmatch(r"\d+|pages?|pg|pp?|seite|s|página|pagina|pág|pag|blatt|folio|fol|no|nr|of|von|de|sur|di|van|app|annex", word, regex.I):
            continue
        if TRUE_ROMAN.match(word) and not regex.fullmatch(r"[lI]+|[lI]?l[lI]*", word) and "l" not in word:
            continue
        if regex.fullmatch(r"[A-Z]{1,2}", word) and regex.search(rf"{word}[\-–.]\s?\S", text):
            continue
        return True
    return False


# ---------------------------------------------------------------------------------------------- repairs of words

#: A word seen so often in direct blocks is right; a repair is so many times as frequent as what it replaces.
SEEN, RATIO = 2, 5
#: Of a word's distinct neighbours, the share that must know a repair by plain edits.
SPEAKING = 0.5
#: A word never written small may be a name: it must be so frequent to be put together from parts or to be a repair. One
#: that mentions of entities hold, or any where no mentions are given, repairs only words that hold signs which no name does.
ORDINARY = 20
#: Of all words, sound ones of at least this share are known to every worker: at most 1 / FREQUENT words.
FREQUENT = 2e-6


NAME_PART = regex.compile(r"[\p{L}\p{M}]+")


def name_words(mentions: DataFrame) -> DataFrame:
    """(name): the words in the texts of `mentions`, in small letters, once each. Only texts beyond ASCII go to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {part for text in batch.column(0).to_pylist() for part in NAME_PART.findall(plain(text).lower())}
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["name"])

    ascii_only = F.col("text").rlike(r"\A[\x00-\x7f]*\z")
    simple = mentions.where(ascii_only).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name"))
    return simple.unionAll(mentions.where(~ascii_only).select("text").mapInArrow(run, "name string")).distinct()


def candidates(wrong: DataFrame, lexicon: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """(word, key, n_key, unsure, cost, plain) from the symmetric-delete index: what a wrong word may stand for.

    `plain` candidates cost more than confusions and stray marks do; they need the context to speak for them.
    """
    keys, cost = F.udf(deletes, T.ArrayType(T.StringType())), F.udf(repair_cost, T.DoubleType())
    capital = lexicon.where((F.col("n_lower") < 3) & (F.col("n_key") >= ORDINARY)).select("key")
    if mentions is None:
        names, named = None, capital
    else:
        names = checkpointed(name_words(mentions))
        parts = capital.select("key", F.explode(F.split(F.regexp_replace("key", "['’]s$", ""), r"[^\p{L}\p{M}]+")).alias("name"))
        named = parts.join(names, "name", "left_semi").select("key").distinct()
    targets = lexicon.join(named.withColumn("named", F.lit(True)), "key", "left").withColumn("named", F.coalesce("named", F.lit(False)))
    indexed = targets.where(((F.col("n_lower") >= 3) | (F.col("n_key") >= ORDINARY)) & (F.length("key") >= 2)).select("key", "n_key", "n_lower", "named", (F.col("n_key_direct") < SEEN).alias("unsure"), F.explode(keys("key")).alias("d"))
    asked = wrong.where(F.length("word") >= F.when(F.col("word").rlike(r"^\p{Lu}"), 4).otherwise(2)).select("word", "n", F.explode(keys("word")).alias("d"))
    free = (F.col("n_lower") >= 3) | F.col("word").rlike(r"[\d~|^*_\\!]")
    met = asked.join(indexed, "d").where((F.col("n_key") >= RATIO * F.col("n")) & (free | ~F.col("named") & F.col("word").rlike(r"^\p{Lu}"))).select("word", "key", "n_key", "unsure", free.alias("free")).distinct().withColumn("cost", cost("word", "key")).where(F.col("cost") <= MOST_COST_IN_CONTEXT)
    if names is not None:  # a name is no misread of a word that is never written small
        met = met.join(names.withColumn("is_name", F.lit(True)), F.lower("word") == F.col("name"), "left").withColumn("is_name", F.col("is_name").isNotNull()).where(F.col("free") | ~F.col("is_name"))
    else:
        met = met.withColumn("is_name", F.col("word").rlike(r"^\p{Lu}"))
    plain = F.col("cost") > MOST_COST
    sound = ~F.col("unsure") & ~F.col("is_name") & F.col("free") & F.col("word").rlike(r"^[\p{L}\p{M}'’\-‐]{3,}$")
    return checkpointed(met.where(~plain | sound).select("word", "key", "n_key", "unsure", "cost", plain.alias("plain")))


def in_context(met: DataFrame, counts: DataFrame, known: DataFrame) -> DataFrame:
    """(word, key, cost, plain, a, b, second, n_pair): the candidates that the context is to decide on, with each pair (a, b)
    that their word comes in (as the second of the two, or the first) and how often that pair is known with the
    candidate in the word's place. `known` has (a, b, n_pair)."""
    several = met.groupBy("word").agg(F.count("*").alias("ways"))
    asked = checkpointed(met.join(several, "word").where("plain OR ways > 1").select("word", "key", "cost", "plain"))
    met_in = counts.where("b IS NOT NULL").select("a", "b")
    after = asked.join(met_in, F.col("word") == F.col("b")).select("word", "key", "cost", "plain", "a", "b", F.lit(True).alias("second"), F.lower("a").alias("x"), F.col("key").alias("y"))
    before = asked.join(met_in, F.col("word") == F.col("a")).select("word", "key", "cost", "plain", "a", "b", F.lit(False).alias("second"), F.col("key").alias("x"), F.lower("b").alias("y"))
    pairs = known.select(F.col("a").alias("x"), F.col("b").alias("y"), "n_pair")
    return checkpointed(after.unionAll(before).join(pairs, ["x", "y"], "left").select("word", "key", "cost", "plain", "a", "b", "second", F.coalesce("n_pair", F.lit(0)).alias("n_pair")))


def context_score(n_pair: Column, cost: Column) -> Column:
    """How well a candidate fits between its neighbours: a confusion more weighs as much as e times the pairs."""
    return F.log1p(n_pair) - cost / CONFUSED


def word_repairs(counts: DataFrame, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lexicon, repairs, torn, placed): counts of words, (word, repair, kind) of wrong words, (a, b, repair, rarer) of torn
    ones, and (a, b, second, repair) for words whose repair depends on the word before or after them.

    What is a name is told by `mentions` (text); without them, every word never written small counts as one.
    """
    words = counts.where("b IS NULL").select(F.col("a").alias("word"), "n", "n_direct", "n_edge")
    lower = F.lower("word")
    lexicon = words.where((F.col("n") > 0) & F.col("word").rlike(r"^[\p{L}\p{M}'’\-‐]+$")).groupBy(lower.alias("key")).agg(F.sum("n").alias("n_key"), F.sum("n_direct").alias("n_key_direct"), F.sum(F.when(F.col("word") == lower, F.col("n")).otherwise(0)).alias("n_lower"))
    lexicon = checkpointed(lexicon)
    # what may be wrong: unseen in direct blocks, or in a way of writing that is
    doubtful = words.withColumn("n", F.col("n") + F.col("n_edge")).where((F.col("n_direct") < SEEN) & ~F.col("word").rlike(r"^[\W\d_]*$|^(US\$|RM)[\d.,]*$")).join(lexicon, lower == lexicon["key"], "left")
    regular = (F.col("word") == lower) | (F.col("word") == F.upper("word")) | (F.col("word") == F.initcap("word"))
    doubtful = checkpointed(doubtful.where(~(F.coalesce("n_key_direct", F.lit(0)) >= SEEN) | ~regular).select("word", "n", (F.coalesce("n_key_direct", F.lit(0)) >= SEEN).alias("known")))
    figure = F.udf(lambda w: bool(FIGURE.match(w)), T.BooleanType())
    figures = doubtful.where(F.col("word").rlike(r"\d") & figure("word")).select("word", F.lit(None).cast("string").alias("repair"), F.lit("figure").alias("kind"))
    # oddly capitalised: known but for its capitals; a name of two (McAdam) is not
    cased = doubtful.where(F.col("known") & F.col("word").rlike(r"^\p{Ll}+\p{Lu}|^\p{Lu}\p{Ll}*\p{Lu}+\p{Ll}|\p{Ll}\p{Lu}$")).select("word", lower.alias("repair"), F.lit("case").alias("kind"))
    wrong = doubtful.where(~F.col("known") & ~F.col("word").rlike(r"^[\W\d_]+$"))
    pairs = counts.where("b IS NOT NULL AND n > 0").select(F.lower("a").alias("a"), F.lower("b").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n_pair")).where(F.col("n_pair") >= SEEN)
    # torn apart: neighbours that no direct block has, that together are a word known much better than the pair
    loose = counts.where("b IS NOT NULL").where((F.col("n_direct") == 0) & F.col("a").rlike(r"^[\p{L}'’\-]+$") & F.col("b").rlike(r"^[\p{L}'’\-]+$") & ~F.concat("a", "b").rlike(r"^\p{Lu}{2}$")).select("a", "b", (F.col("n") + F.col("n_edge")).alias("n"), F.lower(F.concat("a", "b")).alias("key"))
    torn = torn_words(loose, lexicon)
    met = candidates(wrong, lexicon, mentions)
    weighed = in_context(met, counts, pairs)
    # a common misreading may be in the lexicon itself: what direct blocks hold goes first, then what the context speaks for
    support = weighed.groupBy("word", "key").agg(F.max(F.log1p("n_pair")).alias("support"), F.avg((F.col("n_pair") > 0).cast("double")).alias("share"))
    fit = met.join(support, ["word", "key"], "left")
    spelt = fit.where("NOT plain").groupBy("word").agg(F.min_by("key", F.struct("unsure", F.col("cost") / CONFUSED - F.coalesce("support", F.lit(0.0)), -F.col("n_key"), "key")).alias("repair")).withColumn("kind", F.lit("word"))
    # two words run together: both known, and met as neighbours elsewhere
    most = F.least(F.length("word") - 1, F.lit(LONG))
    split = wrong.where((F.length("word") >= 3) & (F.length("word") <= 2 * LONG) & F.col("word").rlike(r"^(\p{Ll}|\p{Lu}.{4})[\p{L}'’\-]*$")).select("word", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.length("word") - LONG), most), lambda k: F.struct(F.substring(lower, F.lit(1), k).alias("a"), F.substring(lower, k + 1, F.length("word")).alias("b")))).alias("s")).select("word", "s.*")
    run = split.join(pairs, ["a", "b"]).groupBy("word").agg(F.max_by(F.concat_ws(" ", "a", "b"), "n_pair").alias("repair")).withColumn("kind", F.lit("run"))
    # any other wrong letter: most of the word's neighbours know the candidate, and the word is no part of a torn one
    parts = torn.select(F.lower("a").alias("part")).unionAll(torn.select(F.lower("b"))).distinct()
    edited = fit.where(F.col("plain") & (F.col("share") >= SPEAKING)).join(parts, lower == F.col("part"), "left_anti")
    edited = edited.groupBy("word").agg(F.max_by("key", F.struct(context_score(F.exp("support"), F.col("cost")), "n_key", "key")).alias("repair")).withColumn("kind", F.lit("edit"))
    repairs = figures.unionAll(cased).unionAll(spelt).unionAll(run.join(spelt.select("word"), "word", "left_anti"))
    repairs = checkpointed(repairs.unionAll(edited.join(repairs.select("word"), "word", "left_anti")))
    # per occurrence: of what the words beside it know, the candidate that fits best
    apt = weighed.where("n_pair > 0").join(repairs.where("kind IN ('word', 'edit')").select("word", "kind"), "word").where(~F.col("plain") | (F.col("kind") == "edit"))
    placed = apt.groupBy("a", "b", "second").agg(F.max_by("key", F.struct(context_score(F.col("n_pair"), F.col("cost")), "key")).alias("repair"), F.max(context_score(F.col("n_pair"), F.col("cost"))).alias("fits"))
    return lexicon, repairs, torn, placed


def torn_words(loose: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(a, b, repair, rarer) of `loose` pairs that are one word: it is better known than they are, and one of them hardly is."""
    whole = loose.join(lexicon, "key").where(((F.col("n_lower") >= 3) | (F.col("n_key") >= ORDINARY)) & (F.col("n_key") >= RATIO * F.col("n")))
    part = lexicon.select(F.col("key").alias("part"), F.col("n_key_direct").alias("n_part"))
    with_a = whole.select("a", "b", "n", F.col("key").alias("repair"), "n_key").join(part.withColumnRenamed("n_part", "n_a"), F.lower("a") == F.col("part"), "left").drop("part")
    with_b = with_a.join(part.withColumnRenamed("n_part", "n_b"), F.lower("b") == F.col("part"), "left").drop("part")
    rarer = F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    torn = with_b.where(rarer < F.col("n_key") / RATIO)
    return checkpointed(torn.select("a", "b", "repair", F.when(F.coalesce("n_a", F.lit(0)) < F.coalesce("n_b", F.lit(0)), F.col("a")).otherwise(F.col("b")).alias("rarer")))


def sound_words(counts: DataFrame, repairs: DataFrame, torn: DataFrame) -> frozenset[str]:
    """Frequent words that need no repair and are not the rarer part of a torn one; their number is bounded by 1 / FREQUENT."""
    words = counts.where("b IS NULL")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= max(2, FREQUENT * total)).select(F.col("a").alias("word")).join(repairs.select("word").unionAll(torn.select("rarer")), "word", "left_anti")
    return frozenset(row["word"] for row in frequent.toLocalIterator())


# ---------------------------------------------------------------------------------------------- findings

FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("defect", T.StringType()), T.StructField("role", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("page_number", T.LongType())])
PART_BEFORE, PART_AFTER = regex.compile(r"[\p{L}\p{M}'’]+(?=[" + HYPHENS + r"]\Z)"), regex.compile(r"[\p{L}\p{M}'’]+")


def hyphen_roles(last: str, following: str | None) -> list[tuple[str, str | None]]:
    """What decides whether a line's last token, which ends in a hyphen, is a word cut before `following`.

    `sure` alone where the mark is none that compounds have; else the words whose counts decide; nothing if either side
    is not of letters.
    """
    left, right = PART_BEFORE.search(last), PART_AFTER.match(plain(following or ""))
    if not left or not right:
        return []
    if last[-1] != "-":
        return [("sure", None)]
    a, b = left.group().lower(), right.group().lower()
    return [("left", a), ("right", b), ("joined", core(last[:-1]).lower() + b), ("hyphened", a + "-" + b)]


def line_findings(lines: DataFrame, sound: frozenset[str]) -> DataFrame:
    """(id, defect, role, a, b, document_id, page_number): what a line shows by itself, and what is to be looked up for it.

    role `sure` is a defect; `word` and `pair` are misread if they have a repair; `left`, `right`, `joined` and
    `hyphened` are words whose counts decide a hyphen; `open` is a last token of a page's body that ends in a hyphen,
    and `first` the first word of a page's body.
    """
    shared = lines.sparkSession.sparkContext.broadcast(sound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            out: list[tuple] = []
            for key, text, method, zone, next_word, first, after_hyphen, document, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = plain(text) if "\u00ad" not in text[-2:] else text
                outside = zone != "body"
                if outside:
                    numbered = is_page_number(text)
                    out.append((key, "page_number" if numbered else "running_line", "sure", None, None, None, None))
                    if numbered:
                        if method == "ocr" and wrong_page_number(text):
                            out.append((key, "misread", "sure", None, None, None, None))
                        continue
                tokens = text.split()
                if not tokens:
                    continue
                if first and not outside:
                    out.append((key, None, "first", tokens[0], None, document, page))
                cut = tokens[-1][-1] in HYPHENS and len(tokens[-1]) > 1
                if cut and not outside:
                    if next_word is None:
                        out.append((key, "hyphen", "open", tokens[-1], None, document, page))
                    else:
                        out += [(key, "hyphen", role, word, None, None, None) for role, word in hyphen_roles(tokens[-1], next_word)]
                if method == "ocr":
                    last = len(tokens) - cut
                    cores = list(map(core, tokens))
                    if known.issuperset(cores):
                        continue
                    for k in range(1 if after_hyphen else 0, last):
                        word = cores[k]
                        if word and word not in known and not PURE_FIGURE.match(word):
                            out.append((key, "misread", "word", word, None, None, None))
                            if k:
                                out.append((key, "misread", "pair", cores[k - 1], word, None, None))
                            if k + 1 < last:
                                out.append((key, "misread", "pair", word, cores[k + 1], None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=FOUND.fieldNames())

    return lines.select(F.col("id").cast("long"), "text", "method", "zone", "next_word", "first", "after_hyphen", "document_id", F.col("page_number").cast("long")).mapInArrow(run, FOUND)


def across_pages(findings: DataFrame) -> DataFrame:
    """(id, role, a) for the hyphens at the end of a page's body, by the next page that has one."""
    roles = F.udf(hyphen_roles, T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("a", T.StringType())])))
    following = next_page_words(findings.where("role = 'first'").select("document_id", "page_number", F.col("a").alias("word")))
    met = findings.where("role = 'open'").select("id", F.col("a").alias("last"), "document_id", "page_number").join(following, ["document_id", "page_number"])
    return met.select("id", F.explode(roles("last", "next_word")).alias("r")).select("id", "r.role", "r.a")


def cut_by_hyphen(n: dict[str, Column]) -> Column:
    """Whether a plain hyphen at a line's end cuts a word: the word without it is known better than the compound with
    it; where neither is known, unless both parts are words of their own."""
    known = (n["joined"] > 0) & (n["joined"] >= n["hyphened"])
    return known | ((n["joined"] == 0) & (n["hyphened"] == 0) & ((n["left"] < SEEN) | (n["right"] < SEEN)))


def hyphen_cuts(findings: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, defect): the lines whose last word a hyphen cuts."""
    over = across_pages(findings)
    roles = ("left", "right", "joined", "hyphened")
    sure = findings.where("role = 'sure' AND defect = 'hyphen'").select("id").unionAll(over.where("role = 'sure'").select("id"))
    asked = findings.where(F.col("role").isin(*roles)).select("id", "role", "a").unionAll(over.where(F.col("role").isin(*roles)))
    seen = {role: F.max(F.when(F.col("role") == role, F.coalesce("n_key", F.lit(0))).otherwise(0)) for role in roles}
    weighed = asked.join(lexicon, F.col("a") == F.col("key"), "left").groupBy("id").agg(cut_by_hyphen(seen).alias("cut")).where("cut").select("id")
    return sure.unionAll(weighed).withColumn("defect", F.lit("hyphen"))


def scan_defects(pages: DataFrame, blocks: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(block_id, defect): every block with each of its defects, once. `mentions` (text) tell names from other words.

    Null and blank blocks and blocks of no page have none. Only blocks of method `ocr` can be misread. Rows delivered
    twice count twice in the lexicon, where it does not matter, and once here.
    """
    counts = checkpointed(word_counts(blocks))
    lexicon, repairs, torn, _ = word_repairs(counts, mentions)
    findings = checkpointed(line_findings(linked_lines(pages, blocks), sound_words(counts, repairs, torn)))
    sure = findings.where("role = 'sure' AND defect <> 'hyphen'").select("id", "defect")
    wrong = findings.where("role = 'word'").join(repairs, F.col("a") == F.col("word"), "left_semi").select("id", "defect")
    apart = findings.where("role = 'pair'").join(torn, ["a", "b"], "left_semi").select("id", "defect")
    cut = hyphen_cuts(findings, lexicon)
    return sure.unionAll(wrong).unionAll(apart).unionAll(cut).distinct().select(F.col("id").alias("block_id"), "defect")


# ---------------------------------------------------------------------------------------------- paragraphs


def line_repairs(findings: DataFrame, repairs: DataFrame, torn: DataFrame, placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """(id, words, pairs, placed, cut): per block the repairs of its words, its torn pairs, the repairs that depend on a
    neighbour, and whether its last word is cut.

    A block's repairs are as many as its words at most."""
    words = findings.where("role = 'word'").join(repairs.where("repair IS NOT NULL"), F.col("a") == F.col("word")).groupBy("id").agg(F.collect_set(F.struct("word", "repair")).alias("words"))
    both = torn.select("a", "b", F.lit(None).cast("boolean").alias("second"), F.lit(None).cast("string").alias("repair"), F.lit(None).cast("double").alias("fits")).unionAll(placed)
    pairs = findings.where("role = 'pair'").select("id", "a", "b").join(both, ["a", "b"]).groupBy("id").agg(F.collect_set(F.when(F.col("second").isNull(), F.struct("a", "b"))).alias("pairs"), F.collect_set(F.when(F.col("second").isNotNull(), F.struct("a", "b", "second", "repair", "fits"))).alias("placed"))
    cut = cuts.select("id", F.lit(True).alias("cut")).distinct()
    return words.join(pairs, "id", "full_outer").join(cut, "id", "full_outer")


def carried_words(findings: DataFrame, cuts: DataFrame) -> DataFrame:
    """(id, rest, taken): the lines that take a word's rest over from the next page with a body, and those that give it.

    A body's last line takes the next body's first word as `rest` where a hyphen cuts its own last word, or parts a
    compound. The line that the word is from has `taken`. No two lines take the same one, and none takes a word that is
    cut itself, on a page whose body is that word.
    """
    firsts = findings.where("role = 'first'").select("document_id", "page_number", F.struct("a", "id").alias("word"))
    ends = findings.where("role = 'open'").select("id", F.col("a").alias("last"), "document_id", "page_number")
    met = ends.join(next_page_words(firsts), ["document_id", "page_number"]).where(F.col("next_word").isNotNull()).groupBy("id", "last").agg(F.min("next_word").alias("next")).select("id", "last", F.col("next.a").alias("rest"), F.col("next.id").alias("from"))
    met = met.where(~F.col("rest").rlike(rf"[{HYPHENS}]$")).join(cuts.select("id", F.lit(True).alias("is_cut")).distinct(), "id", "left")
    compound = F.col("last").rlike(r"\p{L}-$") & F.col("rest").rlike(r"^\p{Ll}") & ~F.col("rest").isin(*SUSPENDING)
    given = checkpointed(met.where(F.col("is_cut") | compound).groupBy("from").agg(F.min_by(F.struct("id", "rest"), "id").alias("by")).select("from", "by.*"))
    rows = given.select("id", "rest", F.lit(False).alias("taken")).unionAll(given.select(F.col("from").alias("id"), F.lit(None).cast("string").alias("rest"), F.lit(True).alias("taken")))
    return rows.groupBy("id").agg(F.max("rest").alias("rest"), F.max("taken").alias("taken"))


DIGITS = str.maketrans("OoIlSBZGgqb?!|", "00115826996711")


#: Words before which a compound's hyphen stands for the rest of a later one (long- and short-term).
SUSPENDING = frozenset("and or to und oder et ou y o".split())


def repaired_tokens(text: str, words: dict[str, str], pairs: set[tuple[str, str]], placed: dict[tuple[str, str, bool], tuple[float, str]]) -> list[str]:
    """The tokens of a line with its repairs made: capitals as they were, figures' letters as digits, torn words whole.

    `placed` has, by a pair and whether the word is its second, how well which repair fits there; it goes before `words`.
    """
    tokens = plain(text).split()
    if not words and not pairs and not any(map(str.isdigit, text)):
        return tokens
    cores = list(map(core, tokens))
    out: list[str] = []
    k = 0
    while k < len(tokens):
        token, own = tokens[k], cores[k]
        if k + 1 < len(tokens) and (own, cores[k + 1]) in pairs:
            out.append(token + tokens[k + 1])
            k += 2
            continue
        if own in words:
            fitting = [placed.get((cores[k - 1], own, True)) if k else None, placed.get((own, cores[k + 1], False)) if k + 1 < len(tokens) else None]
            meant = max(filter(None, fitting), default=(0.0, words[own]))[1]
            first = next((c for c in own if c.isalpha()), "")
            if own.isupper() and len(own) > 1:
                meant = meant.upper()
            elif first.isupper() and own[:1].isupper():
                meant = meant[:1].upper() + meant[1:]
            token = token.replace(own, meant, 1)
        elif FIGURE.match(own) and not PURE_FIGURE.match(own):
            head = regex.match(r"(?:US\$|RM|[€£$¥(\[+\-])*", own).group()
            token = token.replace(own, head + own[len(head) :].translate(DIGITS), 1)
        out.append(token)
        k += 1
    return out


def without_first(text: str) -> str:
    """A line's text without its first word."""
    return "".join(plain(text).split(maxsplit=1)[1:])


def paragraphs_of(lines: list[tuple], rest: str | None = None) -> list[str]:
    """Paragraphs of a page's body lines in order, each (text, x1, bottom - top, cut, word repairs, torn pairs, placed repairs).
    `rest` of the page's last word, from the next page, completes it.

    A line that ends a sentence well before the column's edge ends a paragraph, as does a heading-like one (few words,
    no stop, the next begins with a capital) and one of mostly figures. Words cut at a line's end are put together, and
    compounds parted at their own hyphen.
    """
    ends = sorted(x1 for _, x1, *_ in lines)
    edge = ends[(3 * len(ends)) // 4] if ends else 0.0
    done: list[str] = []
    held: list[str] = []
    glue: str | None = None
    for n, (text, x1, _, cut, words, pairs, placed) in enumerate(lines):
        tokens = repaired_tokens(text, words, pairs, placed)
        if not tokens:
            continue
        whole = len(tokens)
        if glue is not None and held:
            if glue == "cut" or tokens[0][:1].islower() and tokens[0] not in SUSPENDING:
                held[-1] = (held[-1].rstrip(HYPHENS) if glue == "cut" else held[-1]) + tokens.pop(0)
        held += tokens
        glue = "cut" if cut else "compound" if held[-1][-1:] == "-" and held[-1][-2:-1].isalpha() else None
        if rest and n == len(lines) - 1 and held:
            held[-1] = (held[-1].rstrip(HYPHENS) if cut else held[-1]) + rest
            glue = None
        following = lines[n + 1][0].lstrip() if n + 1 < len(lines) else ""
        short = x1 < 0.85 * edge
        stopped = bool(regex.search(r"[.!?:…][\"'”’»)\]]*\Z", text.rstrip()))
        heading = short and not stopped and following[:1].isupper() and whole <= 6
        figures = 2 * sum(any(c.isdigit() for c in t) for t in tokens) >= whole > 1
        if glue is None and (short and stopped or heading or figures or not following):
            done.append(" ".join(held))
            held = []
    if held:
        done.append(" ".join(held))
    return done


def page_paragraphs(pages: DataFrame, blocks: DataFrame, mentions: DataFrame | None = None, over_pages: bool = False) -> DataFrame:
    """(page_id, paragraph, text): the continuous, repaired paragraphs of each page's printed body, from 0.

    Running lines and page numbers are left out, cut words joined, misread words repaired where a repair is known and
    the rest left as it is; `mentions` (text) tell names from other words. A word cut at the page's end is
    completed there by the next page's first word, which that page then lacks, if `over_pages`; else pages are taken one by
    one, and it stays cut. Pages without a body have no rows. A page's
    lines are one group, whose size paper bounds.
    """
    counts = checkpointed(word_counts(blocks))
    lexicon, repairs, torn, placed = word_repairs(counts, mentions)
    lines = checkpointed(linked_lines(pages, blocks))
    findings = checkpointed(line_findings(lines, sound_words(counts, repairs, torn)))
    cuts = checkpointed(hyphen_cuts(findings, lexicon))
    fixes = line_repairs(findings, repairs, torn, placed, cuts)
    if over_pages:
        fixes = fixes.join(carried_words(findings, cuts), "id", "full_outer")
    else:
        fixes = fixes.withColumns({"rest": F.lit(None).cast("string"), "taken": F.lit(False)})
    body = lines.where("zone = 'body'").select(F.col("id").cast("long").alias("id"), "page_id", "block_order", "text", "x1", (F.col("bottom") - F.col("top")).alias("h")).join(fixes, "id", "left")
    grouped = body.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("block_order", "id", "text", "x1", "h", "cut", "words", "pairs", "placed", "rest", "taken"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = [], [], []
            listed = batch.column(1)
            offsets, lines = listed.offsets.to_pylist(), listed.flatten()
            first = offsets[0] if offsets else 0
            text, x1, h, cut, words, pairs, placed, rest, taken = (lines.field(name).to_pylist() for name in ("text", "x1", "h", "cut", "words", "pairs", "placed", "rest", "taken"))
            for page, begin, end in zip(batch.column(0).to_pylist(), offsets, offsets[1:], strict=False):
                own = [
                    (
                        without_first(text[k]) if taken[k] else text[k], x1[k] or 0.0, h[k] or 0.0, bool(cut[k]), {w["word"]: w["repair"] for w in words[k] or ()},
                        {(p["a"], p["b"]) for p in pairs[k] or ()}, {(p["a"], p["b"], p["second"]): (p["fits"], p["repair"]) for p in placed[k] or ()},
                    )
                    for k in range(begin - first, end - first)
                ]
                for n, paragraph in enumerate(paragraphs_of(own, rest[end - first - 1])):
                    ids.append(page)
                    numbers.append(n)
                    texts.append(paragraph)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["page_id", "paragraph", "text"])

    return grouped.select(F.col("page_id").cast("long"), "lines").mapInArrow(run, "page_id long, paragraph long, text string")
