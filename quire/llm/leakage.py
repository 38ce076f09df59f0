"""Problem 7: evaluation passages inside a training corpus.

Multi-pattern search after Wu and Manber, with words for letters: every run of a few words of a passage is a test
string. A table over blocks of two words says how far the search may jump; where it may not, the block's bucket holds
the test strings that end in it, and those are compared word by word. From each occurrence the passage is laid along
the document and what the two share around it is counted.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.characters import SUSPECT, consistent

MARKS = regex.compile(r"[^\w\s]+|_+")
ODD = regex.compile(SUSPECT)
#: Words of a test string and of a block. Where a fifth of the words is changed, runs of four are still whole.
LENGTH, BLOCK = 4, 2
#: Words of passages that are broadcast at a time; more go in further passes over the documents.
PASSAGE_WORDS = 2_000_000
#: A leak holds this share of a passage's words, with gaps of at most so many changed words.
SHARE, GAP = 0.5, 4
#: Of what is held, this share of words is equal.
EQUAL = 0.8
#: At least this share of it lies in whole test strings: the rest may be runs of up to three words between changed ones.
CLEAN = 0.4
#: How many words to leave out on either side after an unequal one, the fewest first, then the most alike on both sides.
WAYS = tuple(sorted(((a, b) for a in range(GAP + 1) for b in range(GAP + 1) if a or b), key=lambda w: (sum(w), abs(w[0] - w[1]), w)))


def normal_words(text: str) -> list[str]:
    """What white space parts, in lower case, in one character form and without punctuation, also inside: a copy may
    have lost its hyphens and the commas of its figures."""
    if ODD.search(text):
        text = unicodedata.normalize("NFKC", consistent(text)[0])
    return MARKS.sub("", text.casefold()).split()


class Passages:
    """Search tables over passages, each given as (item, text)."""

    def __init__(self, passages: list[tuple[str, str]], length: int = LENGTH):
        self.items = [item for item, _ in passages]
        self.words = [normal_words(text) for _, text in passages]
        self.length = length
        kept: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for p, words in enumerate(self.words):
            size = min(length, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                kept[tuple(words[at : at + size])].append((p, at))
        #: passages of fewer words than a test string, by their number
        self.short: dict[int, dict[tuple[str, ...], list[tuple[int, int]]]] = defaultdict(dict)
        for string, at in kept.items():
            if len(string) < length:
                self.short[len(string)][string] = at
        self.jump = length - BLOCK + 1
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], int]] = defaultdict(dict)
        #: the places of all test strings one after the other, and where those of each begin
        lists = [at for string, at in kept.items() if len(string) == length]
        self.begin = np.concatenate([[0], np.cumsum([len(at) for at in lists], dtype=np.int64)]).astype(np.int64)
        self.owner = np.array([p for at in lists for p, _ in at], dtype=np.int64)
        self.at = np.array([k for at in lists for _, k in at], dtype=np.int64)
        self.sizes = np.array([len(words) for words in self.words] or [0], dtype=np.int64)
        for number, string in enumerate(string for string in kept if len(string) == length):
            for end in range(BLOCK, length + 1):
                block = string[end - BLOCK : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            self.bucket[string[-BLOCK:]][string] = number

    def hits(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The numbers of the test strings in `words` and where they begin."""
        numbers, starts, length, jump, shift = [], [], self.length, self.jump, self.shift
        blocks = list(zip(words, words[1:]))
        end, last = length - 2, len(blocks)  # blocks[end] is the window's last block
        while end < last:
            step = shift.get(blocks[end], jump)
            if step:
                end += step
                continue
            start = end + 2 - length
            number = self.bucket[blocks[end]].get(tuple(words[start : end + 2]))
            if number is not None:
                numbers.append(number)
                starts.append(start)
            end += 1
        return numbers, starts

    def placed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays (passage, place in it, place in `words`) of every test string in `words`."""
        numbers, starts = (np.array(x, dtype=np.int64) for x in self.hits(words))
        counts = self.begin[numbers + 1] - self.begin[numbers]
        ends = np.cumsum(counts)
        each = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + counts, counts)
        found = [(self.owner[each], self.at[each], np.repeat(starts, counts))]
        for size, strings in self.short.items():
            rows = [(p, at, start) for start in range(len(words) - size + 1) for p, at in strings.get(tuple(words[start : start + size]), ())]
            found.append(tuple(np.array([r[k] for r in rows], dtype=np.int64) for k in range(3)))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def occurrences(self, words: list[str]) -> list[tuple[int, int, int]]:
        """The same as a list."""
        return list(zip(*(x.tolist() for x in self.placed(words))))

    def shared(self, p: int, words: list[str], at: int, start: int) -> tuple[int, int, int]:
        """From a common word at passage place `at` and document place `start`: (first, last + 1 in the passage, equal words).

        Runs on in both directions over equal words; at an unequal one the nearest pair of equal words (two in a row)
        within GAP words on either side continues it.
        """
        own = self.words[p]

        def run(i: int, j: int, step: int) -> tuple[int, int]:
            equal, edge, n, m = 0, i, len(own), len(words)
            while 0 <= i < n and 0 <= j < m:
                if own[i] == words[j]:
                    equal += 1
                    i, j = i + step, j + step
                    edge = i
                    continue
                for a, b in WAYS:
                    k, x = i + step * a, j + step * b
                    if 0 <= k < n and 0 <= x < m and own[k] == words[x]:
                        k, x = k + step, x + step
                        if not (0 <= k < n and 0 <= x < m) or own[k] == words[x]:
                            i, j = k - step, x - step
                            break
                else:
                    break
            return edge, equal

        right, n = run(at, start, 1)
        left, m = run(at - 1, start - 1, -1)
        return min(left + 1, at) if m else at, right, n + m

    def candidates(self, words: list[str], share: float) -> Iterator[tuple[int, int, int]]:
        """(passage, place in it, place in `words`) in the middle of test strings that may be of a leak.

        Those of a passage are taken together while their places in it and in `words` differ by nearly the same. They have
        to lie all along the share of the passage, and to cover as much of it as changes leave whole; those of a sentence
        in common end soon after they begin.
        """
        owner, at, start = self.placed(words)
        if not len(owner):
            return
        key = (owner << 40) + (start - at + (1 << 32))
        order = np.argsort(key)
        key, at, start = key[order], at[order], start[order]
        # another passage is 1 << 40 away at least, but for the places of a text
        new = np.concatenate([[True], np.diff(key) > 3 * GAP])
        begins = np.flatnonzero(new)
        size = self.sizes[key[begins] >> 40]
        length = np.minimum(self.length, size)
        count = np.diff(np.append(begins, len(key)))
        span = np.maximum.reduceat(at, begins) - np.minimum.reduceat(at, begins) + length
        live = (span >= share * size / 2) & (count * length >= CLEAN * share * size)
        if not live.any():
            return
        group = np.cumsum(new) - 1
        kept = live[group]
        group, at, start = group[kept], at[kept], start[kept]
        order = np.argsort((group << 24) + at, kind="stable")
        group, at, start = group[order], at[order], start[order]
        begins = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0]))
        step = np.append(np.diff(at), 0)
        step[np.append(begins[1:], len(at)) - 1] = self.length
        covered = np.add.reduceat(np.minimum(step, self.length), begins)
        size = size[live]
        middles = (begins + np.append(begins[1:], len(at))) // 2
        passage = (key[new] >> 40)[live]
        for k in np.flatnonzero(np.minimum(covered, size) >= CLEAN * share * size).tolist():
            yield int(passage[k]), int(at[middles[k]]), int(start[middles[k]])

    def leaks(self, words: list[str], share: float = SHARE) -> dict[str, float]:
        """Items of which `words` holds at least `share` of a passage, with the largest share held.

        Changed words inside what is held count as held; of a run at the very edge of the share one word may be off.
        """
        best: dict[str, float] = {}
        for p, at, start in self.candidates(words, share):
            size = len(self.words[p])
            first, last, equal = self.shared(p, words, at, start)
            if last - first >= share * size - 1 and equal >= EQUAL * (last - first):
                best[self.items[p]] = max(best.get(self.items[p], 0.0), (last - first) / size)
        return best


def passage_list(benchmark: DataFrame) -> list[tuple[str, str]]:
    """(uid, passage) of every evidence of the held-out items; the items are a fixed set that is searched for as a whole."""
    rows = benchmark.select("uid", F.explode("evidence").alias("e")).select("uid", F.col("e.block_text").alias("text")).where("text IS NOT NULL").distinct()
    return sorted((r["uid"], r["text"]) for r in rows.toLocalIterator())


def blocks_of(passages: list[tuple[str, str]], most: int = PASSAGE_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The passages in blocks of at most `most` words, or of one longer passage."""
    block, size = [], 0
    for item, text in passages:
        words = text.count(" ") + 1
        if block and size + words > most:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += words
    if block:
        yield block


def leaking(documents: DataFrame, passages: list[tuple[str, str]], id_column: str = "doc_id", text_column: str = "text", share: float = SHARE, most: int = PASSAGE_WORDS) -> DataFrame:
    """(id, uid, held): the documents that hold at least `share` of the words of a passage of an item, once per item.

    The search tables of the held-out passages are broadcast, `most` words of them at a time; documents are read once for
    each such block and nothing but the result is shuffled. Every passage that a test string is from is looked at: a
    stock phrase makes no case, as what is laid along the document from it ends with it. Null and empty texts, and no
    passages, give no rows.
    """
    source = documents.select(F.col(id_column), F.col(text_column).alias("text"))
    kind = f"`{id_column}` {source.schema[0].dataType.simpleString()}, uid string, held double"

    def searched(block: list[tuple[str, str]]) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(Passages(block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for batch in batches:
                rows = [(k, uid, held) for k, text in enumerate(batch.column(1).to_pylist()) if text for uid, held in tables.leaks(normal_words(text), share).items()]
                keys = batch.column(0).take(pa.array([k for k, _, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([u for _, u, _ in rows], pa.string()), pa.array([h for _, _, h in rows], pa.float64())], names=[id_column, "uid", "held"])

        return source.mapInArrow(run, kind)

    found = None
    for block in blocks_of(passages, most):
        found = searched(block) if found is None else found.unionAll(searched(block))
    if found is None:
        return documents.sparkSession.createDataFrame([], kind)
    return found.groupBy(id_column, "uid").agg(F.max("held").alias("held"))
