"""Problem 6: encoding of a whole corpus with a public byte-level BPE tokenizer.

A text is cut into pretokens by the tokenizer's pattern. Each distinct pretoken is encoded by dynamic programming over
its byte prefixes: for every prefix there is exactly one token that the prefix's encoding can end with, so storing that
token per prefix is enough to walk back to the ids, to continue when bytes are appended, and to restart after an edit
from the last prefix that it left alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of the public byte-level tokenizers that parts a text into pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries that a worker remembers; beyond it starts anew, which costs time but changes no result.
REMEMBERED = 300_000


class PrefixEncoder:
    """Exact byte-pair encoding by one stored token per byte prefix.

    `vocabulary` holds lines of a token in base64 and its id, which is also its merge rank.
    """

    def __init__(self, vocabulary: bytes):
        self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            lengths.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {end: sorted(own, reverse=True) for end, own in lengths.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The encoding by its definition: join the adjacent pair of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], len(self.ids)), i) for i in range(len(parts) - 1))
            if rank == len(self.ids):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
        return known

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """`last[i]` is the last token of the encoding of `piece[:i]` (-1 for none); grows `last` to all of `piece`."""
        if not last:
            last.append(-1)
        for end in range(len(last), len(piece) + 1):
            found = -1
            for length in (*self.lengths.get(piece[max(0, end - 2) : end], ()), *((1,) if end > 1 else ())):
                token = self.ids.get(piece[end - length : end]) if length <= end else None
                if token is not None and (length == end or self.may_follow(last[end - length], token)):
                    found = token
                    break
            if found < 0:
                raise ValueError("the vocabulary does not cover every byte")
            last.append(found)
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids that lead to the longest prefix of `last`."""
        at, ids = len(last) - 1, []
        while at > 0:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        return self.walk(self.extend(piece, []))


class TextEncoder:
    """Ids of whole texts, with what was already worked out remembered by pretoken and by word."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.encoder = PrefixEncoder(vocabulary)
        self.pattern = regex.compile(pattern)
        self.pretokens = _Remembered(lambda piece: np.array(self.encoder.encode(piece.encode()), dtype=np.int32).tobytes())
        self.words = _Remembered(self._word)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(text)))

    def _word(self, word: str) -> bytes:
        if not word or word[-1].isspace():
            raise _NotAlone
        return self._pieces(" " + word)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers.

        A plain space after a visible character always starts a pretoken, so the words between such spaces encode
        alone; a text in which white space meets a plain space is cut by the pattern as a whole instead.
        """
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise _NotAlone
            return self._pieces(first) + b"".join(map(self.words.__getitem__, rest))
        except _NotAlone:
            return self._pieces(text)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist() if text else []


class _NotAlone(Exception):
    pass


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class EncodedText:
    """A text with its ids that can be appended to and edited without encoding all of it again."""

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces = encoder.pattern.findall(text)

    @property
    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(map(self.encoder.pretokens.__getitem__, self.pieces)), dtype=np.int32).tolist()

    def append(self, more: str) -> EncodedText:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> EncodedText:
        """Puts `new` in place of text[start:end]; pretokens are cut again only around it.

        Pretokens that end before the one before the edit stay. Cutting goes on until a boundary of the new text falls
        on an old one beyond the edit, from where the old pretokens hold again.
        """
        at = kept = 0
        while kept < len(self.pieces) and at + len(self.pieces[kept]) < start:
            at += len(self.pieces[kept])
            kept += 1
        if kept:  # white space before the edit may be parted differently after it
            kept -= 1
            at -= len(self.pieces[kept])
        old, boundary = {}, 0
        for k, piece in enumerate(self.pieces):
            if boundary > end:
                old[boundary] = k
            boundary += len(piece)
        text = self.text[:start] + new + self.text[end:]
        shift, middle, tail = len(new) - (end - start), [], []
        for found in self.encoder.pattern.finditer(text, at):
            if found.start() - shift in old and found.start() > start + len(new):
                tail = self.pieces[old[found.start() - shift] :]
                break
            middle.append(found.group())
        self.pieces[kept:] = middle + tail
        self.text = text
        return self


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str) -> TextEncoder:
    return TextEncoder(vocabulary, pattern)


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, ids): every row's token ids, without special tokens, whose strings count as ordinary text.

    A null text and an empty one give an empty list. A row per input row, repeated rows included; other columns are
    not read. No shuffle: the vocabulary (a fixed file) is broadcast and each Arrow batch is encoded where it is read.
    """
    with open(vocabulary, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            packed = [encoder.packed(text) if text else b"" for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
            start = 0
            while start < len(packed):  # an Arrow list of 32-bit offsets holds 2^31 ids at most
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + 2**27, side="right")) - 1)
                values = pa.array(np.frombuffer(b"".join(packed[start:stop]), dtype=np.int32))
                ids = pa.ListArray.from_arrays(pa.array((offsets[start : stop + 1] - offsets[start]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids], names=[id_column, "ids"])
                start = stop

    source = documents.select(F.col(id_column), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"`{id_column}` {source.schema[0].dataType.simpleString()}, ids array<int>")
