"""Encoding of texts with a public byte-level BPE tokenizer, by prefix dynamic programming.

BPE has a property that makes it incremental: a sequence of tokens is the encoding of its
bytes exactly if each two neighbours are the encoding of their joined bytes. So for every
byte prefix there is one valid last token, and the table of these last tokens is the whole
state: appending bytes extends it, an edit keeps the part before it and, once the last
tokens agree with the old ones again, the part after it, and the encoding is read off from
the end. Tokens never cross the pieces that the tokenizer's pattern cuts a
text into, so each distinct piece is encoded once per worker.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Vocabulary file (ranks); a parameter of every function here, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts texts into pieces (fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: At most so many pieces are remembered by a worker; beyond that they are encoded again.
REMEMBERED = 400_000
#: Longer pieces than so many bytes aren't remembered.
LONGEST_REMEMBERED = 100
#: At most so many facts about pairs of tokens are held by a worker; then it starts anew.
HELD = 1_000_000

_pieces = regex.compile(PATTERN)
# The same pattern for texts all of whose characters are ASCII, Cyrillic or a few marks, where re's classes agree with the properties.
_fast_pieces = re.compile(r"""'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_fast_text = re.compile(r"[\x00-\x1b\x20-\x7eЀ-ҁҊ-ԯ«»–—“”„•≥≤°×·à-öø-ÿ№… ]*")


class Vocabulary:
    """Ranks of a byte-level BPE and the compatibility of neighbouring tokens."""

    def __init__(self, path: str = VOCABULARY):
        self.path = path
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: b for b, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._joins: dict[tuple[bytes, bytes], bool] = {}
        self._own: dict[bytes, bool] = {}
        self._encoded: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """BPE by its definition: the neighbouring pair of lowest rank is merged until none is left."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 30:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def is_own(self, token: bytes) -> bool:
        """Whether a token is the encoding of its own bytes."""
        known = self._own.get(token)
        if known is None:
            if len(self._own) >= HELD:
                self._own.clear()
            known = self._own[token] = len(self.merge(token)) == 1
        return known

    def joins(self, left: bytes, right: bytes) -> bool:
        """Whether the joined bytes of two tokens encode to these two."""
        known = self._joins.get((left, right))
        if known is None:
            if len(self._joins) >= HELD:
                self._joins.clear()
            known = self._joins[(left, right)] = self.merge(left + right) == [left, right]
        return known

    def encode_piece(self, piece: str) -> bytes:
        """Token ids of one piece as little-endian int32."""
        known = self._encoded.get(piece)
        if known is None:
            data = piece.encode("utf-8", "replace")
            r = self.rank.get(data)
            ids = [r] if r is not None and self.is_own(data) else PrefixTable(self, data).ids()
            known = np.array(ids, "<i4").tobytes()
            if len(self._encoded) < REMEMBERED and len(data) <= LONGEST_REMEMBERED:
                self._encoded[piece] = known
        return known

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as little-endian int32; none for null and empty texts."""
        if not text:
            return b""
        split = _fast_pieces if _fast_text.fullmatch(text) else _pieces
        known, pieces = self._encoded, split.findall(text)
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            return b"".join([self.encode_piece(p) for p in pieces])

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


class PrefixTable:
    """The valid last token of every prefix of one piece's bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token(self, end: int) -> bytes:
        """The valid last token of the prefix of end bytes, all shorter prefixes being known."""
        v, whole, last = self.v, self.data, self.last
        for begin in range(max(0, end - v.longest), end):
            token = whole[begin:end]
            if token in v.rank and v.is_own(token) and (begin == 0 or v.joins(last[begin - 1], token)):
                return token
        raise ValueError("a byte without a token")

    def append(self, data: bytes) -> PrefixTable:
        """Extends the table by the prefixes that end in the new bytes."""
        start, self.data = len(self.data), self.data + data
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._token(end))
        return self

    def edit(self, at: int, removed: int, inserted: bytes) -> PrefixTable:
        """Replaces bytes. The table before the edit is kept, and that after it from where as many
        last tokens as the longest token has bytes agree with the old ones: nothing further back counts.
        """
        old, kept = self.last, at + removed
        self.data, self.last = self.data[:at] + inserted + self.data[kept:], old[:at]
        agreed, start = 0, at + len(inserted)
        for end in range(at + 1, len(self.data) + 1):
            token = self._token(end)
            self.last.append(token)
            if end > start:
                agreed = agreed + 1 if token == old[kept + end - start - 1] else 0
                if agreed >= self.v.longest:
                    self.last += old[kept + end - start :]
                    break
        return self

    def ids(self) -> list[int]:
        """The encoding of the whole piece, read off from the end."""
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(self.v.rank[token])
            end -= len(token)
        return out[::-1]


class TextTable:
    """The pieces of a text with their ids; an edit encodes only the pieces it touches."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v, self.text, self.touched = vocabulary, text, 0
        self.ends, self.pieces = [], []
        for m in _pieces.finditer(text):
            self.ends.append(m.end())
            self.pieces.append(vocabulary.encode_piece(m[0]))

    def edit(self, at: int, removed: int, inserted: str) -> TextTable:
        """Replaces characters. Pieces that end two characters before the edit or earlier stay (the
        pattern looks no further ahead); behind it new pieces are cut until one ends where
        an old one did, from there on the old ones stay.
        """
        first = bisect_left(self.ends, at - 1)
        shift, kept = len(inserted) - removed, at + removed
        self.text = self.text[:at] + inserted + self.text[kept:]
        ends, pieces, last = [], [], len(self.ends)
        for m in _pieces.finditer(self.text, self.ends[first - 1] if first else 0):
            ends.append(m.end())
            pieces.append(self.v.encode_piece(m[0]))
            old = m.end() - shift
            if old >= kept:
                k = bisect_left(self.ends, old)
                if k < len(self.ends) and self.ends[k] == old:
                    last = k + 1
                    break
        self.touched = len(pieces)
        self.ends = self.ends[:first] + ends + [e + shift for e in self.ends[last:]]
        self.pieces = self.pieces[:first] + pieces + self.pieces[last:]
        return self

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.pieces), "<i4").tolist()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _shipped(df: DataFrame, path: str) -> str:
    """Sends the vocabulary's file to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, ids: the token ids of each text, without special tokens; one row per row of df.

    Null and empty texts have an empty list. The text of any length is encoded whole.
    Repeated keys stay; other columns are dropped. Narrow: nothing is shuffled.
    """
    name = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(name))
        for batch in batches:
            parts = [v.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """keep, n_tokens: the number of tokens of each text; 0 for null and empty ones."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"
    name = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(name))
        for batch in batches:
            sizes = pa.array([len(v.encode(t)) // 4 for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), sizes], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)
