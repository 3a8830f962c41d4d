"""Byte-pair encoding of a corpus with a public vocabulary, and its inverse.

A vocabulary is a file of ``base64(token) rank`` lines; a token's id is its
rank, so a lower id was merged earlier. Text is split by a pattern; each piece
is encoded by backtracking in linear time:

* Aho-Corasick gives, in one pass, the longest token that starts at each byte;
* a token is accepted after its predecessor only if the pair is compatible:
  no merge across their border would have come before the merges inside them.
  This is decided by undoing the later of the two tokens step by step;
* where the longest token is refused its longest token prefix is tried, and
  where none is left the previous token is taken back and its end position is
  closed for good.

The result equals applying all merges in order of rank. Decoding gathers bytes
from one blob by an offset table, a whole batch at a time.

Null and empty texts have the empty list of ids. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default place of the vocabulary; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits a text before merging (fixed value of this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the pattern means in a text of ASCII alone, for the faster engine of the standard library.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Pieces and pairs remembered by each Python worker; when full, the memory starts anew.
REMEMBERED = 400_000


class _Pieces(dict):
    """Pieces and their ids as packed integers; a new piece is encoded when it is looked up, long ones are not kept."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.encode(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


class Vocabulary:
    """Tokens, their merges and the tables that encoding and decoding need."""

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        ranked = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in lines.splitlines() if line.strip()))
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks must run from 0 without gaps")
        self.tokens = [t for _, t in ranked]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.offsets = np.zeros(len(self.tokens) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.lengths = [len(t) for t in self.tokens]
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else self.split
        self.sizes = np.diff(self.offsets)
        self._pieces = _Pieces(self.encode_bytes)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._automaton()
        self._merges()

    def _automaton(self) -> None:
        auto = ahocorasick.Automaton()
        self.prefix = []
        for i, t in enumerate(self.tokens):
            auto.add_word(t.decode("latin-1"), (i, len(t)))
            self.prefix.append(next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1))
        auto.make_automaton()
        self.matches = auto.iter

    def _merges(self) -> None:
        """The last merge of every token: the split into two earlier tokens that stand side by side until then."""
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            a = self.prefix[i]
            while a >= 0:
                b = self.ids.get(t[self.lengths[a] :], i)
                if a < i and b < i and self._undo(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break
                a = self.prefix[a]

    def _undo(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is what the merges leave."""
        merged, left, right = self.merged, self.left, self.right
        bound = len(self.tokens)
        while True:
            if merged.get((a, b), bound) < bound:
                return False
            later_left = a > b
            for turn in (later_left, not later_left):
                if turn and right[a] != a:
                    bound, a = a, right[a]
                    break
                if not turn and left[b] != b:
                    bound, b = b + 1, left[b]
                    break
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[a, b] = self._undo(a, b)
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        for end, (i, length) in self.matches(data.decode("latin-1")):
            longest[end - length + 1] = i  # ends ascend: the last is the longest
        closed = bytearray(n + 1)
        prefix, lengths, compatible = self.prefix, self.lengths, self.compatible
        out: list[int] = []
        at = 0
        token = longest[0] if n else -1
        while at < n:
            end = at + lengths[token]
            if not closed[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = prefix[token]
            while token < 0:
                closed[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = prefix[token]
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, (self.split_ascii if text.isascii() else self.split)(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def prompt_size(self, text: str, ids: np.ndarray) -> int:
        """How many tokens begin in the first line of a text of several lines."""
        line = text.find("\n") + 1
        if not line:
            return 0
        ends = np.cumsum(self.sizes[ids])
        return int(np.searchsorted(ends - self.sizes[ids], len(text[:line].encode("utf-8", "replace")), "left"))

    def decode_rows(self, ids: np.ndarray, row_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows together, and where each row ends in them."""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[take], np.concatenate([[0], ends])[row_ends]


@functools.lru_cache(maxsize=4)
def _built(digest: str, pattern: str, lines: bytes) -> Vocabulary:
    return Vocabulary(lines, pattern)


def _worker(lines: bytes, pattern: str) -> Vocabulary:
    """One vocabulary per Python worker."""
    return _built(hashlib.sha256(lines).hexdigest(), pattern, lines)


def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    with open(path, "rb") as f:
        return _worker(f.read(), pattern)


def texts(a: pa.Array) -> Iterable[str | None]:
    """Python strings; bytes that are no UTF-8 read as U+FFFD."""
    try:
        return a.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in a.cast(pa.binary()).to_pylist()]


def lists(rows: list[bytes]) -> pa.Array:
    """Packed rows as one array of lists."""
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def _shared(spark: SparkSession, path: str):
    """The vocabulary file (about 1 MB whatever the corpus), read by the driver and broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, path: str = VOCABULARY, pattern: str = PATTERN):
    """A column function: text -> array<int>."""
    lines = _shared(spark, path)

    @F.arrow_udf("array<int>")
    def ids(a: pa.Array) -> pa.Array:
        v = _worker(lines.value, pattern)
        return lists([v.encode_packed(t) if t else b"" for t in texts(a)])

    return ids


def decoder(spark: SparkSession, path: str = VOCABULARY):
    """A column function: array<int> -> text; null stays null, an id outside the vocabulary is an error."""
    lines = _shared(spark, path)

    @F.arrow_udf("string")
    def text(a: pa.Array) -> pa.Array:
        v = _worker(lines.value, PATTERN)
        sizes = np.array([0 if r is None else len(r) for r in a.to_pylist()], dtype=np.int64) if a.null_count else np.diff(a.offsets.to_numpy())
        flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(v.tokens)):
            raise ValueError("an id lies outside the vocabulary")
        data, ends = v.decode_rows(flat, np.cumsum(sizes))
        whole = data.tobytes()
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        null = a.is_null().to_numpy(zero_copy_only=False)
        return pa.array([None if gone else whole[s:e].decode("utf-8", "replace") for s, e, gone in zip(begins, ends, null)], pa.string())

    return text


def sizes(spark: SparkSession, path: str = VOCABULARY, pattern: str = PATTERN):
    """A column function: text -> struct<n_tokens, n_prompt>.

    ``n_prompt`` counts the tokens that begin in the first line of a text of
    several lines (the instruction); all others bear loss.
    """
    lines = _shared(spark, path)

    @F.arrow_udf("struct<n_tokens:bigint,n_prompt:bigint>")
    def count(a: pa.Array) -> pa.Array:
        v = _worker(lines.value, pattern)
        total, prompt = [], []
        for t in texts(a):
            ids = np.frombuffer(v.encode_packed(t) if t else b"", dtype=np.int32)
            total.append(len(ids))
            prompt.append(v.prompt_size(t, ids) if t else 0)
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(prompt, pa.int64())], ["n_tokens", "n_prompt"])

    return count


def spread(df: DataFrame) -> DataFrame:
    """Rows in turn over all cores where a small input has fewer splits than there are cores; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def encode_corpus(df: DataFrame, text: str | Column, name: str = "ids", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the ids of its texts in a column that replaces any of the same name."""
    return df.withColumn(name, encoder(df.sparkSession, path, pattern)(F.col(f"`{text}`") if isinstance(text, str) else text))
