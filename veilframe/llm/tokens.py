"""Byte-level BPE with a public vocabulary.

A pre-token is merged by a priority queue of merge ranks over a doubly linked list of
symbols; entries whose pair has changed since they were queued are skipped. Decoding
concatenates the vocabulary's byte strings.

Whatever lies between a visible character and the blank after it, a clock time and its
fraction, ends a pre-token, so texts are cut there first and each piece, with the blanks
before it, is encoded once and remembered (a bounded memory). The cut changes nothing:
texts with other kinds of white space, where it could, are encoded in one piece.

Null and empty texts have the empty list. Text that spells a special token is ordinary text.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20  # of what is sent to the executors
REMEMBERED = 150_000  # pieces kept by a worker before it starts anew

_PIECE = re.compile(r"[ \n\r\t]*\d\d:\d\d:\d\d(?=[,.]\d{3}[ \n\r\t])|[,.]\d{3}(?=[ \n\r\t])|[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_vocabulary(path: str | None = None) -> bytes:
    with open(path or vocabulary_path(), "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to be sent to every executor")
    return data


def pattern() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except (ImportError, AttributeError):
        return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    def __init__(self, data: bytes):
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
        self.words = regex.compile(pattern())
        self.seen_words: dict[str, tuple] = {}
        self.seen: dict[str, tuple] = {}

    def merge(self, word: bytes) -> tuple:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return (whole,)
        n = len(word)
        symbol: list = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if (r := ranks.get(symbol[i] + symbol[i + 1])) is not None:
                queue.append((r, i, symbol[i], symbol[i + 1]))
        heapify(queue)
        while queue:
            _, i, left, right = heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbol[i] + symbol[k])) is not None:
                    heappush(queue, (r, i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(symbol[h] + symbol[i])) is not None:
                heappush(queue, (r, h, symbol[h], symbol[i]))
        return tuple(ranks[s] for s in symbol if s is not None)

    def _words(self, text: str) -> tuple:
        out: list = []
        seen = self.seen_words
        for word in self.words.findall(text):
            ids = seen.get(word)
            if ids is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                ids = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    seen[word] = ids
            out += ids
        return tuple(out)

    def _piece(self, piece: str) -> tuple:
        ids = self._words(piece)
        if len(piece) <= 64:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[piece] = ids
        return ids

    def pieces(self, text: str) -> list[tuple]:
        """Ids in runs, one after the other."""
        if _OTHER_SPACE.search(text):
            return [self._words(text)]
        get, make = self.seen.get, self._piece
        return [get(p) or make(p) for p in _PIECE.findall(text)]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0

    def decode(self, ids) -> bytes:
        names = {i: b for b, i in self.ranks.items()}
        return b"".join(names[i] for i in ids)


_made: dict[int, Bpe] = {}


def shared(data: bytes) -> Bpe:
    """One encoder a worker process, kept across its tasks."""
    key = hash(data)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(data)
    return _made[key]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids: row-local, no shuffle."""
    sent = _spark(df).sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        bpe = shared(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, ends = [], [0]
                for value in part.column(1).to_pylist():
                    if value:
                        for ids in bpe.pieces(value):
                            flat += ids
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def lengths(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens (0 for null and empty)."""
    sent = _spark(df).sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        bpe = shared(sent.value)
        for batch in batches:
            counts = [bpe.count(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens bigint")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text; bytes that are not UTF-8 become replacement characters, null ids null text."""
    sent = _spark(df).sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        names = {i: b for b, i in shared(sent.value).ranks.items()}
        for batch in batches:
            texts = [None if row is None else b"".join(names[i] for i in row).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession
