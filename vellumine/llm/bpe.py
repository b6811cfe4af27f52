"""Encoding by a public byte-level BPE vocabulary.

A pre-token's symbols form a linked list of positions. Each adjacent pair whose joined bytes are in the vocabulary
waits in the bucket of its merge rank; a hierarchical bitmap over the ranks gives the lowest rank that waits by
find-first-set, level by level, so a step costs the same however long the pre-token is. Entries whose symbols have
changed since are stale and skipped. Encoded pre-tokens are remembered per worker, up to a bound.

Null and empty texts give an empty list. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern of the public vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = 60  # bits of a bitmap word
MEMO = 300_000  # remembered pre-tokens of a worker
MEMO_CHARS = 64  # longer pre-tokens are not remembered


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The rank file; path: a parameter, else the place of the installed package of public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class RankQueue:
    """Positions by merge rank, lowest rank first, leftmost position first within a rank."""

    def __init__(self, size: int) -> None:
        self.buckets: dict[int, list[tuple[int, int]]] = {}
        self.levels = []
        while True:
            size = -(-size // WORD)
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int, at: int, end: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [(at, end)]
            for level in self.levels:
                rank, bit = divmod(rank, WORD)
                was = level[rank]
                level[rank] = was | 1 << bit
                if was:
                    break
        else:
            heappush(bucket, (at, end))

    def pop(self) -> tuple[int, int, int] | None:
        """(rank, position, end of the pair) or None."""
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at * WORD + (word & -word).bit_length() - 1
        bucket = self.buckets[at]
        left, end = heappop(bucket)
        if not bucket:
            del self.buckets[at]
            i = at
            for level in self.levels:
                i, bit = divmod(i, WORD)
                level[i] &= ~(1 << bit)
                if level[i]:
                    break
        return at, left, end


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.queue = RankQueue(self.size)

    def merge(self, token: bytes) -> list[int]:
        ranks, n = self.ranks, len(token)
        if (whole := ranks.get(token)) is not None:
            return [whole]
        after = list(range(1, n + 1))  # end of the symbol that starts at a position; -1: no symbol starts there
        before = list(range(-1, n))  # start of the symbol before the one that starts at a position
        queue = self.queue  # empty again after each call
        for i in range(n - 1):
            if (r := ranks.get(token[i : i + 2])) is not None:
                queue.add(r, i, i + 2)
        while (top := queue.pop()) is not None:
            _, i, end = top
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:  # stale: a symbol of the pair has been merged since
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(token[i : after[end]])) is not None:
                    queue.add(r, i, after[end])
            if i and (r := ranks.get(token[before[i] : end])) is not None:
                queue.add(r, before[i], end)
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo, extend = self.memo, out.extend
        for word in self.split(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = ids
            extend(ids)
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder of a vocabulary."""
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks_of(raw))
    return _ENCODERS[key]


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids: one row for each row of df. The vocabulary file (fixed size, under 1 MB) is sent to the executors."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    rows = df.select(df[key].alias("k"), df[text].alias("t"))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and tokens: the number of ids of each row, without moving the ids out of the workers."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            n = [len(enc.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["k", "tokens"])

    rows = df.select(df[key].alias("k"), df[text].alias("t"))
    return rows.mapInArrow(run, f"k {kind}, tokens bigint").withColumnRenamed("k", key)


def decode(raw: bytes, ids: list[int]) -> str:
    back = {v: k for k, v in ranks_of(raw).items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")


def session_encoder(spark: SparkSession) -> Encoder:
    return encoder(vocabulary_bytes())
