"""Byte-level BPE of a whole corpus with a public vocabulary, over a hierarchical-bitmap rank queue.

Each pre-token is merged by always taking the lowest-ranked pair, the leftmost of equal ones. The
queue that finds it has one bucket of positions per merge rank and a three-level bitmap over the
ranks: find-first-set in three words gives the lowest rank with positions. Pairs made obsolete by
a merge stay in their buckets and are skipped when they come up (their position's current rank
no longer agrees). A pre-token of n bytes thus costs O(n log n) even where it is one run of a
hundred thousand signs, where rescanning for the best pair would cost O(n^2).

Pre-tokens repeat, so each task keeps a table of those it has merged, emptied when it exceeds
``CACHE`` entries. A text that is NULL or empty gives an empty list. The strings of special
tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the split pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000
#: Texts of a batch are encoded in groups of about this many characters, so that one batch of very
#: long texts doesn't build one huge array.
GROUP_CHARS = 4_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Positions by rank; pop gives the lowest rank's leftmost position."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}  # word of 64 ranks -> bits
        self.mid: dict[int, int] = {}  # word of 64 low words -> bits
        self.top = 0  # bits of mid words

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[block] = self.mid.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        bits = self.mid[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[block] &= ~(1 << (word & 63))
                if not self.mid[block]:
                    self.top &= ~(1 << block)
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next part
    before = list(range(-1, n - 1))
    current: list[int | None] = [None] * n  # rank of the pair that begins here
    queue = RankQueue()

    def offer(i: int) -> None:
        j = after[i]
        rank = ranks.get(piece[i : after[j]]) if j < n else None
        current[i] = rank
        if rank is not None:
            queue.push(rank, i)

    for i in range(n - 1):
        offer(i)
    while (found := queue.pop()) is not None:
        rank, i = found
        if current[i] != rank:
            continue  # stale
        j = after[i]
        k = after[j]
        after[i] = k
        current[j] = None
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts; one per worker process and vocabulary."""

    def __init__(self, data: bytes):
        import regex

        self.ranks = read_ranks(data)
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.pieces(text or ""):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = merge(piece.encode("utf-8"), self.ranks)
                if len(piece) < 100:
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Broadcast) -> Encoder:
    key = hash(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> Broadcast:
    """The rank file, read on the driver and sent to the workers once (below 1 MB)."""
    with open(os.path.join(folder, name), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, id_col: str, text_col: str, vocab: Broadcast) -> DataFrame:
    """(id, ids): the token ids of every text, NULL and empty ones as empty lists."""
    picked = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                lists = [enc.encode(t) for t in texts[lo:hi]]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids], names=[id_col, "ids"])

    schema = T.StructType([picked.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return picked.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text_col: str, vocab: Broadcast) -> DataFrame:
    """df without the text, with n_tokens (long) in its place; NULL and empty texts count 0."""
    others = [c for c in df.columns if c != text_col]
    picked = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(len(others)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(others))] + [n], names=[*others, "n_tokens"])

    return picked.mapInArrow(run, T.StructType(picked.schema.fields[:-1] + [T.StructField("n_tokens", T.LongType())]))
