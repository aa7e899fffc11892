"""Byte-level BPE ids of a whole corpus.

Two tiers. A minimal perfect hash over the vocabulary resolves a whole
pre-token in one probe; a pre-token that is no entry is merged bottom-up with
a heap of adjacent pairs over a doubly linked list of its bytes, each pair's
rank coming from the same hash. The vocabulary (a file of fixed size, its path
a parameter) is read on the driver and broadcast; documents never shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES = 200_000
MEMO_CHARS = 64


class PerfectHash:
    """Minimal perfect hash (hash and displace) from byte strings to ranks.

    Keys fall into buckets by one part of a 64-bit hash; each bucket, largest
    first, takes the first displacement that sends its keys to free slots. A
    probe compares the stored key, so unknown strings give -1.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = len(ranks)
        self.n, self.r = n, max(1, n // 3)
        keys = list(ranks)
        buckets: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.r)]
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            buckets[h % self.r].append((h >> 20, 1 + (h >> 41), k))
        self.keys: list[bytes | None] = [None] * n
        self.ranks = [0] * n
        self.move = [0] * self.r
        order = sorted(range(self.r), key=lambda x: -len(buckets[x]))
        for b in order:
            if len(buckets[b]) < 2:
                break
            d = 0
            while True:
                at = {(f + d * g + (d * d >> 3)) % n for f, g, _ in buckets[b]}
                if len(at) == len(buckets[b]) and all(self.keys[i] is None for i in at):
                    break
                d += 1
            self.move[b] = d
            for f, g, k in buckets[b]:
                i = (f + d * g + (d * d >> 3)) % n
                self.keys[i], self.ranks[i] = k, ranks[k]
        # a bucket of one key names its slot directly, as a negative displacement
        free = iter([i for i in range(n) if self.keys[i] is None])
        for b in order:
            if len(buckets[b]) == 1:
                i = next(free)
                self.move[b] = -1 - i
                self.keys[i], self.ranks[i] = buckets[b][0][2], ranks[buckets[b][0][2]]

    def get(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.move[h % self.r]
        i = -1 - d if d < 0 else ((h >> 20) + d * (1 + (h >> 41)) + (d * d >> 3)) % self.n
        return self.ranks[i] if self.keys[i] == key else -1


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte string -> id from a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, rank) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost on a tie."""
    n = len(piece)
    if n == 1:
        return [rank(piece)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = bytearray(b"\x01") * n
    heap = []
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r >= 0:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        alive[j] = 0
        end[i] = e
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank(piece[i : end[k]])
            if r >= 0:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0:
            r = rank(piece[h:e])
            if r >= 0:
                heapq.heappush(heap, (r, h, e))
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : end[i]]))
        i = after[i]
    return out


class Memo(dict):
    """Pre-token -> ids; asks the two tiers once per distinct pre-token.

    A task keeps at most ``MEMO_ENTRIES`` short pre-tokens and starts anew
    beyond that; long ones are not kept.
    """

    def __init__(self, table: PerfectHash):
        super().__init__()
        self.table = table

    def __missing__(self, token: str) -> tuple[int, ...]:
        raw = token.encode()
        whole = self.table.get(raw)
        ids = (whole,) if whole >= 0 else tuple(merge(raw, self.table.get))
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = ids
        return ids


def encode(text: str, memo: Memo, split) -> list[int]:
    out: list[int] = []
    extend = out.extend
    for token in split(text):
        extend(memo[token])
    return out


def encode_corpus(documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep: int = 4096) -> DataFrame:
    """(doc_id, ids) of every row; ids is an array of integers.

    Null and empty texts give an empty list. Strings that look like special
    tokens are ordinary text. Repeated rows are encoded each. Texts of any
    length are encoded whole. Other columns are not read.
    """
    table = documents.sparkSession.sparkContext.broadcast(PerfectHash(load_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(table.value)
        split = regex.compile(PATTERN).findall
        for batch in batches:
            for lo in range(0, batch.num_rows, keep):
                part = batch.slice(lo, keep)
                flat: list[np.ndarray] = []
                ends = [0]
                for text in part.column(1).to_pylist():
                    ids = encode(text, memo, split) if text else []
                    flat.append(np.array(ids, dtype=np.int32))
                    ends.append(ends[-1] + len(ids))
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
