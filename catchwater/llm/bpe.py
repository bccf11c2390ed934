"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves pre-tokens that are whole vocabulary entries;
the others are merged with a heap over a linked list of bytes. What a pre-token encodes to
is kept in a bounded memo, since most pre-tokens of a corpus repeat.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import map_rows, per_row, small_batches

MEMO, REMEMBERED = 250_000, 64  # pre-tokens that a worker remembers, then it starts anew; characters of the longest


class PerfectHash:
    """Minimal perfect hash of byte strings to 0..n-1 by hash and displace.

    Buckets are placed largest first; a bucket of one key stores its slot directly. `find` compares
    the key in the slot, so a string outside the set is told apart.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n, self.m = len(keys), max(1, len(keys) // per_bucket)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            buckets.setdefault(h % self.m, []).append((h, key))
        displace = [0] * self.m
        self.keys: list[bytes | None] = [None] * self.n
        free_from = 0
        for b, members in sorted(buckets.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            if len(members) == 1:
                while self.keys[free_from] is not None:
                    free_from += 1
                displace[b], self.keys[free_from] = -free_from - 1, members[0][1]
                continue
            d = 1
            while True:
                slots = [self._slot(h, d) for h, _ in members]
                if len({*slots}) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            displace[b] = d
            for s, (_, key) in zip(slots, members):
                self.keys[s] = key
        self.displace = np.array(displace, np.int32).tolist()

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 29) % self.n

    def find(self, key: bytes) -> int:
        """The slot of key, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return s if self.keys[s] == key else -1


class Tokenizer:
    """ranks: byte string to rank, as in a rank file. No special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.table = PerfectHash(list(ranks))
        self.slot_rank = [ranks.get(k, -1) for k in self.table.keys]
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.bytes_of[r] = k
        self.memo: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> tuple[int, ...]:
        s = self.table.find(data)
        return (self.slot_rank[s],) if s >= 0 else self.merge(data)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merges the lowest rank, leftmost first. A heap entry (rank, start, end) holds while start and end still bound two neighbours."""
        get, n = self.ranks.get, len(data)
        end, prev = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the part that starts at an index; end 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(data[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(get(data[i : end[i]]))
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        memo, out = self.memo, []
        for token in self.split(text or ""):
            if (ids := memo.get(token)) is None:
                ids = self.piece(token.encode("utf-8", "surrogatepass"))
                if len(token) <= REMEMBERED:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[token] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(4)
def load(path: str, pattern: str) -> Tokenizer:
    """Once a worker. path: a rank file (base64 token, rank) that every worker has."""
    with open(path, "rb") as f:
        return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row. Null and empty texts: no ids. Other columns are not read; repeated rows stay repeated."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_row(lambda: lambda i, t: (i, load(path, pattern).encode(t))), f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary) for every row. Null ids: empty bytes. An id outside the vocabulary raises IndexError."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), per_row(lambda: lambda i, x: (i, load(path, pattern).decode(x or ()))), f"`{id_col}` {kind}, data binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the ids themselves): encodes and decodes in one pass, so that ids never cross to the JVM and back. Nulls count as empty."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def each():
        tok = load(path, pattern)
        name = [str(i) for i in range(len(tok.bytes_of))]

        def row(i, text):
            out = tok.encode(text)
            row = i, len(out), hashlib.sha256(" ".join(map(name.__getitem__, out)).encode()).hexdigest(), hashlib.sha256(tok.decode(out)).hexdigest()
            return (*row, out) if ids else row

        return row

    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_row(each), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
