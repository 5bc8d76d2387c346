"""Byte-level BPE over length-bucketed padded matrices.

The distinct pieces of a slice of documents are sorted into buckets by length,
a padded matrix of token ids each. In every round each row merges its leftmost
pair of least rank; the pair's rank comes from an open-addressing hash table,
finished rows leave the matrix and the others close up by one column.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import pieces

NONE = np.int32(2**31 - 1)
#: Widths of the matrices; a piece beyond the last one is merged by a heap, in the same order.
WIDTHS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
CELLS = 1 << 18
SLICE_BYTES = 1 << 20
CACHED_PIECES = 300_000
CACHED_LENGTH = 64


class PairTable:
    """rank of (left, right): linear probing in a table that is at most a quarter full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, n_ids: int):
        self.n_ids = np.uint64(n_ids)
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        keys = left.astype(np.uint64) * self.n_ids + right.astype(np.uint64)
        keys, first = np.unique(keys, return_index=True)
        merged = merged[first].astype(np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.values[at] == NONE
            slots, winner = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[winner]
            self.keys[slots], self.values[slots] = keys[placed], merged[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, merged, at = keys[rest], merged[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they don't merge or hold padding (-1)."""
        out = np.full(left.shape, NONE)
        there = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[there].astype(np.uint64) * self.n_ids + right.ravel()[there].astype(np.uint64)
        at, flat = self._slot(keys), out.ravel()
        while len(there):
            value = self.values[at]
            hit = self.keys[at] == keys
            flat[there[hit]] = value[hit]
            more = ~hit & (value != NONE)
            there, keys, at = there[more], keys[more], (at[more] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {i: token for token, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[a], ranks[b], i) for token, i in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
        self.pairs = PairTable(*np.array(found or np.empty((0, 3)), np.int64).reshape(-1, 3).T, max(self.tokens) + 1)
        self.cache: dict[str, bytes] = {}

    def _matrix(self, ids: np.ndarray) -> list[bytes]:
        """ids: rows of equal width, padded with -1 at the right."""
        out: list[bytes] = [b""] * len(ids)
        rows, rank = np.arange(len(ids)), self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            every = np.arange(len(rows))
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[every, best] if rank.shape[1] else np.full(len(rows), NONE)
            if (done := least == NONE).any():
                ended = ids[done]
                size = (ended >= 0).sum(1)
                flat, ends = ended[ended >= 0].astype("<u4").tobytes(), np.cumsum(size) * 4
                for row, a, b in zip(rows[done].tolist(), (ends - size * 4).tolist(), ends.tolist()):
                    out[row] = flat[a:b]
                live = ~done
                rows, ids, rank, best, least = rows[live], ids[live], rank[live], best[live], least[live]
                every = np.arange(len(rows))
            if not len(rows):
                break
            n, w = ids.shape
            ids[every, best] = least
            keep = np.ones((n, w), bool)
            keep[every, best + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[every, best] = False
            rank = rank[keep].reshape(n, w - 2)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < w - 2))
                at = side[ok]
                rank[ok, at] = self.pairs.rank(ids[ok, at], ids[ok, at + 1])
        return out

    def _long(self, piece: bytes) -> bytes:
        """The same merges by a heap over a linked list: n log n for pieces too long for a matrix."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        gone = bytearray(n)
        get, tokens = self.ranks.get, self.tokens
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = rank, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (r := get(tokens[ids[left]] + tokens[ids[right]])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([x for x, g in zip(ids, gone) if not g], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > WIDTHS[-1]:
                out[k] = self._long(piece)
            elif piece:
                buckets.setdefault(next(w for w in WIDTHS if len(piece) <= w), []).append(k)
        for width, members in buckets.items():
            for a in range(0, len(members), CELLS // width):
                part = members[a : a + CELLS // width]
                lengths = np.array([len(pieces[k]) for k in part])
                inside = np.arange(width) < lengths[:, None]
                ids = np.full((len(part), width), -1, np.int32)
                ids[inside] = self.bytes[np.frombuffer(b"".join(pieces[k] for k in part), np.uint8)]
                for k, x in zip(part, self._matrix(ids)):
                    out[k] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cache, found = self.cache, [self.find(t) for t in texts]
        new = {p for pieces in found for p in pieces if p not in cache}
        extra: dict[str, bytes] = {}
        if new:
            names = list(new)
            done = dict(zip(names, self.encode_pieces([p.encode() for p in names])))
            if len(cache) + len(done) > CACHED_PIECES:
                extra = {p: cache[p] for pieces in found for p in pieces if p in cache}
                cache.clear()
            extra |= done
            cache.update((p, x) for p, x in done.items() if len(p) <= CACHED_LENGTH and len(cache) < CACHED_PIECES)
        if not extra:
            return [b"".join([cache[p] for p in pieces]) for pieces in found]
        return [b"".join([extra[p] if p in extra else cache[p] for p in pieces]) for pieces in found]


def read_vocabulary(path: str) -> bytes:
    """The file of ranks, read on the driver; executors get its bytes (a vocabulary's size bounds them)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def bpe(vocabulary: bytes, pattern: str) -> Bpe:
    return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}, pattern)


@lru_cache(2)
def token_bytes(vocabulary: bytes) -> dict[int, bytes]:
    return {int(b): base64.b64decode(a) for a, b in map(bytes.split, vocabulary.splitlines()) if a}


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, *, text_col: str = "text", as_col: str = "ids") -> DataFrame:
    """Add the token ids of each text, as little-endian unsigned 32-bit integers; a column of that name is replaced.

    Each match of ``pattern`` is encoded by itself and without special tokens. A
    null text is an empty one and has no ids. Rows stay as they are, repeated
    ones and those with nulls too. Texts of any length are encoded whole.
    Memory: a slice of about 1 MB of text or one document, and a cache of
    ``CACHED_PIECES`` short pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    @F.arrow_udf("binary")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = bpe(shared.value, pattern)
        for part in pieces(texts, SLICE_BYTES):
            yield pa.array(coder.encode([t or "" for t in part.to_pylist()]), pa.binary())

    return docs.withColumn(as_col, encode.asNondeterministic()(F.col(f"`{text_col}`")))


def decode_ids(encoded: DataFrame, vocabulary_path: str, *, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids stay null. An id outside the vocabulary fails the job."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    @F.arrow_udf("binary")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = token_bytes(shared.value).__getitem__
        for part in pieces(ids, SLICE_BYTES):
            yield pa.array([None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in part.to_pylist()], pa.binary())

    return encoded.withColumn(as_col, decode.asNondeterministic()(F.col(f"`{ids_col}`")))
