"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import map_texts, ranges, table
from setweave.llm.segments import SegmentEncoder

RANKS = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: Bytes of a piece up to which it is a matrix row; longer pieces merge from a heap, in n log n.
MATRIX_BYTES = 256
#: Segments that a task remembers.
CACHED = 300_000


class PairTable:
    """Hash table from a pair of ids to the rank of their concatenation, with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(3 * len(rank) + 1))))
        self.keys, self.rank = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NONE, dtype=np.int32)
        todo, self.probes = np.arange(len(rank)), 0
        pair = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(pair)
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            _, once = np.unique(slot[free], return_index=True)
            put = free[once]
            self.keys[slot[put]], self.rank[slot[put]] = pair[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right.astype(np.int64)
        shape, pair = pair.shape, pair.ravel()
        out, slot = np.full(len(pair), NONE, dtype=np.int32), self._slot(pair)
        todo = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        for _ in range(self.probes):
            if not len(todo):
                break
            there = self.keys[slot[todo]]
            hit = there == pair[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Bpe:
    """A vocabulary of ranks: pieces to ids, ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(rank, dtype=np.int32))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, r in ranks.items():
            tokens[r] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one piece after the other, and how many each has.

        Buckets hold pieces of like length, each bucket as padded matrices.
        """
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        buckets: dict[int, list[int]] = {}
        whole = list(map(self.ranks.get, pieces))
        sizes = np.array(list(map(len, pieces)), dtype=np.int64)
        known = np.array([i for i, w in enumerate(whole) if w is not None], dtype=np.int64)
        got.append((known, np.array([whole[i] for i in known.tolist()], dtype=np.int32), np.ones(len(known), dtype=np.int64)))
        rest = np.setdiff1d(np.arange(len(pieces)), known, assume_unique=True)
        for i in rest[sizes[rest] > MATRIX_BYTES].tolist():
            ids = self._heap(pieces[i])
            got.append((np.array([i]), ids, np.array([len(ids)])))
        rest = rest[sizes[rest] <= MATRIX_BYTES]
        bucket = np.where(sizes[rest] < 16, sizes[rest], 16 << np.ceil(np.log2(np.maximum(sizes[rest], 16) / 16)).astype(np.int64))
        for k in np.unique(bucket).tolist():
            at = rest[bucket == k]
            step = max(1, (1 << 19) // k)
            for c in range(0, len(at), step):
                part = at[c : c + step]
                got += self._matrix([pieces[i] for i in part.tolist()], part, sizes[part])
        count = np.zeros(len(pieces), dtype=np.int64)
        for at, _, n in got:
            count[at] = n
        start, flat = np.cumsum(count) - count, np.zeros(int(count.sum()), dtype=np.int32)
        for at, ids, n in got:
            flat[ranges(start[at], n)] = ids
        return flat, count

    def _matrix(self, pieces: list[bytes], at: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In each round every row merges its leftmost pair of least rank; rows without one leave."""
        width, left = int(sizes.max()), []
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(ids):
            best = ranks.argmin(axis=1)
            rows = np.arange(len(ids))
            least = ranks[rows, best]
            done = least == NONE
            if done.any():
                out, n = ids[done], sizes[done]
                left.append((at[done], out[np.arange(out.shape[1]) < n[:, None]], n))
                live = ~done
                ids, ranks, at, sizes, best, least = ids[live], ranks[live], at[live], sizes[live], best[live], least[live]
                if not len(ids):
                    break
                width = int(sizes.max())
                ids, ranks, rows = ids[:, :width], ranks[:, : width - 1], np.arange(len(ids))
            ids[rows, best] = least
            take = np.arange(ids.shape[1] - 1)[None, :]
            take = take + (take > best[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            sizes = sizes - 1
            if ids.shape[1] < 2:
                ranks = np.full((len(ids), 1), NONE, dtype=np.int32)
                continue
            take = np.arange(ranks.shape[1] - 1)[None, :]
            ranks = np.take_along_axis(ranks, take + (take >= best[:, None]), axis=1)
            padded = np.concatenate([ids, np.full((len(ids), 1), -1, dtype=np.int32)], axis=1)
            inside = best < ranks.shape[1]
            r, c = rows[inside], best[inside]
            ranks[r, c] = self.pairs(padded[r, c], padded[r, c + 1])
            r, c = rows[best > 0], best[best > 0] - 1
            ranks[r, c] = self.pairs(padded[r, c], padded[r, c + 1])
        return left

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for a piece of any length: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [*first.tolist(), int(NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def look(i: int) -> None:
            j = after[i]
            if j >= n:
                rank[i] = int(NONE)
                return
            key = (ids[i], ids[j])
            if key not in known:
                known[key] = int(self.pairs(np.array([key[0]]), np.array([key[1]]))[0])
            rank[i] = known[key]
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids, and how many each id has."""
        sizes = self.length[ids]
        return self.bytes[ranges(self.start[ids], sizes)], sizes


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Encoder:
    """Texts to ids by a pattern and a vocabulary; new segments go to the matrices together."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.split = load(path), regex.compile(pattern).findall
        # What segments rest on is known of this pattern only; by others each text is one segment.
        self.cached = pattern == public_tokenizers.PATTERN
        self.segments = SegmentEncoder(self._many, CACHED)

    def _many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        parts = []
        for s in segments:
            found = [s] if self.cached and s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else self.split(s)
            parts.append([number.setdefault(p.encode("utf-8", "surrogatepass"), len(number)) for p in found])
        flat, sizes = self.bpe.pieces(list(number))
        start = np.cumsum(sizes) - sizes
        at = np.array([p for x in parts for p in x], dtype=np.int64)
        many = np.array([len(x) for x in parts], dtype=np.int64)
        ids = flat[ranges(start[at], sizes[at])]
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], np.cumsum(many)])]
        return ids, np.diff(ends)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.segments.encode(texts) if self.cached else self._many(texts)


def encode(
    df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` of each row: token ids and the bytes they decode to.

    ``ids`` is binary, little-endian unsigned 32-bit; ``decoded`` is binary. Each match of ``pattern`` is
    encoded by itself; special strings are ordinary text. One row for each input row: a null or empty
    text gives no ids, a null id stays, repeated rows give repeated results; an empty table
    gives no rows. A piece of any length is encoded in full. No shuffle.
    """
    path = path or public_tokenizers.path(RANKS)

    def kernel():
        encoder = Encoder(path, pattern)

        def work(texts: list[str]) -> dict:
            ids, counts = encoder(texts)
            raw, sizes = encoder.bpe.decode(ids)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            spans = np.concatenate([[0], np.cumsum(sizes)])[cuts]
            packed, raw = ids.astype("<u4").tobytes(), raw.tobytes()
            return {
                "ids": [packed[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                "decoded": [raw[a:b] for a, b in zip(spans[:-1], spans[1:], strict=True)],
            }

        return work

    return map_texts(df, kernel, "ids binary, decoded binary", [id_col], text_col)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
