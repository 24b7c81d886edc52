"""Cached tokenization of the pieces between single spaces, for byte-level BPE with a GPT-2 style pattern.

A space that is followed by a non-space always starts a new pattern match: the run of white space
before it may not take it (its lookahead fails), and no other alternative spans a space. So a text
splits there into segments whose ids, put one after the other, are the ids of the text. Likewise marks after
a letter or digit, up to the next space, are a match of their own: such a segment is a known one and a tail.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from setweave.llm.common import ranges

#: Segments that a worker keeps; beyond that it forgets all and starts anew (memory, never results).
CACHED = 1_300_000
_ODD = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")
TAIL = ".,;:?"


class _Index(dict):
    """Numbers keys in the order they are first met, by one count for several indexes, and remembers the new ones."""

    def __init__(self, new: list, known: list[int]):
        self.new, self.known = new, known

    def __missing__(self, key: str) -> int:
        self[key] = at = self.known[0] + len(self.new)
        self.new.append((self, key))
        return at


class SegmentEncoder:
    """``encode_many(list of strings) -> (flat ids, count for each)`` is asked for new segments only."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cached: int = CACHED):
        self.encode_many, self.cached = encode_many, cached
        self._forget()

    def _forget(self) -> None:
        self.new, self.known = [], [0]
        self.first, self.rest = _Index(self.new, self.known), _Index(self.new, self.known)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.count = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)

    @property
    def n(self) -> int:
        return self.known[0]

    def _learn(self) -> None:
        """Encodes the new segments."""
        new, rest, base = self.new, self.rest, self.known[0]
        if not new:
            return
        whole, segments, parted, cores, tails = [], [], [], [], []
        for at, (own, key) in enumerate(new):  # cores and tails that are new too are added meanwhile
            if own is rest:
                if key[-1] in TAIL and (core := key.rstrip(TAIL))[-1:].isalnum():
                    parted.append(at)
                    cores.append(rest[core])
                    tails.append(self.first[key[len(core) :]])
                    continue
                key = " " + key
            whole.append(at)
            segments.append(key)
        while base + len(new) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        ids, counts = self.encode_many(segments)
        self._put(base + np.array(whole, dtype=np.int64), ids, counts)
        if parted:
            both = np.stack([cores, tails], axis=1).ravel()
            counts = self.count[both].astype(np.int64)
            self._put(base + np.array(parted), self.flat[ranges(self.start[both], counts)], counts.reshape(-1, 2).sum(axis=1))
        self.known[0] += len(new)
        new.clear()

    def _put(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at], self.count[at] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if self.n > self.cached:
            self._forget()
        found, sizes = [], np.zeros(len(texts), dtype=np.int64)
        first, rest = self.first.__getitem__, self.rest.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
            found.append([first(parts[0])])
            found.append(list(map(rest, parts[1:])))
            sizes[i] = len(parts)
        self._learn()
        at = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))
        counts = self.count[at].astype(np.int64)
        ids = self.flat[ranges(self.start[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(ends)
