"""Merge kernels: from initial symbols to token ids, by a table of ranked pairs.

Of all adjacent pairs the one of the least rank is merged, of equals the leftmost,
until no pair has a rank. Many short words are merged side by side, a pair of
each word at a time; a long word goes through a heap.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LONG = 48
NONE = np.int64(1 << 62)


def ends_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... as many as lengths[i], for each i in turn."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


@dataclass(frozen=True)
class PairTable:
    """Sorted keys (left << 32 | right), with the rank and the merged id of each."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    @staticmethod
    def of(pairs: dict[tuple[int, int], tuple[int, int]]) -> PairTable:
        """pairs: (left, right) to (rank, merged)."""
        rows = sorted(((a << 32) | b, r, m) for (a, b), (r, m) in pairs.items())
        table = np.array(rows, np.int64).reshape(-1, 3)
        return PairTable(*(np.ascontiguousarray(c) for c in table.T))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row of each pair, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def below(self, rank: int) -> PairTable:
        ok = self.ranks < rank
        return PairTable(self.keys[ok], self.ranks[ok], self.merged[ok])


def merge_heap(symbols: list[int], table: PairTable, lookup: dict[int, tuple[int, int]]) -> list[int]:
    """One word, n log n."""
    n = len(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    live = symbols.copy()
    heap = []
    for i in range(n - 1):
        found = lookup.get((live[i] << 32) | live[i + 1])
        if found:
            heap.append((found[0], i, live[i], live[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = nxt[i]
        if live[i] != a or j >= n or live[j] != b:
            continue
        live[i], live[j] = m, -1
        k = nxt[j]
        nxt[i] = k
        if k < n:
            prv[k] = i
            found = lookup.get((m << 32) | live[k])
            if found:
                heapq.heappush(heap, (found[0], i, m, live[k], found[1]))
        h = prv[i]
        if h >= 0:
            found = lookup.get((live[h] << 32) | m)
            if found:
                heapq.heappush(heap, (found[0], h, live[h], m, found[1]))
    return [s for s in live if s >= 0]


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: PairTable, lookup: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All words: their ids one after the other, and the number of ids of each."""
    lengths = np.asarray(lengths, np.int64)
    ends = ends_of(lengths)
    out: list[np.ndarray | None] = [None] * len(lengths)
    for w in np.flatnonzero(lengths > LONG).tolist():
        out[w] = np.array(merge_heap(symbols[ends[w] : ends[w + 1]].tolist(), table, lookup), np.int32)
    short = np.flatnonzero(lengths <= LONG)
    size = lengths[short]
    sym = symbols[spread(ends[short], size)].astype(np.int64)
    done_sym, done_at, at = [], [], short
    while len(at):
        stop = ends_of(size)
        row = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            row[:-1] = table.find(sym[:-1], sym[1:])
        row[stop[1:][size > 0] - 1] = -1
        rank = np.where(row >= 0, table.ranks[row] if len(table.ranks) else NONE, NONE)
        best = np.full(len(at), NONE)
        some = size > 0
        if some.any():
            best[some] = np.minimum.reduceat(rank, stop[:-1][some])
        open_ = best < NONE
        closed = ~open_
        if closed.any():
            done_at.append(at[closed])
            done_sym.append((sym[spread(stop[:-1][closed], size[closed])], size[closed]))
        if not open_.any():
            break
        # the leftmost place of each open word's best pair
        owner = np.repeat(np.arange(len(at)), size)
        hit = np.flatnonzero((rank == best[owner]) & open_[owner])
        first = np.ones(len(hit), bool)
        first[1:] = owner[hit[1:]] != owner[hit[:-1]]
        place = hit[first]
        sym[place] = table.merged[row[place]]
        keep = open_[owner]
        keep[place + 1] = False
        sym, at, size = sym[keep], at[open_], size[open_] - 1
    counts = np.zeros(len(lengths), np.int64)
    for a, (_, z) in zip(done_at, done_sym):
        counts[a] = z
    for w, x in enumerate(out):
        if x is not None:
            counts[w] = len(x)
    begin = ends_of(counts)
    flat = np.zeros(int(begin[-1]), np.int32)
    for a, (s, z) in zip(done_at, done_sym):
        flat[spread(begin[a], z)] = s
    for w, x in enumerate(out):
        if x is not None:
            flat[begin[w] : begin[w + 1]] = x
    return flat, counts
