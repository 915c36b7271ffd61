"""Tables of byte- and piece-pair merges, and the plain order of merging one word."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

#: Rank of a pair that never merges.
NEVER = np.int64(1) << 40


class MergeTable:
    """Pairs of symbols, the symbol each makes, and its rank; looked up for whole arrays at once."""

    def __init__(self, left, right, made, rank):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2) ** 62)
        self.made = np.append(np.asarray(made, np.int64)[order], 0)
        self.rank = np.append(np.asarray(rank, np.int64)[order], NEVER)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if the pair does not merge) and made symbol of each pair."""
        keys = (left << 32) | right
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NEVER), np.where(hit, self.made[at], -1)


def merge_one(symbols: list[int], table: MergeTable) -> list[int]:
    """Merge one word in the order the libraries do: the lowest rank first, of equal ranks the leftmost.

    A heap of pairs, n log n for n symbols; for the rare words in which merges cannot be applied together.
    """
    n = len(symbols)
    if n < 2:
        return list(symbols)
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    ranks, made = table.find(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64))
    heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, made, strict=True)) if r < NEVER]
    heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(i: int) -> None:
        j = nxt[i]
        if j >= n:
            return
        pair = (sym[i], sym[j])
        if pair not in known:
            r, m = table.find(np.array([pair[0]], np.int64), np.array([pair[1]], np.int64))
            known[pair] = (int(r[0]), int(m[0]))
        r, m = known[pair]
        if r < NEVER:
            heappush(heap, (r, i, *pair, m))

    while heap:
        _, i, a, b, m = heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j], nxt[i] = m, -1, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        if prv[i] >= 0:
            offer(prv[i])
        offer(i)
    return [s for s in sym if s >= 0]


def every_other(follows: np.ndarray) -> np.ndarray:
    """Of runs of overlapping pairs (`follows`: starts where the one before ends), take the 1st, 3rd, 5th, ..."""
    at = np.arange(len(follows))
    return ((at - np.maximum.accumulate(np.where(follows, 0, at))) & 1) == 0
