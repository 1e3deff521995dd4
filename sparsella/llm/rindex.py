"""A run-length (r-)index of some short texts: their Burrows-Wheeler transform in runs, text positions and
longest common prefixes sampled at both ends of each run, and the matching statistics that follow from
these samples (after Gagie, Navarro and Prezza, 2020, and Karkkainen, Manzini and Puglisi, 2009).

Suffixes are sorted by prefix doubling. The texts end in separators that differ from each other and are
less than any byte, so no match goes beyond a text. At a place that is not at the end of a run, the
longest match with a neighbour in suffix order is one shorter than at the place before it: the samples
at run ends are all that the statistics need, and in a repetitive collection runs are few.
"""

from __future__ import annotations

import numpy as np

#: Bytes in the first sort key: seven, and how many of them stand within the text.
FIRST = 7


class RunIndex:
    """texts: bytes of each. Positions are places in the texts put together, without separators."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        self.ends = self.starts[1:][self.of].astype(np.int32)
        self._sort()
        self._runs()

    def _sort(self) -> None:
        """Suffix order, and of each doubling the place in it where a position's class of equal prefixes begins."""
        n, texts = len(self.data), len(self.starts)
        left = np.minimum(self.ends - np.arange(n, dtype=np.int32), FIRST)
        key = np.concatenate((self.data, np.zeros(8, np.uint8))).astype(np.uint64)
        for h in (1, 2, 4):
            key = key[:-h] << np.uint64(8 * h) | key[h:]
        within = np.array([(1 << 64) - (1 << 64 - 8 * i) for i in range(FIRST + 1)], np.uint64)
        key = key[:n] & within[left] | left.astype(np.uint64)
        at = np.argsort(key).astype(np.int32)
        self.order = at.copy()
        rank, active, base, self.ranks, h = np.empty(n, np.int32), np.arange(n, dtype=np.int32), None, [], FIRST
        key = key[at]
        while len(at):
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begin, len(at)))
            base = np.repeat(active[begin], size)
            rank = rank.copy()
            rank[at] = base
            self.ranks.append((h, rank))
            again = np.repeat(size > 1, size)
            at, active, base = at[again], active[again], base[again]
            on = at + np.int32(h)
            second = rank[np.minimum(on, n - 1)].astype(np.int64) + texts
            out = np.flatnonzero(on >= self.ends[at])
            second[out] = self.of[at[out]]
            key = base.astype(np.int64) * (n + texts + 1) + second
            by = np.argsort(key)
            at, key = at[by], key[by]
            self.order[active] = at
            h *= 2

    def _runs(self) -> None:
        """The transform's runs: their symbols, where they begin, and the positions sampled at their first and last places."""
        before = np.maximum(self.order - 1, 0)
        self.symbols = np.where(self.order > self.starts[:-1][self.of[self.order]] if len(self.order) else np.empty(0, bool), self.data[before].astype(np.int64), 256 + self.of[self.order])
        self.heads = np.flatnonzero(np.concatenate(([True], self.symbols[1:] != self.symbols[:-1]))) if len(self.order) else np.empty(0, np.int64)
        self.tails = np.append(self.heads[1:], len(self.order))[: len(self.heads)] - 1

    def _starts_alike(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffixes at a and b share their first bytes: by two overlapping prefixes of a doubling."""
        h, rank = next(((h, r) for h, r in self.ranks[::-1] if h <= length), (0, None))
        same = (a + length <= self.ends[a]) & (b + length <= self.ends[b])
        for on in range(0, length, h) if h else ():
            on, same = min(on, length - h), same.copy()
            left = np.flatnonzero(same)
            same[left] = rank[a[left] + on] == rank[b[left] + on]
        return same

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at a and b, exactly: by the ranks of the doublings, longest first, then byte by byte."""
        total, most = np.zeros(len(a), np.int32), np.minimum(self.ends[a] - a, self.ends[b] - b)
        for h, rank in self.ranks[::-1]:
            while True:  # the longest doubling may count more than once
                fits = np.flatnonzero(total + h <= most)
                fits = fits[rank[a[fits] + total[fits]] == rank[b[fits] + total[fits]]]
                total[fits] += h
                if h < self.ranks[-1][0] or not len(fits):
                    break
        for _ in range(FIRST):
            fits = np.flatnonzero(total < most)
            fits = fits[self.data[a[fits] + total[fits]] == self.data[b[fits] + total[fits]]]
            most[np.setdiff1d(np.flatnonzero(total < most), fits, assume_unique=True)] = 0
            total[fits] += 1
        return total

    def samples(self, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions at the first and at the last places of runs, and their longest common prefixes with the suffix on the other side, if of the least length."""
        out = []
        for place, step in ((self.heads[self.heads > 0], -1), (self.tails[self.tails < len(self.order) - 1], 1)):
            at, other = self.order[place], self.order[place + step]
            near = self._starts_alike(at, other, least)
            out.append((at[near], self.common_prefix(at[near], other[near])))
        return out

    def matching_statistics(self, least: int = 1) -> np.ndarray:
        """For each position the length of the longest string from it on that starts at another position too (0 if it is less than least): streamed left to right over the samples, one less at each step."""
        reach = np.zeros(len(self.data), np.int64)
        for at, length in self.samples(least):
            reach[at] = np.maximum(reach[at], at + length)
        found = np.maximum.accumulate(reach) - np.arange(len(reach)) if len(reach) else reach
        return np.where(found >= least, found, 0)
