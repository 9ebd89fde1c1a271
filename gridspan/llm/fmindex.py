"""FM-index over a sequence of small integers: suffix order, wavelet matrix, backward search, sampled positions.

An index covers one shard of a task's documents; its size is bounded by the
shard size that the caller chooses. Symbol 0 is the end mark.
"""

from __future__ import annotations

import numpy as np

#: Every so many text positions a suffix position is stored.
SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by doubling the compared length of those still tied.

    ``seq`` ends with its only 0.
    """
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    span = max(1, min(60 // bits, 8))
    key = np.zeros(n, np.int64)
    for i in range(span):
        key <<= bits
        if i < n:
            key[: n - i] |= seq[i:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.empty(n, bool)
    fresh[0], fresh[1:] = True, key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = ~(fresh & np.append(fresh[1:], True))
    active, h = order[tied], span
    while len(active):
        after = np.where(active + h < n, rank[np.minimum(active + h, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = rank[active]
        m = np.arange(len(active))
        new_key, new_group = np.empty(len(active), bool), np.empty(len(active), bool)
        new_key[0] = new_group[0] = True
        new_key[1:], new_group[1:] = key[1:] != key[:-1], group[1:] != group[:-1]
        start = np.maximum.accumulate(np.where(new_key, m, 0))
        rank[active] = group + start - np.maximum.accumulate(np.where(new_group, m, 0))
        active = active[~(new_key & np.append(new_key[1:], True))]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Counts and locates patterns in a sequence of symbols from 1 to ``top``."""

    def __init__(self, symbols: np.ndarray, top: int):
        seq = np.append(symbols.astype(np.int64), 0)
        order = suffix_array(seq)
        last = seq[order - 1]
        self.n = len(seq)
        self.levels = max(1, int(top).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.bits, self.zeros, self.split = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            self.bits.append(bit)
            self.zeros.append(np.concatenate([[0], np.cumsum(~bit)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            last = np.concatenate([last[~bit], last[bit]])
        sampled = order % SAMPLE == 0
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled)
        self.samples = order[sampled]
        self.start = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, split in zip(range(self.levels - 1, -1, -1), self.zeros, self.split):
            at = np.where(symbol >> level & 1, split + at - zeros[at], zeros[at])
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``at`` of the transformed sequence."""
        return self._descend(symbol, at) - self.start[symbol]

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one position earlier."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for bits, zeros, split in zip(self.bits, self.zeros, self.split):
            bit = bits[at]
            symbol = symbol << 1 | bit
            at = np.where(bit, split + at - zeros[at], zeros[at])
        return self.before[symbol] + at - self.start[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, all searched backward at once; ``patterns`` is padded to a matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for t in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > t) & (lo < hi))
            symbol = patterns[live, lengths[live] - 1 - t]
            lo[live] = self.before[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled one."""
        out, todo, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.sampled[row]
            out[todo[known]] = self.samples[self.sample_rank[row[known]] - 1] + steps
            todo, row = todo[~known], self.step_back(row[~known])
            steps += 1
        return out
