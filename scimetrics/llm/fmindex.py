"""FM-index of a sequence of words: wavelet matrix, backward search, owners of matches."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol in a sequence, one packed bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.zeros, self.bits, self.counts = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(size)
        self.first = self._descend(np.zeros(size, np.int64), every)

    def _descend(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & below)
            bit = symbols >> (self.levels - 1 - k) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(at, symbols) - self.first[symbols]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling."""
    n = len(symbols)
    rank, step = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        changed = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        if step >= n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Index over reference segments ``(owner, words)``; matches never cross segments.

    Symbol 0 ends the sequence, 1 ends a segment, words follow.
    """

    def __init__(self, segments: list[tuple[int, list[bytes]]]) -> None:
        self.alphabet: dict[bytes, int] = {}
        sequence, owners = [], []
        for owner, words in segments:
            sequence += [self.alphabet.setdefault(w, len(self.alphabet) + 2) for w in words]
            sequence.append(1)
            owners += [owner] * (len(words) + 1)
        symbols = np.array([*sequence, 0], np.int64)
        order = suffix_array(symbols)
        self.size = len(self.alphabet) + 2
        self.wavelet = WaveletMatrix(symbols[order - 1], self.size)
        counts = np.bincount(symbols, minlength=self.size)
        self.before = np.cumsum(counts) - counts
        self.owner = np.array([*owners, np.iinfo(np.int64).max], np.int64)[order]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with one more symbol on the left."""
        both = self.wavelet.rank(np.tile(symbols, 2), np.concatenate([low, high]))
        base = self.before[symbols]
        return base + both[: len(low)], base + both[len(low) :]

    def matched(self, streams: list[tuple[int, list[bytes]]], least: int) -> list[np.ndarray]:
        """For every stream ``(owner, words)``: which words lie in a run of ``least`` words of a smaller owner.

        Matching statistics from right to left, all streams in step. While a
        whole stream matches one smaller owner's words, its statistic grows to its length.
        A stream that does not is searched again by its runs of ``least`` words.
        """
        owner = np.array([o for o, _ in streams], np.int64)
        coded = [np.array([self.alphabet.get(w, -1) for w in words], np.int64) for _, words in streams]
        whole = self._statistics(coded, owner)
        found = []
        for k, symbols in enumerate(coded):
            covered = np.zeros(len(symbols), bool)
            if len(symbols) >= least:
                if whole[k] == len(symbols):
                    covered[:] = True
                else:
                    runs = [symbols[i : i + least] for i in range(len(symbols) - least + 1)]
                    size = self._statistics(runs, np.full(len(runs), owner[k]))
                    for i in np.flatnonzero(size == least).tolist():
                        covered[i : i + least] = True
            found.append(covered)
        return found

    def _statistics(self, coded: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
        """Length of the longest suffix of each sequence that a smaller owner's segment holds."""
        size = np.array([len(c) for c in coded])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([coded[i] for i in order]) if len(coded) else np.empty(0, np.int64)
        size = size[order]
        end = np.cumsum(size)
        low, high = np.zeros(len(order), np.int64), np.full(len(order), len(self.owner), np.int64)
        length, alive = np.zeros(len(order), np.int64), size > 0
        for t in range(int(size[0]) if len(size) else 0):
            rows = np.flatnonzero(alive & (size > t))
            if not len(rows):
                break
            symbols = flat[end[rows] - 1 - t]
            known = symbols >= 0
            alive[rows[~known]] = False
            rows, symbols = rows[known], symbols[known]
            a, b = self.extend(symbols, low[rows], high[rows])
            inside = a < b
            alive[rows[~inside]] = False
            rows = rows[inside]
            low[rows], high[rows] = a[inside], b[inside]
            length[rows] = t + 1
        hit = np.flatnonzero(length > 0)
        smaller = np.zeros(len(order), bool)
        for k in hit.tolist():
            smaller[k] = self.owner[low[k] : high[k]].min() < owner[order[k]]
        result = np.zeros(len(order), np.int64)
        result[order] = np.where(smaller, length, 0)
        return result
