"""Words of whole texts as numpy arrays, hashed in one sweep per batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CODES = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base, or of its inverse, modulo 2^64."""
    if len(_powers[inverse]) < n:
        steps = np.full(max(n, 2 * len(_powers[inverse])), _BACK if inverse else _BASE)
        steps[0] = 1
        _powers[inverse] = np.cumprod(steps, dtype=np.uint64)
    return _powers[inverse][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts.

    ``start`` and ``end`` are byte offsets into ``data``; the words of text i
    are those from ``first[i]`` to ``first[i + 1]``.
    """

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def read_words(texts: Sequence[str | None], lower: bool = False) -> Words:
    """Words and their 64-bit hashes; a null text has none."""
    blobs = [(t or "").encode() for t in texts]
    data = b"\n".join([*blobs, b""])
    codes = np.frombuffer(data, np.uint8)
    if lower:
        codes = LOWER[codes]
    space = SPACE[codes]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    bounds = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])])
    first = np.searchsorted(start, bounds)
    if not len(start):
        return Words(data, start, end, first, np.empty(0, np.uint64))
    place = np.arange(len(codes)) - start[np.maximum(np.cumsum(~space & before) - 1, 0)]
    place[space] = 0
    values = CODES[codes] * powers(int((end - start).max()) + 1)[place]
    values[space] = 0
    sums = np.add.reduceat(values, start)
    return Words(data, start, end, first, mix(sums + (end - start).astype(np.uint64)))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values; empty below ``k`` values."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(n), dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * powers(n - k + 1, inverse=True) + np.uint64(k))


def slices(sizes: Sequence[int], limit: int = 2_000_000) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` in total size; a larger item stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def text_slices(texts: Sequence[str | None], limit: int = 2_000_000) -> Iterator[slice]:
    return slices([len(t) if isinstance(t, str) else 0 for t in texts], limit)
