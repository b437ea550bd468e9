"""A sequence of token ids as a compressed wavelet matrix in one block of bytes.

Symbols are numbered by falling frequency, so that the upper bit planes are
mostly zero. Each plane is cut into blocks that are compressed one by one; a
directory holds where a block begins and how many ones stand before it. Access,
rank and select open only the blocks they touch.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

MAGIC = b"TOKWM\x02"
BLOCK_BITS = 1 << 16
OPEN_BLOCKS = 128
_HEAD = struct.Struct("<6sHQQQQQQ")


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, kind).tobytes(), 1)


def _planes(symbols: np.ndarray, levels: int) -> tuple[list[int], list[np.ndarray]]:
    """Zeros and packed bits of every plane, from the highest bit down."""
    zeros, planes = [], []
    for level in range(levels - 1, -1, -1):
        bit = (symbols & symbols.dtype.type(1 << level)) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        # gathering at positions is several times as fast as by mask where the bits alternate
        low = np.flatnonzero(~bit)
        zeros.append(len(low))
        if level:
            symbols = np.concatenate([symbols.take(low), symbols.take(np.flatnonzero(bit))])
    return zeros, planes


def write_shard(
    tokens: np.ndarray, sizes: Sequence[int], ids: Sequence[int | None], order: tuple[int, int] = (0, 0)
) -> bytes:
    """The bytes of a shard: ``tokens`` of documents ``ids`` with ``sizes``, one after the other.

    ``order`` is the place of the shard among others. A missing id stays missing.
    """
    tokens = np.asarray(tokens, np.int64)
    counts = np.bincount(tokens) if len(tokens) else np.empty(0, np.int64)
    present = np.flatnonzero(counts)
    alphabet = present[np.argsort(-counts[present], kind="stable")]
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    number = np.zeros(len(counts), np.uint16 if levels <= 16 else np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    zeros, planes = _planes(number[tokens], levels)
    known = np.array([i is not None for i in ids], bool)
    parts = [
        _pack(np.array([0 if i is None else i for i in ids], np.int64), "<i8"),
        _pack(known, "u1"),
        _pack(np.asarray(sizes, np.int64), "<i8"),
        _pack(alphabet, "<u4"),
    ]
    block = BLOCK_BITS // 8
    blocks, ends, ones = [], [], []
    at = 0
    for plane in planes:
        before = 0
        for i in range(0, len(plane), block):
            raw = plane[i : i + block]
            packed = pa.compress(raw.tobytes(), "zstd", asbytes=True)
            blocks.append(packed)
            at += len(packed)
            ends.append(at)
            ones.append(before)
            before += int(np.bitwise_count(raw).sum())
    directory = _pack(np.array([*zeros, *ends, *ones], np.int64), "<i8")
    head = _HEAD.pack(
        MAGIC, levels, len(tokens), len(sizes), order[0], order[1], len(directory), sum(map(len, parts))
    )
    lengths = struct.pack("<4Q", *map(len, parts))
    return b"".join([head, lengths, *parts, directory, *blocks])


class TokenShard:
    """Random access to the bytes that ``write_shard`` made; what follows them is ignored."""

    def __init__(self, data: bytes) -> None:
        magic, self.levels, self.n, self.documents, *order, directory, parts = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"a token shard begins with {data[:6]!r}")
        self.order = tuple(order)
        lengths = struct.unpack_from("<4Q", data, _HEAD.size)
        at, sections = _HEAD.size + 32, []
        for length in lengths:
            sections.append(zlib.decompress(data[at : at + length]))
            at += length
        self.ids = np.frombuffer(sections[0], "<i8")
        self.known = np.frombuffer(sections[1], np.uint8).astype(bool)
        self.sizes = np.frombuffer(sections[2], "<i8")
        self.alphabet = np.frombuffer(sections[3], "<u4").astype(np.int64)
        numbers = np.frombuffer(zlib.decompress(data[at : at + directory]), "<i8")
        self.per_plane = -(-self.n // BLOCK_BITS)
        count = self.levels * self.per_plane
        self.zeros = numbers[: self.levels]
        self.ends = numbers[self.levels : self.levels + count]
        self.before = numbers[self.levels + count :].reshape(self.levels, self.per_plane)
        self.base, self.data = at + directory, data
        self._open: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self._code = {int(t): i for i, t in enumerate(self.alphabet.tolist())}

    def _raw(self, level: int, block: int) -> np.ndarray:
        k = level * self.per_plane + block
        begin = self.base + (int(self.ends[k - 1]) if k else 0)
        size = (min(BLOCK_BITS, self.n - block * BLOCK_BITS) + 7) // 8
        packed = self.data[begin : self.base + int(self.ends[k])]
        return np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint8)

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block and the ones before each of them; the least recently used is closed."""
        key = level * self.per_plane + block
        if key in self._open:
            self._open.move_to_end(key)
        else:
            size = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
            bits = np.unpackbits(self._raw(level, block), count=size, bitorder="little")
            ones = np.concatenate([[0], np.cumsum(bits, dtype=np.int32)])
            self._open[key] = bits, ones
            if len(self._open) > OPEN_BLOCKS:
                self._open.popitem(last=False)
        return self._open[key]

    def _step(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit at each position (0 at the end) and the ones before it."""
        bits, ones = np.zeros(len(at), np.int64), np.empty(len(at), np.int64)
        end = at >= self.n
        ones[end] = self.n - self.zeros[level]
        block = at // BLOCK_BITS
        for b in np.unique(block[~end]).tolist():
            here = np.flatnonzero((block == b) & ~end)
            own, before = self._block(level, b)
            place = at[here] - b * BLOCK_BITS
            bits[here] = own[place]
            ones[here] = self.before[level, b] + before[place]
        return bits, ones

    def access(self, positions: Sequence[int]) -> np.ndarray:
        """Token ids at the positions."""
        at, code = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(f"positions go from 0 to {self.n - 1}")
        for level in range(self.levels):
            bit, ones = self._step(level, at)
            code = code << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return self.alphabet[code]

    def _range(self, code: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of a symbol between two positions stand below the last plane."""
        at = np.array([low, high], np.int64)
        for level in range(self.levels):
            _, ones = self._step(level, at)
            at = self.zeros[level] + ones if code >> (self.levels - 1 - level) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in positions ``low`` to ``high``, the end not included."""
        code = self._code.get(token)
        high = self.n if high is None else min(high, self.n)
        if code is None or low >= high:
            return 0
        begin, end = self._range(code, max(low, 0), high)
        return end - begin

    def _select(self, level: int, bit: int, rank: np.ndarray) -> np.ndarray:
        """Position of the ``rank``-th bit of a kind in a plane, counted from 0."""
        before = self.before[level]
        if not bit:
            before = np.arange(self.per_plane) * BLOCK_BITS - before
        block, found = np.searchsorted(before, rank, "right") - 1, np.empty(len(rank), np.int64)
        for b in np.unique(block).tolist():
            here = np.flatnonzero(block == b)
            own, _ = self._block(level, b)
            found[here] = b * BLOCK_BITS + np.flatnonzero(own == bit)[rank[here] - before[b]]
        return found

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Positions of a token between two positions, in order."""
        code = self._code.get(token)
        high = self.n if high is None else min(high, self.n)
        if code is None or low >= high:
            return np.empty(0, np.int64)
        begin, end = self._range(code, max(low, 0), high)
        at = np.arange(begin, end)
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence, undone plane by plane from the last one."""
        code = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        kind = code.dtype.type
        for level in range(self.levels - 1, -1, -1):
            raw = [self._raw(level, b) for b in range(self.per_plane)]
            bit = np.unpackbits(np.concatenate(raw), count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(code)
            above[np.flatnonzero(~bit)] = code[: self.zeros[level]]
            above[np.flatnonzero(bit)] = code[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            code = above
        return self.alphabet.astype(np.uint32)[code]
