"""A wavelet matrix over numpy bit-planes: access, counting, occurrence lookup, and one byte string.

Plane by plane from the highest bit, values are split stably into those with a 0 bit and those with a 1 bit. A
plane keeps its bits packed and, every 512 bits, the number of ones before; rank is a table look-up
and a population count of at most eight words, select a search in the table.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
MAGIC = b"WVM1"
HEADER = struct.Struct("<4sIQ")


class BitPlane:
    def __init__(self, words: np.ndarray, n: int, ranks: np.ndarray | None = None):
        self.words, self.n = words, n
        if ranks is None:
            ones = np.bitwise_count(words.reshape(-1, BLOCK // 64)).sum(axis=1, dtype=np.uint32)
            ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        self.ranks = ranks
        self.zeros = n - int(ranks[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> BitPlane:
        padded = np.zeros(-(-max(len(bits), 1) // BLOCK) * BLOCK // 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        return cls(padded.view("<u8"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, i: int) -> int:
        return int(self.words[i >> 6] >> np.uint64(i & 63)) & 1

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        block, word = i // BLOCK, i >> 6
        total = int(self.ranks[block]) + int(np.bitwise_count(self.words[block * 8 : word]).sum())
        if i & 63:
            total += (int(self.words[word]) & ((1 << (i & 63)) - 1)).bit_count()
        return total

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit; the caller knows that it exists."""
        low, high = 0, len(self.ranks) - 1
        before = lambda b: int(self.ranks[b]) if bit else b * BLOCK - int(self.ranks[b])
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid)
        block = np.unpackbits(self.words[low * 8 : low * 8 + 8].view(np.uint8), bitorder="little")
        return low * BLOCK + int(np.flatnonzero(block == bit)[k - before(low)])


class WaveletMatrix:
    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n, self.width = planes, n, len(planes)

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        x, planes = np.asarray(values, dtype=np.uint16 if width <= 16 else np.uint32), []
        if len(x) and int(x.max()) >> width:
            raise ValueError(f"a value needs more than {width} bits")
        for b in reversed(range(width)):
            bit = ((x >> b) & 1).astype(bool)
            planes.append(BitPlane.of(bit))
            x = np.concatenate([x[~bit], x[bit]])
        return cls(planes, len(x))

    def values(self) -> np.ndarray:
        """All values in order: the splits are undone from the lowest plane upwards."""
        v = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for b, plane in enumerate(reversed(self.planes)):
            bit, out = plane.bits(), np.empty_like(v)
            out[~bit] = v[: plane.zeros]
            out[bit] = v[plane.zeros :] | (1 << b)
            v = out
        return v

    def access(self, i: int) -> int:
        value = 0
        for plane in self.planes:
            bit = plane.get(i)
            value = value << 1 | bit
            i = plane.zeros + plane.rank1(i) if bit else i - plane.rank1(i)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        low = 0
        for k, plane in enumerate(self.planes):
            bit = value >> (self.width - 1 - k) & 1
            low, i = plane.rank(bit, low) + bit * plane.zeros, plane.rank(bit, i) + bit * plane.zeros
        return low, i

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of the value before position ``end``."""
        low, high = self._range(value, self.n if end is None else end)
        return high - low

    def select(self, value: int, k: int) -> int | None:
        """Position of the k-th occurrence (from 0); None when there are fewer."""
        low, high = self._range(value, self.n)
        if k >= high - low:
            return None
        i = low + k
        for b, plane in enumerate(reversed(self.planes)):
            bit = value >> b & 1
            i = plane.select(bit, i - bit * plane.zeros)
        return i

    def to_bytes(self) -> bytes:
        parts = [HEADER.pack(MAGIC, self.width, self.n)]
        for plane in self.planes:
            parts += [plane.ranks.astype("<u4").tobytes(), plane.words.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, width, n = HEADER.unpack_from(data)
        blocks = -(-max(n, 1) // BLOCK)
        if magic != MAGIC or len(data) != HEADER.size + width * (4 * (blocks + 1) + blocks * BLOCK // 8):
            raise ValueError("not a whole wavelet matrix")
        planes, at = [], HEADER.size
        for _ in range(width):
            ranks = np.frombuffer(data, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            planes.append(BitPlane(np.frombuffer(data, "<u8", blocks * BLOCK // 64, at), n, ranks))
            at += blocks * BLOCK // 8
        return cls(planes, n)
