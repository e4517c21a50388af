"""Wavelet matrix: a token sequence as succinct bit planes with rank and select support.

Shard file: magic, version, levels, counts, zstd-compressed planes and rank samples, preceded by the index
of the shard's documents. One file answers token access, counting and occurrence lookup.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"SLWM"
HEAD = struct.Struct("<4sBBHQQ")  # magic, version, levels, reserved, symbols, documents
SAMPLE = 8  # 64-bit words between two stored ranks


class WaveletMatrix:
    """Planes from the highest bit down; each plane orders the symbols stably by the bits above it."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], samples: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.samples = n, planes, zeros, samples
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids)
        levels = levels or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, samples = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (cur >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(cur) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            planes.append(words)
            samples.append(ones[::SAMPLE].astype(np.uint32))
            low = cur[~bit]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[bit]])
        return cls(len(ids), planes, zeros, samples)

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each position."""
        if self._ranks is None:
            self._ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]) for w in self.planes]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.planes[k][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self._ranks[k][word] + np.bitwise_count(below)

    def access(self, at) -> np.ndarray:
        """Symbols at positions."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the sequence")
        out = np.zeros(len(at), np.uint32)
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            bit = (plane[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._rank(k, at)
            at = np.where(bit, zeros + ones, at - ones)
            out |= bit.astype(np.uint32) << np.uint32(len(self.planes) - 1 - k)
        return out

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        if symbol >> len(self.planes):
            return 0, 0
        at = np.array([start, end], np.int64)
        for k, zeros in enumerate(self.zeros):
            ones = self._rank(k, at)
            at = zeros + ones if symbol >> (len(self.planes) - 1 - k) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """How often ``symbol`` stands in [start, end)."""
        lo, hi = self._range(int(symbol), start, self.n if end is None else end)
        return hi - lo

    def _select_bit(self, k: int, bit: int, index: np.ndarray) -> np.ndarray:
        """Positions of the index-th zeros or ones of plane ``k``, by binary search over ranks."""
        lo, hi = np.zeros(len(index), np.int64), np.full(len(index), self.n, np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            ones = self._rank(k, mid + 1)
            enough = (ones if bit else mid + 1 - ones) > index
            lo, hi = np.where(enough | (lo >= hi), lo, mid + 1), np.where(enough, mid, hi)
        return lo

    def select(self, symbol: int, index) -> np.ndarray:
        """Positions of the given (0-based) occurrences of ``symbol``."""
        index = np.atleast_1d(np.asarray(index, np.int64))
        lo, hi = self._range(int(symbol), 0, self.n)
        if len(index) and (index.min() < 0 or index.max() >= hi - lo):
            raise IndexError("no such occurrence")
        at = lo + index
        for k in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        return self.select(symbol, np.arange(self.count(symbol)))

    def decode(self) -> np.ndarray:
        """The whole sequence, by undoing the planes' orders from the lowest bit up."""
        cur = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            out = np.empty_like(cur)
            out[~bit] = cur[:self.zeros[k]]
            out[bit] = cur[self.zeros[k]:] | cur.dtype.type(1 << (len(self.planes) - 1 - k))
            cur = out
        return cur.astype(np.uint32)


def write_shard(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard file: documents' ids (null allowed) and sizes, then the wavelet matrix of their tokens."""
    m = WaveletMatrix.build(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    index = b"".join([null.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), sizes.astype("<u8").tobytes()])
    body = b"".join([np.array(m.zeros, "<u8").tobytes(), *[s.astype("<u4").tobytes() for s in m.samples],
                     *[p.astype("<u8").tobytes() for p in m.planes]])
    pack = zstandard.ZstdCompressor(level=1).compress
    index, body = pack(index), pack(body)
    head = HEAD.pack(MAGIC, 1, len(m.planes), 0, m.n, len(doc_ids))
    return head + struct.pack("<QQ", len(index), len(body)) + index + body


def read_shard(content: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """(document ids, sizes, wavelet matrix) of a shard file."""
    magic, version, levels, _, n, docs = HEAD.unpack_from(content)
    if magic != MAGIC or version != 1:
        raise ValueError("not a shard file of this format")
    a, b = struct.unpack_from("<QQ", content, HEAD.size)
    at = HEAD.size + 16
    unpack = zstandard.ZstdDecompressor().decompress
    index, body = unpack(content[at:at + a]), unpack(content[at + a:at + a + b])
    null = np.frombuffer(index, np.uint8, docs)
    ids = np.frombuffer(index, "<i8", docs, docs)
    sizes = np.frombuffer(index, "<u8", docs, docs * 9).astype(np.int64)
    zeros = np.frombuffer(body, "<u8", levels).astype(np.int64).tolist()
    words = n // 64 + 1
    stored = -(-(words + 1) // SAMPLE)
    samples = [np.frombuffer(body, "<u4", stored, 8 * levels + 4 * stored * k) for k in range(levels)]
    base = 8 * levels + 4 * stored * levels
    planes = [np.frombuffer(body, "<u8", words, base + 8 * words * k) for k in range(levels)]
    return [None if z else int(i) for i, z in zip(ids, null)], sizes, WaveletMatrix(n, planes, zeros, samples)
