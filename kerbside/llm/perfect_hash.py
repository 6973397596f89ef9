"""Minimal perfect hash of 64-bit keys: a cascade of bit arrays with ranks."""

from __future__ import annotations

import struct

import numpy as np

from kerbside.llm.text import U64, mix64

_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(keys ^ U64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U64(bits)).astype(np.int64)


class PerfectHash:
    """Maps each of ``n`` distinct keys to its own number below ``n``; other keys to any number or -1.

    At each level keys are hashed into ``gamma`` bits per key; a key alone in its
    bit is placed, the others go to the next level. A key's number is the rank
    of its bit, so the function takes about 3.5 bits a key.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes, self.ranks, total = levels, sizes, [], 0
        for level in levels:
            per_byte = _BITS[level].astype(np.int64)
            before = np.cumsum(per_byte) - per_byte + total
            self.ranks.append(before)
            total += int(per_byte.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, levels, sizes = np.unique(keys.astype(U64)), [], []
        while len(left):
            bits = max(8, int(len(left) * gamma))
            at = _slot(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(bits)
            left = left[~alone[at]]
        return cls(levels, sizes)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(U64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, (level, bits) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(open_):
                break
            at = _slot(keys[open_], i, bits)
            byte, bit = at >> 3, at & 7
            there = (level[byte] >> bit.astype(np.uint8)) & 1 == 1
            below = level[byte[there]] & ((1 << bit[there]) - 1).astype(np.uint8)
            out[open_[there]] = self.ranks[i][byte[there]] + _BITS[below]
            open_ = open_[~there]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", s) for s in self.sizes)
        return head + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", data)
        sizes = list(struct.unpack_from(f"<{n}Q", data, 4))
        at, levels = 4 + 8 * n, []
        for s in sizes:
            size = (s + 7) // 8
            levels.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(levels, sizes)
