"""Scalable Bloom chains: filters of growing size and tightening error, for keys given as two 64-bit hashes.

Layer i holds ``capacity * growth**i`` keys at an error of ``error * (1 - tighten) * tighten**i``; a new layer is added
once the active one is full (half of its bits set). The errors form a geometric series, so the chance that a new key is
called old stays below ``error`` however long the history grows. A key that was added is never called new.
"""

from __future__ import annotations

import math
import struct

import numpy as np


class Layer:
    def __init__(self, capacity: int, error: float) -> None:
        self.capacity, self.error, self.count = capacity, error, 0
        self.k = max(1, math.ceil(math.log2(1 / error)))
        self.m = np.uint64(8 * math.ceil(capacity * self.k / math.log(2) / 8))
        self.bits = np.zeros(int(self.m) // 8, np.uint8)

    def _at(self, h1: np.ndarray, h2: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            pos = (h1 + np.uint64(i) * (h2 | np.uint64(1)) + np.uint64(i * i)) % self.m
        return (pos >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (pos & np.uint64(7)).astype(np.uint8))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        alive = np.arange(len(h1))
        for i in range(self.k):
            if not len(alive):
                break
            at, bit = self._at(h1[alive], h2[alive], i)
            alive = alive[(self.bits[at] & bit) != 0]
        out = np.zeros(len(h1), bool)
        out[alive] = True
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for i in range(self.k):
            at, bit = self._at(h1, h2, i)
            np.bitwise_or.at(self.bits, at, bit)
        self.count += len(h1)

    def to_bytes(self) -> bytes:
        return struct.pack("<qdq", self.capacity, self.error, self.count) + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Layer:
        capacity, error, count = struct.unpack_from("<qdq", raw)
        out = cls(capacity, error)
        out.count, out.bits = count, np.frombuffer(raw, np.uint8, offset=24).copy()
        return out

    @property
    def fill(self) -> float:
        return float(np.bitwise_count(self.bits).sum(dtype=np.int64)) / float(self.m)


class BloomChain:
    def __init__(self, error: float = 0.001, capacity: int = 4096, growth: int = 2, tighten: float = 0.5) -> None:
        if not (0 < error < 1 and 0 < tighten < 1 and growth >= 1 and capacity >= 1):
            raise ValueError("error and tighten lie in (0, 1), growth and capacity are at least 1")
        self.error, self.capacity, self.growth, self.tighten = error, capacity, growth, tighten
        self.layers: list[Layer] = []

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        for layer in reversed(self.layers):  # the newest is the largest
            rest = np.flatnonzero(~out)
            out[rest] = layer.has(h1[rest], h2[rest])
        return out

    def _add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = 0
        while at < len(h1):
            if not self.layers or self.layers[-1].count >= self.layers[-1].capacity:
                i = len(self.layers)
                self.layers.append(Layer(self.capacity * self.growth**i, self.error * (1 - self.tighten) * self.tighten**i))
            n = min(len(h1) - at, self.layers[-1].capacity - self.layers[-1].count)
            self.layers[-1].add(h1[at : at + n], h2[at : at + n])
            at += n

    def test_and_add(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For each key in order: whether it may have occurred before, in this call or an earlier one."""
        seen = self.has(h1, h2)
        new = np.flatnonzero(~seen)
        with np.errstate(over="ignore"):
            mixed = h1[new] * np.uint64(0x9E3779B97F4A7C15) ^ h2[new]
        first = np.sort(np.unique(mixed, return_index=True)[1])
        repeat = np.ones(len(new), bool)
        repeat[first] = False
        seen[new[repeat]] = True
        self._add(h1[new[first]], h2[new[first]])
        return seen

    @property
    def bound(self) -> float:
        """The compounded bound on the error as the chain stands: each layer's measured fill to the power of its hashes."""
        keep = 1.0
        for layer in self.layers:
            keep *= 1 - layer.fill**layer.k
        return 1 - keep

    @property
    def size_bytes(self) -> int:
        return sum(len(x.bits) for x in self.layers)
