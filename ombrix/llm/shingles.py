"""Sets of hashed word shingles, and keys that two similar sets surely share.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. A document's set holds its distinct
k-word shingles; with fewer words, the whole sequence as one; without words it is empty.

Two sets whose Jaccard similarity is at least num / den differ in at most (den - num) / (den + num) * (|x| + |y|)
elements. Split by hash into more parts than that, they agree on a whole part. Sets of a size band use one number of
parts; a set also takes part in the next band if a larger set there could be similar to it. Only parts that hold something
get a key, unless a set has so few of them that its differences could touch each one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .common import SpanHasher, mix64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_hasher = SpanHasher(seed=53)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    if not texts:
        return []
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    solid = np.concatenate([[False], ~_SPACE[buf], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    word = _hasher(buf, starts, ends)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, bounds)
    n = np.diff(first)
    h = np.zeros(len(word), np.uint64)
    for i in range(k):
        part = np.zeros(len(word), np.uint64)
        part[: len(word) - i] = word[i:]
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x9E3779B97F4A7C15) + part
    h = mix64(h)
    out = []
    for a, m in zip(first.tolist(), n.tolist(), strict=False):
        if m >= k:
            out.append(np.unique(h[a : a + m - k + 1]))
        elif m:
            x = np.array([m], np.uint64)
            for w in word[a : a + m]:
                x = mix64(x ^ w) * np.uint64(0xD6E8FEB86659FD93)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    if not len(s):
        return 0, 0
    a = mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix64(s + np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64)
    return int(mix64(np.array([a + np.uint64(len(s))]))[0]), int(b)


@dataclass(frozen=True)
class Rule:
    """Similar: den * |x & y| >= num * |x | y|."""

    num: int = 9
    den: int = 10
    band: float = 1.4

    def similar(self, both: int, nx: int, ny: int) -> bool:
        return self.den * both >= self.num * (nx + ny - both) and both > 0

    def most_apart(self, total: int) -> int:
        """Elements in which similar sets of ``total`` elements together can differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    def bands(self, n: int) -> list[int]:
        """Bands in which a set of n elements takes part: its own, and those of larger sets it could be similar to."""
        own = self.band_of(n)
        return list(range(own, self.band_of(n * self.den // self.num) + 1))

    def band_of(self, n: int) -> int:
        j = max(0, int(math.log(max(n, 1)) / math.log(self.band)) - 1)
        while self.start(j + 1) <= n:
            j += 1
        return j

    def start(self, j: int) -> int:
        return math.ceil(self.band**j)

    def parts(self, j: int) -> int:
        most = self.most_apart(2 * (self.start(j + 1) - 1))
        return 1 if not most else most + 3 + most // 16

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Distinct 64-bit keys; any similar set has one of them too."""
        out = []
        n = len(s)
        for j in self.bands(n) if n else []:
            k = self.parts(j)
            if k == 1:
                sums, filled = mix64(s).sum(dtype=np.uint64, keepdims=True), np.ones(1, bool)
            else:
                part = ((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)  # ascends with s
                edge = np.searchsorted(part, np.arange(k + 1))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s), dtype=np.uint64)])
                sums, filled = total[edge[1:]] - total[edge[:-1]], edge[1:] > edge[:-1]
                if filled.sum() <= self.most_apart(n + n * self.den // self.num):
                    filled = np.ones(k, bool)
            tag = mix64(np.arange(k, dtype=np.uint64) + np.uint64(j << 32) + np.uint64(1))
            out.append(mix64(sums ^ tag)[filled])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)
