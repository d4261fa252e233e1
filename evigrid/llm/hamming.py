"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the sign bits of a vector, cut into segments of at most 16 bits with one hash table each. Segments are
searched at radius 0, then 1, and so on, one segment after another. When segments 0..j have been searched at radius r
and the rest at r - 1, every code at a distance below segments * r + j + 1 has been met; the search ends as soon as the
k-th verified distance is within that bound. Defined results: see search.py.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from . import common, search

SEGMENT = 16


@cache
def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits with `radius` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


def sign_bits(vectors: np.ndarray) -> np.ndarray:
    return vectors > 0


class MultiIndex:
    def __init__(self, bits: np.ndarray):
        """bits: booleans [code, bit]."""
        self.n, self.d = bits.shape
        self.cuts = [(a, min(a + SEGMENT, self.d)) for a in range(0, self.d, SEGMENT)]
        self.packed = np.packbits(bits, axis=1)
        self.tables = []
        for a, b in self.cuts:
            value = self.values(bits, a, b)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))))

    @staticmethod
    def values(bits: np.ndarray, a: int, b: int) -> np.ndarray:
        return bits[..., a:b] @ (1 << np.arange(b - a))

    def nearest(self, q: np.ndarray, enough: Callable[[np.ndarray, int], bool]) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances) met until enough(distances, bound) holds, where all below bound are known to be met."""
        seen = np.zeros(self.n, bool)
        code = np.packbits(q)
        segment = [int(self.values(q, a, b)) for a, b in self.cuts]
        found, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        s = len(self.cuts)
        for r in range(SEGMENT + 1):
            for j, (a, b) in enumerate(self.cuts):
                order, ends = self.tables[j]
                if r <= b - a:
                    at = segment[j] ^ flips(b - a, r)
                    lo, hi = ends[at], ends[at + 1]
                    size = hi - lo
                    stop = np.cumsum(size)
                    rows = order[np.repeat(lo - (stop - size), size) + np.arange(int(stop[-1]))]
                    rows = rows[~seen[rows]]
                    seen[rows] = True
                    found.append(rows)
                    distance.append(np.bitwise_count(self.packed[rows] ^ code).sum(1, dtype=np.int64))
                if enough(np.concatenate(distance), s * r + j + 1):
                    return np.concatenate(found), np.concatenate(distance)
        return np.concatenate(found), np.concatenate(distance)


def _index(vectors: np.ndarray, k: int) -> search.Find:
    index = MultiIndex(sign_bits(vectors))

    def enough(distance: np.ndarray, bound: int) -> bool:
        return len(distance) >= k and np.partition(distance, k - 1)[k - 1] < bound

    return lambda q: index.nearest(sign_bits(q), enough)


def top_k(df: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Hamming distance of the sign codes): exactly the k nearest of each query row."""
    rows = common.staged(search.usable(df, id_col, vector_col), "code-vectors")
    return search.in_blocks(rows, _index, k, "long", rows.count())
