"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its PREFIX nearest of PIVOTS pivots, in order of distance. Every pivot's inverted file
posts the vectors that have it in their prefix, with the position. A query walks the files of its own prefix; with
absent pivots at position PREFIX, a shared pivot at positions i and j lowers the footrule distance by
2 * (PREFIX - max(i, j)), so summing PREFIX - max(i, j) over the postings ranks all vectors by footrule distance. The
CANDIDATES share of a shard that ranks first (LEAST vectors at least) is measured exactly, in double precision. Defined results: see search.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, search

PIVOTS = 512
PREFIX = 128
#: Pivots are drawn from a bounded sample of this many rows per vector length.
SAMPLE_ROWS = 2_048
SPREAD = 0.5
#: Share of a shard's vectors measured exactly for each query, at any size of the table, and how many at least.
CANDIDATES, LEAST = 0.05, 192


def pivot_order(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each vector, nearest first."""
    far = (pivots**2).sum(1) - 2 * (vectors @ pivots.T)
    near = np.argpartition(far, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(vectors), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def permutation_index(pivots: dict[int, np.ndarray], share: float) -> Callable[[np.ndarray, int], search.Find]:
    def make(vectors: np.ndarray, k: int) -> search.Find:
        own = pivots[vectors.shape[1]]
        prefix = min(PREFIX, len(own))
        order = pivot_order(vectors, own, prefix)
        posted = np.argsort(order.reshape(-1), kind="stable")  # by pivot, then vector
        file_ends = np.searchsorted(order.reshape(-1)[posted], np.arange(len(own) + 1))
        rows, places = (posted // prefix).astype(np.int32), (posted % prefix).astype(np.int16)
        n = len(vectors)
        most = min(n, max(k, LEAST, int(np.ceil(share * n))))

        def find(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = np.arange(n)
            if most < n:
                total = np.zeros(n, np.int32)
                for i, p in enumerate(pivot_order(q[None], own, prefix)[0]):
                    a, b = file_ends[p], file_ends[p + 1]
                    total[rows[a:b]] += prefix - np.maximum(places[a:b], np.int16(i))
                key = total.astype(np.int64) * n + np.arange(n - 1, -1, -1)
                near = np.argpartition(-key, most - 1)[:most]
            return near, np.sqrt(((vectors[near] - q) ** 2).sum(1))

        return find

    return make


def choose_pivots(rows: DataFrame, n_rows: int, n_pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots per vector length, from a bounded sample in the order of a hash of the vector. A vector closer to a pivot
    than SPREAD times the sample's median distance is passed over: pivots within one tight group tell nothing apart."""
    draw = F.xxhash64("v")
    fraction = min(1.0, 8 * SAMPLE_ROWS / max(n_rows, 1))
    drawn = rows.filter(F.pmod(draw, F.lit(1 << 30)) < int(fraction * (1 << 30)) + 1).select("dim", "v", draw.alias("draw"))
    sample: dict[int, list] = {}
    for r in drawn.orderBy("draw").limit(SAMPLE_ROWS).collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for dim, own in sample.items():
        x = np.array(own, float)
        some = x[:400]
        apart = SPREAD * float(np.median(np.sqrt(((some[: len(some) // 2 + 1, None] - some[None, len(some) // 2 :]) ** 2).sum(2))))
        picked = x[:1]
        for v in x[1:]:
            if len(picked) < n_pivots and ((picked - v) ** 2).sum(1).min() > apart * apart:
                picked = np.vstack([picked, v])
        out[dim] = picked
    for r in rows.groupBy("dim").agg(F.first("v").alias("v")).collect():  # a length that the sample missed
        out.setdefault(r["dim"], np.array([r["v"]], float))
    return out


def nearest(df: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): k nearest of each row whose id is divisible by 100."""
    rows = common.staged(search.usable(df, id_col, vector_col), "ann-vectors")
    n_rows = rows.count()
    return search.in_blocks(rows, permutation_index(choose_pivots(rows, n_rows), share), k, "double", n_rows)
