"""What both vector searches share: usable vectors, dealing a query set against all rows in blocks, merging by rank.

All rows are dealt into shards by a hash of their id and the queries into blocks; each (shard, block) pair is one task
group of bounded size, which builds its index over the shard and answers the block. A block has as many queries as a
shard has rows, so an index is built once for that many answers, and a vector is sent once for that many comparisons. Equal
vectors of a shard are one entry with the `k + 1` smallest ids, which is all that any k nearest can need of them, so many copies neither crowd
an index nor its candidates.

Defined results: a vector that is null, empty, all zero, or holds a null or non-finite component takes no part, neither
as query nor as candidate; only vectors of equal length are compared; rows with the query's own id are not candidates;
a null id takes no part; ties go to the smaller id; with fewer candidates than k, all are returned; extra columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard at most, and shards at least for tables of more than FEW_ROWS rows each; queries of a block.
SHARD_ROWS, SHARDS, FEW_ROWS = 65_536, 64, 4_096
BLOCK_QUERIES = 65_536
EVERY = 100

#: A search over one shard: query vector -> (entries, scores), not yet ranked.
Find = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vid, v, dim of the vectors that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"  # travels as it is, and is measured as doubles
    return df.select(F.col(id_col).cast("long").alias("vid"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).filter(F.col("vid").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([np.asarray(c.flatten(), float) for c in col.chunks])
    return flat.reshape(len(col), -1)


def collapse(vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct vectors, flat ids, offsets): of each distinct vector the k smallest ids, ascending."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order] + 0.0, ids[order]
    _, first, inverse = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").reshape(-1), return_index=True, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    group = inverse[by]
    nth = np.arange(len(by)) - np.searchsorted(group, group)
    keep = nth < k
    size = np.bincount(group[keep], minlength=len(first))
    return vectors[first], ids[by[keep]], np.concatenate([[0], np.cumsum(size)])


def answer(make: Callable[[np.ndarray, int], Find], k: int, kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            vectors, ids, ends = collapse(matrix(rows.column("v")), rows.column("vid").to_numpy(), k + 1)
            search = make(vectors, k + 1)
            for q, v in zip(queries.column("vid").to_pylist(), matrix(queries.column("v")), strict=True):
                entry, score = search(v)
                size = ends[entry + 1] - ends[entry]
                stop = np.cumsum(size)
                found = ids[np.repeat(ends[entry] - (stop - size), size) + np.arange(int(size.sum()))]
                score = np.repeat(score, size)
                own = found != q
                found, score = found[own], score[own]
                best = np.lexsort((found, score))[:k]
                out[0].append(np.full(len(best), q))
                out[1].append(found[best])
                out[2].append(score[best])
        join = lambda parts, t: np.concatenate([np.zeros(0, t), *parts]).astype(t)
        return pa.table({"query_id": join(out[0], np.int64), "vec_id": join(out[1], np.int64), "score": join(out[2], np.int64 if kind == "long" else float)})

    return run


def in_blocks(rows: DataFrame, make: Callable[[np.ndarray, int], Find], k: int, kind: str, n_rows: int) -> DataFrame:
    """query_id, rank, vec_id, score: the queries are the rows whose vid is divisible by EVERY. rows: of usable()."""
    shards, blocks = max(1, -(-n_rows // SHARD_ROWS), min(SHARDS, n_rows // FEW_ROWS)), max(1, -(-n_rows // EVERY // BLOCK_QUERIES))
    of = lambda n, seed: F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", of(shards, 5)).withColumn("block", each(blocks))
    right = rows.filter(F.col("vid") % EVERY == 0).withColumn("block", of(blocks, 6)).withColumn("shard", each(shards))
    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(answer(make, k, kind), f"query_id long, vec_id long, score {kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
