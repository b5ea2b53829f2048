"""Approximate nearest neighbours by collision counting.

Every vector is projected on ``LINES`` random directions. Rows are dealt to blocks by a hash of their id; a block keeps one
sorted array per direction. A query opens a window around its own projection in each array and counts, per vector, in how
many windows it lies. Windows widen with the radius (virtual rehashing: the arrays stay, only the bounds move). A vector whose
count passes the threshold is verified by its exact distance. A block is done when the ``k``-th verified distance is within
the radius; if that never happens the windows end up covering the block, so small or odd blocks are searched exactly.

The threshold is the expected count of a vector at the radius less ``SLACK`` standard deviations: the chance to miss a
neighbour is that of a normal tail, about 2 % at the border and less inside. Nothing is capped: all vectors are indexed,
every candidate past the threshold is verified.

Vectors that are null, empty, zero or hold nulls or non-finite values take no part; neither do rows without id. Vectors of
another length are no candidates. Rows equal in id and vector count once. A query with no candidates has no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix, table, written

K, QUERY_EVERY = 10, 100
LINES, SLACK, GROWTH = 128, 2.0, 1.15
#: Vectors and queries that meet in one task.
BLOCK, CHUNK = 8192, 4096
#: The share of a normal within one standard deviation: how often a vector at the radius falls into a window of that half width.
HIT = math.erf(1 / math.sqrt(2))


def _directions(dim: int) -> np.ndarray:
    """Standard normal directions, the same in every task."""
    u = mix(np.arange(1, 2 * LINES * dim + 1, dtype=np.uint64)) / 2.0**64
    u = u.astype(np.float64).clip(1e-12, 1 - 1e-12)
    return (np.sqrt(-2 * np.log(u[::2])) * np.cos(2 * np.pi * u[1::2])).reshape(LINES, dim)


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of the ``k`` nearest of the block that each query finds."""
    n, lines = len(vectors), _directions(vectors.shape[1])
    need = LINES * HIT - SLACK * math.sqrt(LINES * HIT * (1 - HIT))
    projected = vectors @ lines.T
    order = np.argsort(projected, axis=0, kind="stable").T.copy()
    arrays = np.take_along_axis(projected.T, order, axis=1)
    at = queries @ lines.T
    spread = math.sqrt(2 * float(vectors.var(axis=0).sum())) or 1.0
    radii = [spread / 5]
    far = max(float(np.abs(arrays[:, [0, -1]]).max() + np.abs(at).max()), spread) * 2
    while radii[-1] < far:
        radii.append(radii[-1] * GROWTH)
    half = np.array(radii)
    low = np.stack([np.searchsorted(arrays[j], at[:, j, None] - half, "left") for j in range(LINES)])  # lines x queries x radii
    high = np.stack([np.searchsorted(arrays[j], at[:, j, None] + half, "right") for j in range(LINES)])
    out = []
    for q in range(len(queries)):
        counts, checked = np.zeros(n, np.int64), ids == query_ids[q]
        best, dist = np.empty(0, np.int64), np.empty(0)
        before_low = before_high = low[:, q, 0]
        for r, radius in enumerate(radii):
            lo, hi = low[:, q, r], high[:, q, r]
            grown = [order[j, a:b] for j in range(LINES) for a, b in ((lo[j], before_low[j]), (before_high[j], hi[j])) if b > a]
            before_low, before_high = lo, hi
            if grown:
                counts += np.bincount(np.concatenate(grown), minlength=n)
                new = np.flatnonzero((counts >= need) & ~checked)
                checked[new] = True
                best = np.concatenate((best, new))
                dist = np.concatenate((dist, np.sqrt(((vectors[new] - queries[q]) ** 2).sum(1))))
                first = np.lexsort((ids[best], dist))[:k]
                best, dist = best[first], dist[first]
            if checked.all() or len(dist) == k and dist[-1] <= radius:
                break
        out += [(int(query_ids[q]), int(ids[v]), float(d)) for v, d in zip(best, dist)]
    return out


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, dim): the vectors that take part, in double precision."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables of ``clean`` form. Each query meets each block once; the best of a block come
    back, and the best of all are taken per query."""
    n, nq = vectors.count(), queries.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-nq // CHUNK))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    held = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("chunk", every(chunks))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks))).withColumn("block", every(blocks))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        rows = search_block(np.stack(left["v"].to_list()), left["id"].to_numpy(), np.stack(right["v"].to_list()), right["id"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ("dim", "block", "chunk")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op1(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of each vector whose id is divisible by 100."""
    v = written(clean(table(spark, sf_dir, "embeddings")))
    return nearest(v, v.where(F.col("id") % QUERY_EVERY == 0))
