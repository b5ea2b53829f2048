"""Vectors in cells around pivots: which blocks of vectors can hold neighbours is known before a row is copied.

Each group of vectors gets about one pivot per ``block_rows`` rows. A vector belongs to the cell of its nearest pivot; a cell with
more rows than that is split further by a hash of the id. A block keeps its pivot, its reach (the greatest distance from the pivot)
and its greatest length, which is all that the bounds need:

* two vectors of unit length are within cosine distance eps only if their Euclidean distance is at most sqrt(2 eps), so two blocks
  whose pivots are further apart than that and both reaches are no pair (the triangle inequality);
* no vector of a block has a larger inner product with a question than that of the pivot plus the reach times the question's length.

Work on cells is done in numpy, a slice of rows or a pair of blocks at a time; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.blocks import assign_blocks, block_pairs, rows_per_block
from tidemark.operators.ordering import top_n_per_group
from tidemark.session import scratch_path

MAX_PIVOTS, SLICE_ROWS = 1_024, 20_000
#: Cells of a group until they hold ``blocks.BLOCK_ROWS`` rows.
MAX_CELLS = 32
#: Products held at once, and pairs looked at again in double precision at once.
TILE, AGAIN = 4_000_000, 50_000
#: Rows drawn per pivot.
SAMPLE = 8
#: Bounds are kept a little wide: distances are computed with rounding.
SLACK = 1e-6


def matrix(series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.empty((0, 0))


def near_tiles(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, mask) tile by tile: which rows of ``a`` and ``b`` have a cosine distance of at most ``eps``. Products are taken in
    single precision; those within its rounding error of the bound are taken again in double precision."""
    if not len(a) or not len(b):
        return
    least, step = 1 - eps, max(1, TILE // len(b))
    longest = [np.sqrt(np.nanmax((m * m).sum(1), initial=0.0)) for m in (a, b)]
    error = (a.shape[1] + 8) * 1.2e-7 * longest[0] * longest[1] + 1e-30 + 1.2e-7 * abs(least)
    plain = not (np.isfinite(error) and max(longest) < 1e15)
    a32, b32 = (None, None) if plain else (a.astype(np.float32), b.astype(np.float32))
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        if plain:
            yield start, 1.0 - a[part] @ b.T <= eps
            continue
        sims = a32[part] @ b32.T
        mask = sims >= np.float32(least)
        sims -= np.float32(least)
        i, j = np.nonzero(np.abs(sims, out=sims) <= error)
        if len(i) > mask.size // 64:
            mask = 1.0 - a[part] @ b.T <= eps
        else:
            mask[i, j] = distances(a, b, i + start, j) <= eps
        yield start, mask


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine distances of the rows ``i`` of ``a`` and ``j`` of ``b``, vectors of unit length."""
    out = np.empty(len(i))
    for k in range(0, len(i), AGAIN):
        out[k : k + AGAIN] = 1.0 - np.einsum("ij,ij->i", a[i[k : k + AGAIN]], b[j[k : k + AGAIN]])
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """A written table: steps that read it twice don't compute it twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Cells:
    """``rows``: the vectors with ``_blk``; ``blocks``: (group.., _blk, pivot, reach, norm, n). Written tables."""

    rows: DataFrame
    blocks: DataFrame
    group: list[str]


def build_cells(vectors: DataFrame, group: list[str], id_col: str, vec: str = "vec", block_rows: int = 4_000,
                max_pivots: int = MAX_PIVOTS) -> Cells:
    """Deal the rows of ``vectors`` (all columns kept) to blocks; rows without a vector are left out. A large group has larger blocks
    instead of ever more of them (``blocks.rows_per_block``)."""
    keys = [*group, "_one"]
    v = vectors.where(F.col(vec).isNotNull()).withColumn("_one", F.lit(0))
    sizes = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chance = F.xxhash64(F.col(id_col))
    # a bounded sample per group, of which the pivots are spread as far apart as they go
    per_block = rows_per_block(F.col("_n"), block_rows, MAX_CELLS)
    wanted = F.least(F.ceil(F.col("_n") / per_block), F.lit(max_pivots)).cast("int")
    drawn = top_n_per_group(v.select(*keys, F.col(vec).alias("pivot"), chance.alias("_h")), keys, [F.col("_h"), F.col("pivot")], SAMPLE * max_pivots, "_p")
    drawn = drawn.join(sizes.withColumn("_k", wanted), keys).where(F.col("_p") <= SAMPLE * F.col("_k"))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        a, k = matrix(pdf["pivot"]), int(pdf["_k"].iloc[0])
        chosen, apart = [0], np.linalg.norm(a - a[0], axis=1)
        while len(chosen) < min(k, len(a)):
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, np.linalg.norm(a - a[chosen[-1]], axis=1))
        return pdf.iloc[chosen].assign(_p=np.arange(1, len(chosen) + 1, dtype="int32"))[[*keys, "_p", "pivot", "_n"]]

    kinds = ", ".join(f"`{c}` {drawn.schema[c].dataType.simpleString()}" for c in (*keys, "_p", "pivot", "_n"))
    pivots = stored(drawn.groupBy(*keys).applyInPandas(spread, kinds), "pivots")
    slices = F.ceil(F.col("_n") / SLICE_ROWS).cast("int")
    left = v.join(sizes.select(*keys, slices.alias("_s")), keys).withColumn("_s", F.pmod(chance, F.col("_s")).cast("int"))
    right = pivots.withColumn("_s", F.explode(F.sequence(F.lit(0), slices - 1)))
    names = left.columns

    def nearest(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.assign(_cell=pd.Series([], dtype="int32"), _r=pd.Series([], dtype="float64"), _norm=pd.Series([], dtype="float64"))
        near = near.sort_values("_p")
        a, p = matrix(rows[vec]), matrix(near["pivot"])
        own = (a * a).sum(1)
        apart = np.maximum(own[:, None] + (p * p).sum(1)[None, :] - 2 * a @ p.T, 0)
        best = apart.argmin(1)
        return rows.assign(_cell=near["_p"].to_numpy()[best].astype("int32"), _r=np.sqrt(apart[np.arange(len(a)), best]), _norm=np.sqrt(own))

    schema = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in names)
    dealt = left.groupBy(*keys, "_s").cogroup(right.groupBy(*keys, "_s")).applyInPandas(nearest, f"{schema}, _cell int, _r double, _norm double")
    dealt = stored(dealt, "dealt")
    in_cell = dealt.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    parts = in_cell.join(sizes, keys).select(*keys, "_cell", F.ceil(F.col("_c") / per_block).cast("bigint").alias("_parts"))
    rows = dealt.join(parts, [*keys, "_cell"]).withColumn("_blk", F.col("_cell") * F.lit(1 << 20) + F.pmod(chance, F.col("_parts")))
    rows = stored(rows.drop("_s", "_parts"), "cells")
    of = rows.groupBy(*keys, "_blk", "_cell").agg(F.max("_r").alias("reach"), F.max("_norm").alias("norm"), F.count(F.lit(1)).alias("n"))
    blocks = stored(of.join(pivots.select(*keys, F.col("_p").alias("_cell"), "pivot"), [*keys, "_cell"]).drop("_one", "_cell"), "blocks")
    return Cells(rows.drop("_one", "_cell", "_r", "_norm"), blocks, group)


def near_blocks(cells: Cells, eps: float, chunk: int = 1_000) -> DataFrame:
    """(group.., _lo, _hi): the pairs of blocks, a block with itself included, that can hold vectors within cosine distance ``eps``."""
    group = cells.group
    grid = block_pairs(assign_blocks(cells.blocks.withColumnRenamed("_blk", "block"), group, "block", chunk))
    types = "".join(f"`{g}` {cells.blocks.schema[g].dataType.simpleString()}, " for g in group)

    def pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["_lo"].iloc[0] == pdf["_hi"].iloc[0]
        left = pdf if same else pdf[pdf["_blk"] == pdf["_lo"]]
        right = pdf if same else pdf[pdf["_blk"] == pdf["_hi"]]
        out = pd.DataFrame({"_lo": pd.Series([], dtype="int64"), "_hi": pd.Series([], dtype="int64")})
        if len(left) and len(right):
            a, b = matrix(left["pivot"]), matrix(right["pivot"])
            apart = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
            la, lb = left["norm"].to_numpy(), right["norm"].to_numpy()
            widest = np.sqrt(np.maximum(la[:, None] ** 2 + lb[None, :] ** 2 - 2 * (1 - eps), 0))
            can = apart - left["reach"].to_numpy()[:, None] - right["reach"].to_numpy()[None, :] <= widest + SLACK
            i, j = np.nonzero(can)
            x, y = left["block"].to_numpy()[i], right["block"].to_numpy()[j]
            if same:
                x, y = x[x <= y], y[x <= y]
            out = pd.DataFrame({"_lo": np.minimum(x, y), "_hi": np.maximum(x, y)})
        for n, g in enumerate(group):
            out[g] = key[n]
        return out

    return grid.groupBy(*group, "_lo", "_hi").applyInPandas(pairs, f"{types}_lo bigint, _hi bigint")


def met_blocks(rows: DataFrame, eps: float, id_col: str = "id", vec: str = "vec", block_rows: int = 4_000) -> DataFrame:
    """(_lo, _hi): the pairs of blocks (``_blk``) that do hold two rows within cosine distance ``eps``. Every row meets every other, in
    blocks by a hash of the id, whatever cells they lie in; a task returns pairs of blocks, never of rows."""
    r = rows.select("_blk", F.col(id_col).alias("id"), F.col(vec).alias("vec")).withColumnRenamed("_blk", "block")
    grid = block_pairs(assign_blocks(r, [], "id", block_rows))

    def cell(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["_blk"] == pdf[c].iloc[0]] for c in ("_lo", "_hi"))
        of, at = np.unique(pdf["block"].to_numpy(), return_inverse=True)
        at = dict(zip(pdf.index, at))
        x, y = (np.array([at[k] for k in side.index], dtype=np.int64) for side in (left, right))
        li, ri = left["id"].to_numpy(), right["id"].to_numpy()
        met = np.zeros(len(of) * len(of), bool)
        for start, mask in near_tiles(matrix(left["vec"]), matrix(right["vec"]), eps):
            i, j = np.nonzero(mask)
            i = i + start
            some = li[i] != ri[j]
            met[x[i[some]] * len(of) + y[j[some]]] = True
        a, b = np.divmod(np.flatnonzero(met), len(of))
        return pd.DataFrame({"_lo": np.minimum(of[a], of[b]), "_hi": np.maximum(of[a], of[b])}).drop_duplicates()

    return grid.groupBy("_lo", "_hi").applyInPandas(cell, "_lo bigint, _hi bigint").distinct()


def paired(rows: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    """The rows (with ``_blk``) copied to the pairs of blocks that they belong to."""
    ends = pairs.select(*group, "_lo", "_hi", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_blk"))
    return rows.join(ends, [*group, "_blk"])


def best_inner(cells: Cells, queries: DataFrame, k: int, min_sim: float, id_col: str = "doc_id", vec: str = "vec",
               chunk: int = 4_096, first: int = 2) -> DataFrame:
    """(query_id, doc_id, sim): at least the ``k`` largest inner products above ``min_sim`` of every question (query_id, vec), exactly.

    The most promising blocks of each question are searched, the k-th best product found is a floor, and of the other blocks only
    those whose bound reaches it are opened, for all questions at once. Questions go in chunks, so there is one plan for any number.
    """
    q = stored(queries.select("query_id", F.col("vec").alias("q")), "questions")
    bounds = stored(_bounds(cells, q, min_sim, chunk), "bounds")
    order = [F.desc("bound"), F.asc("_blk")]
    head = top_n_per_group(bounds, "query_id", order, first, "at")
    near = stored(_search(cells, q, head, k, min_sim, id_col, vec, chunk), "near")
    floor = top_n_per_group(near, "query_id", [F.desc("sim"), F.asc("doc_id")], k, "at").where(F.col("at") == k).select("query_id", F.col("sim").alias("floor"))
    rest = (bounds.join(head.select("query_id", "_blk"), ["query_id", "_blk"], "left_anti").join(floor, "query_id", "left")
            .where(F.col("bound") >= F.coalesce("floor", F.lit(min_sim)) - SLACK))
    return near.unionByName(_search(cells, q, rest, k, min_sim, id_col, vec, chunk))


def _bounds(cells: Cells, q: DataFrame, min_sim: float, chunk: int) -> DataFrame:
    """(query_id, _blk, bound): the blocks that can hold a product above ``min_sim``."""
    n_q = F.greatest(F.ceil(q.agg(F.count(F.lit(1))).scalar() / chunk), F.lit(1)).cast("int")
    n_b = F.greatest(F.ceil(cells.blocks.agg(F.count(F.lit(1))).scalar() / chunk), F.lit(1)).cast("int")
    left = q.withColumn("_q", F.pmod(F.xxhash64("query_id"), n_q).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), n_b - 1)))
    right = cells.blocks.select("_blk", "pivot", "reach").withColumn("_b", F.pmod(F.xxhash64("_blk"), n_b).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), n_q - 1)))

    def bound(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(blocks):
            return pd.DataFrame({"query_id": [], "_blk": [], "bound": []})
        a = matrix(asked["q"])
        high = a @ matrix(blocks["pivot"]).T + np.linalg.norm(a, axis=1)[:, None] * blocks["reach"].to_numpy()[None, :]
        i, j = np.nonzero(high > min_sim - SLACK)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[i], "_blk": blocks["_blk"].to_numpy()[j], "bound": high[i, j]})

    kind = q.schema["query_id"].dataType.simpleString()
    return left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(bound, f"query_id {kind}, _blk bigint, bound double")


def _search(cells: Cells, q: DataFrame, wanted: DataFrame, k: int, min_sim: float, id_col: str, vec: str, chunk: int) -> DataFrame:
    """(query_id, doc_id, sim) of each question's best ``k`` in each of its wanted blocks, ties of the k-th included."""
    asked = wanted.select("query_id", "_blk").join(q, "query_id")
    chunks = wanted.groupBy("_blk").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_k"))
    left = asked.join(chunks, "_blk").withColumn("_c", F.pmod(F.xxhash64("query_id"), F.col("_k")).cast("int")).drop("_k")
    right = cells.rows.select("_blk", F.col(id_col).alias("doc_id"), F.col(vec).alias("v")).join(chunks, "_blk").withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")

    def score(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": [], "doc_id": [], "sim": []})
        return best_rows(asked["query_id"].to_numpy(), matrix(asked["q"]), rows["doc_id"].to_numpy(), matrix(rows["v"]), k, min_sim)

    types = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {cells.rows.schema[id_col].dataType.simpleString()}, sim double"
    return left.groupBy("_blk", "_c").cogroup(right.groupBy("_blk", "_c")).applyInPandas(score, types)


def best_rows(qids: np.ndarray, qmat: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int, min_sim: float) -> pd.DataFrame:
    """Each question's best ``k`` rows of a matrix, ties of the k-th included: the final ranking breaks them by id. A few questions
    at a time, so the products held don't grow with the questions."""
    out_q, out_d, out_s = [], [], []
    step = max(1, TILE // max(1, len(mat)))
    for start in range(0, len(qmat), step):
        sims = qmat[start : start + step] @ mat.T
        for j, row in enumerate(sims, start):
            hit = np.flatnonzero(row > min_sim)
            if len(hit) > k:
                some = row[hit]
                hit = hit[some >= np.partition(some, len(hit) - k)[len(hit) - k]]
            out_q.append(np.repeat(qids[j], len(hit)))
            out_d.append(ids[hit])
            out_s.append(row[hit])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "doc_id": np.concatenate(out_d), "sim": np.concatenate(out_s)})
