"""Grouping into themes, density clusters and their coherence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import tokens_informative, tokens_quality
from tidemark.functions.hashing import least_hashes
from tidemark.functions.vectors import dot
from tidemark.operators.blocks import assign_blocks, block_pairs, rows_per_block
from tidemark.operators.cells import build_cells, distances, matrix, near_blocks, near_tiles, paired, stored
from tidemark.session import cut_lineage

# Cluster constants.
MIN_CLUSTER = 3
EPS, SPLIT_EPS = 0.38, 0.30
COHERENCE_THRESHOLD = 0.78
# Words that glue unrelated posts together.
COMMON_TOKENS = (
    "refund return buyer seller case issue problem help please ebay item order receive received lost mail package "
    "tracking policy days time message respond contact support"
).split()


#: Functions of the MinHash estimate of mean overlaps, and of the share of common words in them.
HASHES, PENALTY_HASHES = 32, 128
#: Most blocks of word sets per cluster, rows of a block (about 1 KB each) and of a tile; pairs of rows per word counted at once.
PENALTY_BLOCKS, PENALTY_ROWS, PENALTY_TILE, PAIRS_AT_ONCE = 6, 65_536, 1_024, 2_000_000
#: A word counts by matrix product where this share of its pairs costs less than a product's column does; columns of a product at once.
PRODUCT_SHARE, PRODUCT_WORDS = 300, 1_024
#: Pairs that make a task of their own worth while, and most tasks.
PAIRS_PER_TASK, MOST_TASKS = 20_000_000, 4_000
#: Up to so many clusters, their sizes are sent to the rows.
SENT_CLUSTERS = 100_000


# --- label groups ---------------------------------------------------------------------------

def cluster_workstreams(df: DataFrame, label: str = "workstream", exclude: str = "EXCLUDE", min_size: int = MIN_CLUSTER) -> DataFrame:
    """Members (all columns) of label groups of at least ``min_size``; excluded rows drop out."""
    kept = df.where(F.col(label) != exclude)
    big = kept.groupBy(label).agg(F.count(F.lit(1)).alias("cluster_size")).where(F.col("cluster_size") >= min_size)
    # One row per label of the rule pack, so it is sent to the rows: dealt by label, a label with a third of all texts was one task.
    return kept.join(F.broadcast(big), label)


def cluster_ids(members: DataFrame, cluster: str, fingerprint: str) -> DataFrame:
    """(cluster, cluster_id) from the member set: the md5 of order-free sums (count, two sums and two xors of the hashed
    fingerprints), so no cluster is ever gathered in one value."""
    fp = F.md5(F.col(fingerprint).cast("string"))
    lo, hi = (F.conv(F.substring(fp, s, 15), 16, 10).cast("bigint") for s in (1, 17))
    parts = [F.count(F.lit(1)), F.sum(lo.cast("decimal(38,0)")), F.sum(hi.cast("decimal(38,0)")), F.bit_xor(lo), F.bit_xor(hi)]
    return members.groupBy(cluster).agg(F.md5(F.concat_ws(":", *[c.cast("string") for c in parts])).alias("cluster_id"))


def coherence_fast(members: DataFrame, cluster: str, text: Column) -> DataFrame:
    """(cluster, size, coherence) estimated from the word overlap of all rows.

    Two rows or fewer .85; a row without informative words .75; otherwise .6 + .4 times
    the mean pairwise Jaccard.
    """
    toks = members.select(cluster, tokens_informative(text).alias("_tok"))
    whole = toks.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.min(F.size("_tok")).alias("_least"))
    score = (F.when(F.col("size") <= 2, 0.85).when(F.col("_least") == 0, 0.75)
             .otherwise(0.6 + 0.4 * F.coalesce(F.col("_mean"), F.lit(0.5))))
    return whole.join(mean_jaccard(toks, cluster), cluster, "left").select(cluster, "size", score.alias("coherence"))


def mean_jaccard(toks: DataFrame, cluster: str, tok: str = "_tok", hashes: int = HASHES) -> DataFrame:
    """(cluster, _mean): mean Jaccard over all pairs of rows with words, by MinHash in linear time.

    Two rows share the minimum of a hash function with the probability of their Jaccard
    similarity; so the rows are counted per function and minimum, and n rows of one
    minimum are n(n-1)/2 agreeing pairs.  ``hashes`` sets the precision.
    """
    rows = toks.where(F.size(tok) > 0).select(cluster, F.posexplode(least_hashes(F.col(tok), hashes)).alias("_k", "_v"))
    same = rows.groupBy(cluster, "_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    sums = same.groupBy(cluster).agg(F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_same"), (F.sum("_n") / hashes).alias("_rows"))
    return sums.where("_rows > 1").select(cluster, (F.col("_same") / hashes / (F.col("_rows") * (F.col("_rows") - 1))).alias("_mean"))


def mean_pairwise_jaccard(members: DataFrame, cluster: str, text: Column, hashes: int = HASHES) -> DataFrame:
    """(cluster, token_coherence): the mean over all pairs of rows with words; clusters of one such row have none."""
    toks = members.select(cluster, tokens_quality(text).alias("_tok"))
    return mean_jaccard(toks, cluster, hashes=hashes).withColumnRenamed("_mean", "token_coherence")


# --- vectors ------------------------------------------------------------------------------------

def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of both blocks of a pair, and whether they are one."""
    lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
    return (pdf, pdf, True) if lo == hi else (pdf[pdf["_blk"] == lo], pdf[pdf["_blk"] == hi], False)


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (the least index of each) after the edges ``i``-``j`` are added to those of ``root``."""
    a, b = root[i], root[j]
    while True:
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        parent = np.arange(len(root))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root, a, b = parent[root], parent[a], parent[b]


def eps_neighbours(vectors: DataFrame, eps: float = EPS, group: list[str] | None = None, id_col: str = "id",
                   vec: str = "vec", block_rows: int = 4_000) -> DataFrame:
    """(group.., a, b, distance) with a < b and cosine distance <= eps, vectors of unit length.

    For inspection and small eps; the clustering below never writes pairs. Blocks that the triangle inequality keeps apart
    never meet; those that do are compared a tile at a time.
    """
    group = group or []
    id_type = vectors.schema[id_col].dataType.simpleString()
    gtypes = "".join(f"{g} {vectors.schema[g].dataType.simpleString()}, " for g in group)
    cells = build_cells(vectors.select(*group, F.col(id_col).alias("id"), F.col(vec).alias("vec")), group, "id", "vec", block_rows)
    grid = paired(cells.rows, near_blocks(cells, eps), group)

    def cell(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, same = _sides(pd.concat(list(parts)))
        a, b = matrix(left["vec"]), matrix(right["vec"])
        li, ri = left["id"].to_numpy(), right["id"].to_numpy()
        for start, mask in near_tiles(a, b, eps):
            i, j = np.nonzero(mask)
            i = i + start
            keep = li[i] < ri[j] if same else li[i] != ri[j]
            i, j = i[keep], j[keep]
            out = pd.DataFrame({"a": np.minimum(li[i], ri[j]), "b": np.maximum(li[i], ri[j]), "distance": distances(a, b, i, j)})
            yield out.assign(**dict(zip(group, key)))[[*group, "a", "b", "distance"]]

    return grid.groupBy(*group, "_lo", "_hi").applyInPandas(cell, f"{gtypes}a {id_type}, b {id_type}, distance double")


def dbscan_cosine(vectors: DataFrame, eps: float = EPS, min_samples: int = MIN_CLUSTER, group: list[str] | None = None,
                  id_col: str = "id", vec: str = "vec", block_rows: int = 4_000, max_rounds: int = 60) -> DataFrame:
    """(group.., id, cluster, is_core): density clusters per group, noise dropped.

    ``cluster`` is the smallest core id of the component; a border row joins the
    smallest such cluster within eps.  Passes over the pairs of blocks that are near enough
    to hold neighbours (see ``cells``), a tile at a time:

    1. neighbour counts -> core rows (equal vectors are folded into one weighted row),
    2. components of the core rows inside each block, then a spanning forest of these components
       per block pair -> components by repeated minimum labels with pointer jumping and reliable checkpoints,
    3. smallest adjacent cluster of every border row.

    Each pass writes at most one row per (row, block); pairs are never written. Blocks grow with the group, so
    copies do not; the comparisons are quadratic per group where no block can be dropped.
    """
    group = group or []
    base = vectors.select(*group, F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    schema = base.schema
    gtypes = "".join(f"{g} {schema[g].dataType.simpleString()}, " for g in group)
    id_type = schema["id"].dataType.simpleString()
    # Equal vectors are neighbours of each other and share all neighbours; a digest stands for the vector in joins.
    base = base.where("vec is not null").withColumn("_dig", F.md5(F.array_join(F.col("vec").cast("array<string>"), ",", "null")))
    folded = cut_lineage(base.groupBy(*group, "_dig").agg(F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")))
    cells = build_cells(folded, group, "rep", "vec", block_rows)
    pairs = stored(near_blocks(cells, eps), "near")
    keys = [*group, "_lo", "_hi"]

    def with_key(out, key):
        return out.assign(**dict(zip(group, key)))

    def count_cell(key, pdf):
        left, right, same = _sides(pdf)
        # a weight beyond ``min_samples`` says no more than that
        wl, wr = (np.minimum(side["w"].to_numpy(), max(min_samples, 1)).astype(np.float32 if min_samples * len(side) < 1 << 24 else np.float64) for side in (left, right))
        cl, cr = np.zeros(len(left)), np.zeros(len(right))
        for start, mask in near_tiles(matrix(left["vec"]), matrix(right["vec"]), eps):
            if same:  # a row is its own neighbour
                at = np.arange(len(mask))
                mask[at, at + start] = True
            hit = mask.astype(wl.dtype)
            cl[start : start + len(mask)] = hit @ wr
            if not same:
                cr += wl[start : start + len(mask)] @ hit
        out = pd.DataFrame({"rep": left["rep"], "c": cl.astype("int64")})
        if not same:
            out = pd.concat([out, pd.DataFrame({"rep": right["rep"], "c": cr.astype("int64")})])
        return with_key(out[out["c"] > 0], key)

    slim = cells.rows.select(*group, "_blk", "rep", "vec", "w")
    counts = (paired(slim, pairs, group).groupBy(*keys).applyInPandas(count_cell, f"{gtypes}rep {id_type}, c bigint")
              .groupBy(*group, "rep").agg((F.sum("c") >= min_samples).alias("is_core")))
    marked = cut_lineage(cells.rows.join(counts, [*group, "rep"]))
    core = marked.where("is_core").select(*group, "_blk", "rep", "vec")

    def inside_cell(key, pdf):
        pdf = pdf.sort_values("rep")
        a, rep = matrix(pdf["vec"]), pdf["rep"].to_numpy()
        root = np.arange(len(rep))
        for start, mask in near_tiles(a, a, eps):
            i, j = np.nonzero(mask)
            root = _merged(root, i + start, j)
        return with_key(pd.DataFrame({"_blk": pdf["_blk"], "rep": rep, "vec": pdf["vec"], "_root": rep[root]}), key)

    rooted = cut_lineage(core.groupBy(*group, "_blk").applyInPandas(inside_cell, f"{gtypes}_blk bigint, rep {id_type}, vec {schema['vec'].dataType.simpleString()}, _root {id_type}"))

    def forest_cell(key, pdf):
        left, right, _ = _sides(pdf)
        names, of = np.unique(np.concatenate([left["_root"].to_numpy(), right["_root"].to_numpy()]), return_inverse=True)
        ol, orr = of[: len(left)], of[len(left) :]
        root = np.arange(len(names))
        for start, mask in near_tiles(matrix(left["vec"]), matrix(right["vec"]), eps):
            i, j = np.nonzero(mask)
            root = _merged(root, ol[i + start], orr[j])
            if not root.any():
                break
        moved = np.flatnonzero(root != np.arange(len(names)))
        return with_key(pd.DataFrame({"a": names[moved], "b": names[root[moved]]}), key)

    edges = paired(rooted, pairs.where("_lo < _hi"), group).groupBy(*keys).applyInPandas(forest_cell, f"{gtypes}a {id_type}, b {id_type}")
    labels = connected_components(rooted.select(*group, F.col("_root").alias("node")).distinct(), edges, group, max_rounds)
    of_core = rooted.select(*group, "rep", "_root").join(labels.select(*group, F.col("node").alias("_root"), F.col("component").alias("_c")), [*group, "_root"])
    known = cut_lineage(marked.join(of_core.select(*group, "rep", "_c"), [*group, "rep"], "left"))

    def border_cell(key, pdf):
        left, right, same = _sides(pdf)
        out = [pd.DataFrame({"rep": pdf["rep"][:0], "_c": pd.Series([], dtype="int64")})]
        for rows, cols in ((left, right),) if same else ((left, right), (right, left)):
            free, near = rows[~rows["is_core"]], cols[cols["is_core"]].sort_values("_c")
            if len(free) and len(near):
                lab, rep = near["_c"].to_numpy().astype("int64"), free["rep"].to_numpy()
                for start, mask in near_tiles(matrix(free["vec"]), matrix(near["vec"]), eps):
                    ok = mask.any(1)
                    out.append(pd.DataFrame({"rep": rep[start : start + len(mask)][ok], "_c": lab[mask.argmax(1)[ok]]}))
        return with_key(pd.concat(out), key)

    border = (paired(known.select(*group, "_blk", "rep", "vec", "is_core", "_c"), pairs, group).groupBy(*keys).applyInPandas(border_cell, f"{gtypes}rep {id_type}, _c bigint")
              .groupBy(*group, "rep").agg(F.min("_c").alias("cluster")))
    placed = (known.where("is_core").select(*group, "_dig", F.col("_c").cast("bigint").alias("cluster"), "is_core")
              .unionByName(known.where("not is_core").join(border, [*group, "rep"]).select(*group, "_dig", "cluster", "is_core")))
    return base.join(placed, [*group, "_dig"]).select(*group, "id", "cluster", "is_core")


def connected_components(nodes: DataFrame, edges: DataFrame, group: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """(group.., node, component): smallest node of each component.

    Alternating large-star / small-star contraction (Kiveris et al., 2014): every round
    rewires edges towards the local minimum, so long chains shrink geometrically; each
    round is checkpointed reliably.
    """
    group = group or []
    g = group
    und = edges.where("a <> b").select(*g, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = cut_lineage(und)
    last = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(*g, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*g, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, [*g, "u"]).select(*g, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy(*g, "u").agg(F.min("v").alias("m"))
        small = (large.join(low2, [*g, "u"]).where("v <> m").select(*g, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select(*g, "u", F.col("m").alias("v"))).distinct())
        cur = cut_lineage(small)
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*g, "u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds: raise max_rounds")
    labels = cur.groupBy(*g, F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(labels, [*g, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def mean_pairwise_cosine(members: DataFrame, cluster: list[str], vec: str = "vec") -> DataFrame:
    """(cluster.., size, avg_similarity): mean inner product over all pairs, in linear time.

    The sum over pairs equals (|sum v|^2 - sum |v|^2) / 2; a summary per cluster and task carries both.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = members.where(F.col(vec).isNotNull()).select(*cluster, array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
    seen = rows.groupBy(*cluster).agg(Summarizer.metrics("sum", "normL2", "count").summary(F.col("_x")).alias("_s"))
    total, length, n = vector_to_array(F.col("_s.sum")), vector_to_array(F.col("_s.normL2")), F.col("_s.count")
    mean = (dot(total, total) - dot(length, length)) / (n * (n - 1))
    return seen.select(*cluster, n.alias("size"), F.when(n > 1, mean).otherwise(1.0).alias("avg_similarity"))


def overlap_penalty(members: DataFrame, cluster: list[str], id_col: str, text: Column, block_rows: int = 1_500,
                    common: list[str] = COMMON_TOKENS) -> DataFrame:
    """(cluster.., penalty): how far common words alone hold a cluster together, at most .15.

    Mean over all pairs of |a & b & common| / |a | b|, times .6, exactly, words by their 64-bit hashes. Rows without a common
    word add nothing and stay behind; equal word sets are one weighted row. Units of the block grid (blocks of ``block_rows`` rows or more)
    compare a tile at a time and return one partial sum each; ``overlap_penalty_sketch`` is the linear form for large clusters.
    """
    toks = members.select(*cluster, tokens_informative(text).alias("tok"))
    marks = F.array(*[F.xxhash64(F.lit(t)) for t in common]) if common else F.array().cast("array<bigint>")
    coded = toks.select(*cluster, F.size("tok").alias("_len"), F.array_sort(F.transform("tok", lambda t: F.xxhash64(t))).alias("tok"))
    # Rows without a common word are counted under no set.
    coded = coded.withColumn("tok", F.when(F.arrays_overlap("tok", marks), F.col("tok")))
    folded = cut_lineage(coded.groupBy(*cluster, "tok").agg(F.count(F.lit(1)).cast("double").alias("w"), F.min("_len").alias("_len")))
    whole = folded.groupBy(*cluster).agg(F.sum("w").alias("_n"), F.min("_len").alias("_least"))
    sets = folded.where("tok is not null").drop("_len").withColumn("_id", F.xxhash64("tok"))
    gtypes = "".join(f"{g} {toks.schema[g].dataType.simpleString()}, " for g in cluster)
    often = _frequent(sets)
    blocks, tasks = _penalty_blocks(sets, cluster, block_rows)
    packed = _packed(sets, cluster, gtypes, often).join(blocks, cluster).withColumn("_blk", F.pmod("_id", "_nblk").cast("int"))
    keys = [*cluster, "_lo", "_hi"]
    # Small data, long work: the number of tasks follows the pairs, not the bytes.
    grid = block_pairs(packed).drop("_id", "_nblk").repartition(tasks, *keys)
    shared = np.sort(np.array([r for r in members.sparkSession.range(1).select(marks).first()[0]], dtype=np.int64))

    def cell(t: pa.Table) -> pa.Table:
        blk, lo, hi = t["_blk"].to_numpy(), t["_lo"][0].as_py(), t["_hi"][0].as_py()
        left, right = (t.filter(pa.array(blk == b)).select(["code", "rest", "w"]).combine_chunks() for b in (lo, hi))
        total = glued(left, None if lo == hi else right, often, shared)
        return pa.table([*[t[g].slice(0, 1) for g in cluster], pa.array([total])], [*cluster, "_sum"])

    part = grid.groupBy(*keys).applyInArrow(cell, f"{gtypes}_sum double").groupBy(*cluster).agg(F.sum("_sum").alias("_sum"))
    mean = F.coalesce("_sum", F.lit(0.0)) / (F.col("_n") * (F.col("_n") - 1) / 2)
    penalty = F.when((F.col("_n") < 2) | (F.col("_least") == 0), 0.0).otherwise(F.least(F.lit(0.15), mean * 0.6))
    return whole.dropna(subset=cluster).join(part, cluster, "left").select(*cluster, penalty.alias("penalty"))


def _penalty_blocks(sets: DataFrame, cluster: list[str], block_rows: int) -> tuple[DataFrame, int]:
    """(cluster.., _nblk) and the number of tasks: one per unit of the block grid, where units are large; the usual number where there are so many units."""
    n = F.col("_n")
    sized = cut_lineage(sets.groupBy(*cluster).agg(F.count(F.lit(1)).alias("_n")))
    sized = sized.withColumn("_nblk", F.ceil(n / rows_per_block(n, block_rows, PENALTY_BLOCKS, PENALTY_ROWS)).cast("int"))
    units, pairs, clusters = sized.agg(F.sum(F.col("_nblk") * (F.col("_nblk") + 1) / 2), F.sum(n.cast("double") * n / 2), F.count(F.lit(1))).first()
    usual = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = sized.select(*cluster, "_nblk")
    return F.broadcast(blocks) if clusters <= SENT_CLUSTERS else blocks, int(max(1, min(units or 0, max(usual, (pairs or 0) / PAIRS_PER_TASK), MOST_TASKS)))


def _frequent(sets: DataFrame, most: int = 1 << 16) -> np.ndarray:
    """The words (hashes, in order) that so many sets hold that there are at most ``most``: as many as two bytes can number."""
    n = cut_lineage(sets.select(F.explode("tok").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("_n")))
    least, held = None, 0
    # A row per number of sets; only the words above the cut come to the driver.
    for r in sorted(n.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).collect(), key=lambda r: -r["_n"]):
        held += r["_c"]
        if held > most:
            break
        least = r["_n"]
    return np.sort(np.array([r["h"] for r in n.where(F.col("_n") >= F.lit(least)).collect()], np.int64))


def _packed(sets: DataFrame, cluster: list[str], types: str, often: np.ndarray) -> DataFrame:
    """The sets as they travel: frequent words by their number in ``often``, the others whole."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            tok = b["tok"]
            word, row = tok.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(tok)), tok.value_lengths().to_numpy(zero_copy_only=False))
            at, hit = _found(often, word)
            lists = []
            for values, of in (((at[hit] - (1 << 15)).astype(np.int16), row[hit]), (word[~hit], row[~hit])):
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(tok)))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in (*cluster, "w", "_id")], *lists], [*cluster, "w", "_id", "code", "rest"])

    return sets.select(*cluster, "w", "_id", "tok").mapInArrow(pack, f"{types}w double, _id bigint, code array<smallint>, rest array<bigint>")


def _word_sets(t: pa.Table, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and row of each, words per row."""
    code, rest = (t[c].combine_chunks() for c in ("code", "rest"))
    n, m = (c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (code, rest))
    at = code.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + (1 << 15)
    rows = np.arange(len(n))
    return np.concatenate([often[at], rest.flatten().to_numpy(zero_copy_only=False)]), np.concatenate([np.repeat(rows, n), np.repeat(rows, m)]), n + m


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of ``n`` places each, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def glued(left: pa.Table, right: pa.Table | None, often: np.ndarray, shared: np.ndarray, rows: int = PENALTY_TILE) -> float:
    """The weighted sum of |x & y & common| / |x | y| over the pairs of two blocks of word sets, or of one block (``right`` is None;
    copies of a set are pairs, too).

    Rows lie sorted by their common words, so tiles of ``rows`` rows without a common word between them are met early and passed over.
    """
    words = _vocabulary(left, often, rows)
    words = words if right is None else np.intersect1d(words, _vocabulary(right, often, rows), assume_unique=True)
    words = words[~np.isin(words, shared)]
    a = _tiles(left, words, often, shared, rows)
    b = a if right is None else _tiles(right, words, often, shared, rows)
    total = 0.0
    for i, x in enumerate(a):
        for y in b[i:] if right is None else b:
            s = _glue(x, y)
            # a tile against itself holds each pair twice, and each set once against itself instead of its copies
            total += s if x is not y else (s - (x.weight * x.common.sum(1) / x.size).sum()) / 2
    return total


@dataclass
class _Tile:
    """Some word sets: common words as a 0/1 matrix, other words as sorted ``words`` with their rows from ``start`` on."""

    weight: np.ndarray
    size: np.ndarray
    common: np.ndarray
    words: np.ndarray
    start: np.ndarray
    n: np.ndarray
    row: np.ndarray


def _vocabulary(t: pa.Table, often: np.ndarray, rows: int) -> np.ndarray:
    found = [np.unique(_word_sets(t.slice(k, rows), often)[0]) for k in range(0, len(t), rows)]
    return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def _tiles(t: pa.Table, words: np.ndarray, often: np.ndarray, shared: np.ndarray, rows: int) -> list[_Tile]:
    """The rows in the order of their common words, a tile at a time; of the other words only those in ``words``."""
    common = np.zeros((len(t), len(shared)), np.float32)
    for k in range(0, len(t), rows):
        word, row, _ = _word_sets(t.slice(k, rows), often)
        at, hit = _found(shared, word)
        common[k + row[hit], at[hit]] = 1
    order = np.lexsort(common.T[np.argsort(common.sum(0), kind="stable")])
    made = []
    for k in range(0, len(t), rows):
        of = order[k : k + rows]
        some = t.take(pa.array(of))
        word, row, size = _word_sets(some, often)
        at, hit = _found(words, word)
        row, at = row[hit], at[hit]
        by = np.argsort(at, kind="stable")
        held, start, n = np.unique(at[by], return_index=True, return_counts=True)
        made.append(_Tile(some["w"].to_numpy(), size.astype(np.float64), common[of], held, start, n, row[by].astype(np.int32)))
    return made


def _found(words: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word stands in ``words`` (in order), and whether it does."""
    if not len(words):
        return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    return at, words[at] == word


def _glue(a: _Tile, b: _Tile) -> float:
    """The weighted sum over all sets of one tile and of the other: words that many sets hold by a matrix product, the others
    by counting their pairs of sets."""
    n, m = len(a.size), len(b.size)
    both = a.common @ b.common.T
    if not both.any():
        return 0.0
    at, hit = _found(b.words, a.words)
    met = np.flatnonzero(hit)
    at = at[met]
    na, nb = a.n[met], b.n[at]
    often = na * nb * PRODUCT_SHARE > n * m
    inter = both.copy()
    chosen = np.flatnonzero(often)
    for some in (chosen[s : s + PRODUCT_WORDS] for s in range(0, len(chosen), PRODUCT_WORDS)):
        x, y = (np.zeros((len(t.size), len(some)), np.float32) for t in (a, b))
        for full, t, which in ((x, a, met[some]), (y, b, at[some])):
            full[t.row[_spans(t.start[which], t.n[which])], np.repeat(np.arange(len(some)), t.n[which])] = 1
        inter += x @ y.T
    rare = np.flatnonzero(~often)
    pairs = np.cumsum(na[rare] * nb[rare])
    for part in np.split(rare, np.unique(np.searchsorted(pairs, np.arange(PAIRS_AT_ONCE, pairs[-1], PAIRS_AT_ONCE)))) if len(rare) else ():
        # each row of ``a`` with the word, next to all rows of ``b`` with it
        left, k = a.row[_spans(a.start[met[part]], na[part])], np.repeat(nb[part], na[part])
        right = b.row[_spans(np.repeat(b.start[at[part]], na[part]), k)]
        inter += np.bincount(np.repeat(left.astype(np.int64) * m, k) + right, minlength=n * m).reshape(n, m)
    union = np.add.outer(a.size, b.size)
    union -= inter
    if a is b:
        np.fill_diagonal(union, a.size)  # words that no other set holds are left out above
    return float(a.weight @ np.divide(both, union, out=union) @ b.weight)


def overlap_penalty_sketch(members: DataFrame, cluster: list[str], id_col: str, text: Column, common: list[str] = COMMON_TOKENS,
                    hashes: int = PENALTY_HASHES) -> DataFrame:
    """(cluster.., penalty): ``overlap_penalty`` estimated by MinHash in linear time, for clusters of any size.

    The mean over all pairs of |a & b & common| / |a | b|, times .6: that ratio is the
    probability that two rows share the minimum of a hash function and the word that has it is a common one. A cluster
    with a row without words has no penalty.
    """
    toks = members.select(*cluster, tokens_informative(text).alias("tok"))
    whole = toks.groupBy(*cluster).agg(F.count(F.lit(1)).alias("_n"), F.min(F.size("tok")).alias("_least"))
    rows = toks.where(F.size("tok") > 0).select(*cluster, F.posexplode(least_hashes(F.col("tok"), hashes, frozenset(common))).alias("_k", "_v"))
    agreed = rows.where(F.col("_v") % 2 == 0).groupBy(*cluster, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    part = agreed.groupBy(*cluster).agg(F.sum(F.col("_c") * (F.col("_c") - 1)).alias("_sum"))
    mean = F.coalesce(F.col("_sum"), F.lit(0)) / hashes / F.greatest(F.col("_n") * (F.col("_n") - 1), F.lit(1))
    penalty = F.when((F.col("_n") < 2) | (F.col("_least") == 0), 0.0).otherwise(F.least(F.lit(0.15), mean * 0.6))
    return whole.join(part, cluster, "left").select(*cluster, penalty.alias("penalty"))


def coherence_vector(members: DataFrame, cluster: list[str], id_col: str, text: Column, vec: str = "vec",
                     threshold: float = COHERENCE_THRESHOLD, sketch: bool = False) -> DataFrame:
    """(cluster.., size, coherence, coherent): mean cosine minus the overlap penalty (exact, or by sketch in linear time); two
    rows or fewer score 1."""
    sim = mean_pairwise_cosine(members, cluster, vec)
    pen = (overlap_penalty_sketch if sketch else overlap_penalty)(members, cluster, id_col, text)
    score = F.when(F.col("size") <= 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("avg_similarity") - F.col("penalty")))
    return (sim.join(pen, cluster).withColumn("coherence", score)
            .withColumn("coherent", (F.col("size") <= 2) | (F.col("coherence") >= threshold))
            .select(*cluster, "size", "coherence", "coherent"))


def split_incoherent(members: DataFrame, verdict: DataFrame, cluster: str, id_col: str = "id", vec: str = "vec",
                     eps: float = SPLIT_EPS) -> DataFrame:
    """(id, cluster, sub): members of incoherent clusters of more than three rows, re-clustered more tightly.

    Sub-clusters of one or two rows become singletons; rows left as noise drop out,
    coherent clusters pass through with ``sub`` = cluster.
    """
    bad = verdict.where(~F.col("coherent") & (F.col("size") > 3)).select(cluster)
    loose = members.join(bad, cluster, "left_semi").select(F.col(cluster).alias("parent"), F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    tight = dbscan_cosine(loose, eps, 2, ["parent"])
    sizes = tight.groupBy("parent", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    split = tight.join(sizes, ["parent", "cluster"]).select(
        "id", F.col("parent").alias(cluster), F.when(F.col("_n") <= 2, F.col("id")).otherwise(F.col("cluster")).cast("string").alias("sub"))
    kept = members.join(bad, cluster, "left_anti").select(F.col(id_col).alias("id"), cluster, F.col(cluster).cast("string").alias("sub"))
    return kept.unionByName(split)


# --- names --------------------------------------------------------------------------------------------

def unique_names(cards: DataFrame, members: DataFrame, cluster: str = "cluster_id", theme: str = "theme",
                 title: str = "title", topic: str = "topic") -> DataFrame:
    """Repeated themes get their dominant topic appended."""
    dup = cards.groupBy(theme).agg(F.count(F.lit(1)).alias("_t")).where(F.col("_t") > 1)
    named = members.where(F.col(topic).isNotNull() & ~F.col(topic).isin("General", "Unknown", ""))
    counts = named.groupBy(cluster, topic).agg(F.count(F.lit(1)).alias("_c"))
    mode = counts.groupBy(cluster).agg(F.min_by(topic, F.struct(-F.col("_c"), F.col(topic))).alias("_dom"))
    out = cards.join(dup, theme, "left").join(mode, cluster, "left")
    fix = F.col("_t").isNotNull() & F.col("_dom").isNotNull()
    return out.select(
        *[c for c in cards.columns if c not in (theme, title)],
        F.when(fix, F.concat(F.col(theme), F.lit(": "), F.col("_dom"))).otherwise(F.col(theme)).alias(theme),
        F.when(fix, F.concat(F.col(title), F.lit(" ("), F.col("_dom"), F.lit(")"))).otherwise(F.col(title)).alias(title))
