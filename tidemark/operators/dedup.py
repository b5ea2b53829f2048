"""Exact and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.hashing import simhash64, simhash_bands
from tidemark.operators.blocks import block_pairs, rows_per_block
from tidemark.operators.clustering import _merged as merged, connected_components
from tidemark.operators.ordering import keep_best_by_key, keep_first_by_key, top_n_per_group
from tidemark.session import cut_lineage

# Thresholds and key lengths of the duplicate rules.
NEAR_THRESHOLD = 5
#: Rows of a bucket that are compared in one block, and of a tile of comparisons.
HOT_BUCKET, TILE_ROWS, TILE_COLUMNS = 32_768, 64, 4_096


def prefix_key(text: Column, n: int | None = None, fold: bool = True) -> Column:
    """The digest of the whole text, or its first ``n`` characters where the caller asks for a prefix."""
    t = F.coalesce(text, F.lit(""))
    t = F.trim(t) if fold else t
    t = t if n is None else F.substring(t, 1, n)
    t = F.trim(F.lower(t)) if fold else t
    return F.md5(t) if n is None else t


def dedup_prefix(df: DataFrame, n: int | None = None, fold: bool = True, keep: str = "best",
                 text: str = "text", score: str = "score", pos: str = "pos") -> DataFrame:
    """One row per text (or text prefix of ``n`` characters): the best scored or the first.  Empty texts are dropped when folding."""
    key = prefix_key(F.col(text), n, fold)
    if fold:
        df = df.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    if keep == "best":
        return keep_best_by_key(df, key, score, pos)
    return keep_first_by_key(df, key, pos)


def dedup_by_key(df: DataFrame, key: Column, pos: str = "pos", keep_empty: bool = False) -> DataFrame:
    """First row per key.  Rows without a key are dropped, or all kept when ``keep_empty``."""
    keyed = df.withColumn("_k", key)
    has = (F.col("_k").isNotNull()) & (F.col("_k") != "")
    kept = keep_first_by_key(keyed.where(has), "_k", pos)
    if keep_empty:
        kept = kept.unionByName(keyed.where(~F.coalesce(has, F.lit(False))))
    return kept.drop("_k")


def dedup_text_or_url(df: DataFrame, text: str = "text", url: str = "url", pos: str = "pos") -> DataFrame:
    """Two passes, first by text key then by url; rows without a key pass that stage."""
    once = dedup_by_key(df, F.trim(F.lower(F.coalesce(F.col(text), F.lit("")))), pos, keep_empty=True)
    return dedup_by_key(once, F.col(url), pos, keep_empty=True)


def url_or_title_key(url: Column, title: Column) -> Column:
    return F.coalesce(F.when(F.length(url) > 0, url), title)


def url_or_hash_key(url: Column, text: Column) -> Column:
    return F.coalesce(F.when(F.length(url) > 0, url), F.md5(F.coalesce(text, F.lit(""))))


def competitor_title_key(competitor: Column, title: Column) -> Column:
    return F.concat_ws("::", F.coalesce(competitor, F.lit("")), F.trim(F.lower(F.coalesce(title, F.lit("")))))


def title_key(title: Column) -> Column:
    return F.trim(F.lower(F.coalesce(title, F.lit(""))))


# --- near duplicates ---------------------------------------------------------------------

def _edges(bands: int) -> list[int]:
    return [round(64 * i / bands) for i in range(bands + 1)]


def band_keys(hashes: DataFrame, h: str = "simhash", bands: int | None = None, threshold: int = NEAR_THRESHOLD) -> DataFrame:
    """A row per hash and band, with the band's bits as ``value``.

    There are ``threshold + 1`` bands unless the caller names another number: so many that every
    pair within ``threshold`` shares one.
    """
    bands = threshold + 1 if bands is None else bands
    structs = [F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in enumerate(simhash_bands(F.col(h), bands))]
    return hashes.withColumn("_kv", F.explode(F.array(*structs))).select(*hashes.columns, "_kv.band", "_kv.value")


def _band_blocks(hashes: DataFrame, h: str, bands: int, threshold: int, hot_bucket: int) -> DataFrame:
    """The rows of each bucket (band, value), copied to the pairs ``_lo``, ``_hi`` of its blocks; a bucket of up to ``hot_bucket`` rows is one block."""
    keyed = band_keys(hashes, h, bands, threshold)
    n = F.count(F.lit(1))
    sizes = keyed.groupBy("band", "value").agg(F.ceil(n / rows_per_block(n, max(hot_bucket, 1))).cast("int").alias("_nblk"))
    # At most bands * 2**width rows whatever the data size (12,288 for 6 bands of up to 11 bits).
    sizes = F.broadcast(sizes) if -(-64 // bands) <= 16 else sizes
    return block_pairs(keyed.join(sizes, ["band", "value"]).withColumn("_blk", F.pmod(F.xxhash64(h), F.col("_nblk")).cast("int")))


def _near(a: np.ndarray, b: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs within ``threshold`` bits, a tile at a time; where ``b`` is ``a``, each pair once."""
    for s in range(0, len(a), TILE_ROWS):
        for t in range(s if a is b else 0, len(b), TILE_COLUMNS):
            i, j = np.nonzero(np.bitwise_count(a[s : s + TILE_ROWS, None] ^ b[None, t : t + TILE_COLUMNS]) <= threshold)
            i, j = i + s, j + t
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _met_pairs(t: pa.Table, masks: np.ndarray, threshold: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The hashes of a pair of blocks and the near pairs (indices) that share no band before this one: each pair comes up once."""
    h, blk = t["simhash"].to_numpy().view(np.uint64), t["_blk"].to_numpy()
    lo, hi, band = (t[c][0].as_py() for c in ("_lo", "_hi", "band"))
    left = np.flatnonzero(blk == lo)
    right = left if lo == hi else np.flatnonzero(blk == hi)
    a = h[left]
    b = a if lo == hi else h[right]

    def pairs():
        for i, j in _near(a, b, threshold):
            x = a[i] ^ b[j]
            for m in masks[:band]:
                apart = (x & m) != 0
                i, j, x = i[apart], j[apart], x[apart]
            if len(i):
                yield left[i], right[j]

    return h, pairs()


def _masks(bands: int) -> np.ndarray:
    return np.array([((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(_edges(bands), _edges(bands)[1:])], np.uint64)


def with_simhash(df: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    return df.withColumn(out, simhash64(F.col(text)))


def near_pairs(df: DataFrame, h: str = "simhash", threshold: int = NEAR_THRESHOLD, bands: int | None = None,
               hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Distinct hash pairs (a < b) that differ in at most ``threshold`` bits; where ``bands`` is given, those that share a band.

    Works on distinct hashes, so a group of copies counts once; buckets are compared a tile at a time, so pairs that fail the
    distance test are never rows. The pairs grow with the square of a group of near copies; ``near_links`` counts them instead.
    """
    bands = threshold + 1 if bands is None else bands
    masks = _masks(bands)

    def cell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pairs = _met_pairs(pa.Table.from_batches(parts), masks, threshold)
        for i, j in pairs:
            a, b = v[i].view(np.int64), v[j].view(np.int64)
            yield pa.record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": np.bitwise_count(v[i] ^ v[j]).astype(np.int32)})

    hashes = cut_lineage(df.select(F.col(h).alias("simhash")).where("simhash is not null").distinct())
    blocks = _band_blocks(hashes, "simhash", bands, threshold, hot_bucket)
    return blocks.groupBy("band", "value", "_lo", "_hi").applyInArrow(cell, "a long, b long, distance int")


def near_links(df: DataFrame, h: str = "simhash", threshold: int = NEAR_THRESHOLD, bands: int | None = None,
               hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(simhash, class_id, n_links) per distinct hash: how many other hashes differ in at most ``threshold`` bits, and the smallest
    hash that such links reach.

    The same pairs as ``near_pairs``, counted where they are met: a pair of blocks returns a row per hash with its number
    of links there and the least hash of its component there, which are summed and joined into whole components.
    """
    bands = threshold + 1 if bands is None else bands
    masks = _masks(bands)

    def cell(t: pa.Table) -> pa.Table:
        v, pairs = _met_pairs(t, masks, threshold)
        order = np.argsort(v.view(np.int64))  # so the least index of a component is its least hash
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        n, root = np.zeros(len(v), np.int64), np.arange(len(v))
        for i, j in pairs:
            i, j = place[i], place[j]
            n += np.bincount(i, minlength=len(v)) + np.bincount(j, minlength=len(v))
            root = merged(root, i, j)
        own = v.view(np.int64)[order]
        linked = n > 0
        return pa.table({"simhash": own[linked], "least": own[root[linked]], "n": n[linked]})

    hashes = cut_lineage(df.select(F.col(h).alias("simhash")).where("simhash is not null").distinct())
    blocks = _band_blocks(hashes, "simhash", bands, threshold, hot_bucket)
    met = cut_lineage(blocks.groupBy("band", "value", "_lo", "_hi").applyInArrow(cell, "simhash long, least long, n long"))
    classes = connected_components(hashes.select(F.col("simhash").alias("node")), met.select(F.col("simhash").alias("a"), F.col("least").alias("b")))
    links = met.groupBy("simhash").agg(F.sum("n").alias("n_links"))
    return (classes.select(F.col("node").alias("simhash"), F.col("component").alias("class_id")).join(links, "simhash", "left")
            .withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))))


def _beaten(h: np.ndarray, s: np.ndarray, p: np.ndarray, threshold: int) -> np.ndarray:
    """Indices of the hashes near a better one (larger ``s``, then smaller ``p``; a missing ``p`` is not smaller and nothing is smaller than it).

    The best hashes go first, and what they beat is not compared again.
    """
    order = np.lexsort((p, -s))
    h, s, p = h[order], s[order], p[order]
    rows, lost = np.arange(len(h)), []
    for start in range(0, len(h), TILE_ROWS):
        rows = rows[np.searchsorted(rows, start, "right") :]
        gone = np.zeros(len(rows), bool)
        for at in range(0, len(rows), TILE_COLUMNS):
            target = rows[at : at + TILE_COLUMNS]
            i, j = np.nonzero(np.bitwise_count(h[start : start + TILE_ROWS, None] ^ h[None, target]) <= threshold)
            worse = target[j]
            i = i + start
            gone[at + j[(s[i] > s[worse]) | ((s[i] == s[worse]) & (p[i] < p[worse]))]] = True
        # rows of this chunk leave the list as it moves on, so those beaten are noted now
        lost.append(rows[gone])
        rows = rows[~gone]
    return order[np.concatenate(lost)] if lost else order[:0]


def near_dup_simhash(df: DataFrame, threshold: int = NEAR_THRESHOLD, bands: int | None = None, text: str = "text",
                     score: str = "score", pos: str = "pos", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Drop every row that a better candidate (score desc, position asc) resembles.

    The hashes are computed in one map-only pass and written as a slim table (position,
    score, hash) in the shared folder; all comparisons run on it.  Rows with the same hash
    collapse to their best one first (top-1 per key).  The survivors are compared per bucket
    of a band, best first: a row leaves at its first better neighbour, no pair list is produced.
    The full rows move once, in the final join on the position, which must be unique.
    """
    bands = threshold + 1 if bands is None else bands

    def cell(t: pa.Table) -> pa.Table:
        s, p = (np.asarray(pc.rank(t[c].combine_chunks(), sort_keys="ascending", tiebreaker="dense"), np.float64) for c in ("_s", "_p"))
        p[np.asarray(t["_p"].combine_chunks().is_null())] = np.nan
        return t.select(["_p"]).take(_beaten(t["simhash"].to_numpy().view(np.uint64), s, p, threshold))

    slim = cut_lineage(df.select(F.col(pos).alias("_p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s"),
                                 simhash64(F.col(text)).alias("simhash")))
    best = top_n_per_group(slim, "simhash", [F.desc("_s"), F.asc("_p")], 1)
    blocks = _band_blocks(best.where("simhash is not null"), "simhash", bands, threshold, hot_bucket)
    losers = blocks.groupBy("band", "value", "_lo", "_hi").applyInArrow(cell, f"_p {slim.schema['_p'].dataType.simpleString()}").distinct()
    kept = best.join(losers, "_p", "left_anti").select("_p")
    return df.join(kept, F.col(pos) == F.col("_p"), "left_semi")


def deduplicate(df: DataFrame, threshold: int = NEAR_THRESHOLD, prefix_chars: int | None = None, bands: int | None = None,
                text: str = "text", score: str = "score", pos: str = "pos") -> DataFrame:
    """Equal texts, then SimHash; ``prefix_chars`` narrows the first pass to prefixes."""
    exact = dedup_prefix(df, prefix_chars, True, "best", text, score, pos)
    return near_dup_simhash(exact, threshold, bands, text, score, pos)


def dedup_stats(total: DataFrame, exact: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: total, after_exact_dedup, exact_dupes, near_dupes, unique, dedup_rate.

    Rows with an empty text leave in the exact pass but are not counted as copies.
    """
    counts = (
        total.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.length(F.trim(F.coalesce(F.col("text"), F.lit("")))) > 0).alias("_filled"))
        .withColumn("after_exact_dedup", exact.agg(F.count(F.lit(1))).scalar())
        .withColumn("unique", unique.agg(F.count(F.lit(1))).scalar())
    )
    return counts.select(
        "total", "after_exact_dedup",
        (F.col("_filled") - F.col("after_exact_dedup")).alias("exact_dupes"),
        (F.col("after_exact_dedup") - F.col("unique")).alias("near_dupes"),
        "unique",
        F.round(1 - F.col("unique") / F.greatest(F.col("total"), F.lit(1)), 4).alias("dedup_rate"))
