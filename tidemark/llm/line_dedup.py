"""Line dedup with sharded cuckoo filters over exact reference counts: documents can be added and taken out again.

State: ``refs`` (shard, key, doc_id), one row per document and line key, written in the shared folder; the reference count of
a key is its number of rows. Adding a document adds its rows, deleting takes them out, so any series of changes leaves the
state that the remaining documents alone would give. Keys in ``min_docs`` or more documents are hot: each shard keeps their
fingerprints in a cuckoo filter that supports insert and delete. A filter answers "perhaps" or "no"; "perhaps" is settled
by the exact counts, so a collision costs time only.

A key is the md5 of the line, stripped of ASCII white space and with A-Z lower-cased. Null or empty texts are one empty
line. Rows that repeat a ``doc_id`` count as one document; null ids count as one document, smaller than all others. Keys
shorter than ``min_chars`` code points are never dropped. Extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, table, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Hot keys a shard's filter is planned for; the size up to which all filters together are broadcast (beyond, rows go to their
#: shards by shuffle); the rows that meet a filter in one task there.
SHARD_KEYS, FILTER_BYTES, PROBE_ROWS = 100_000, 64 << 20, 1_000_000
SLOTS, KICKS = 4, 500


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(ls: Column) -> Column:
    """Per line the md5 of its key (16 bytes), null if the key is too short. Step by step, so each line is trimmed once."""
    low = F.transform(F.transform(ls, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), ascii_lower)
    return F.transform(low, lambda k: F.when(F.char_length(k) >= MIN_CHARS, F.unhex(F.md5(k.cast("binary")))))


# --- cuckoo filters ------------------------------------------------------------------------------------------

class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket: insert, delete and look up by 64-bit hash."""

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.n = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8)))))

    @classmethod
    def built(cls, hashes: np.ndarray) -> Cuckoo:
        """A filter that holds all of ``hashes``; it doubles until none is left over."""
        f = cls.sized(len(hashes))
        while not all(f.insert(h) for h in hashes):
            f = cls(2 * f.n)
        return f

    def _print(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark * np.uint64(0x5BD1E995) & np.uint64(self.n - 1))

    def _places(self, h) -> tuple:
        h = np.asarray(h, np.uint64)
        mark = self._print(h)
        one = h & np.uint64(self.n - 1)
        return mark, one, self._other(one, mark)

    def insert(self, h) -> bool:
        """False if no cell was found; the fingerprint in hand is then lost, and the caller rebuilds larger."""
        mark, one, two = (int(x) for x in self._places(h))
        for b in (one, two):
            free = np.flatnonzero(self.cells[b] == 0)
            if len(free):
                self.cells[b, free[0]] = mark
                return True
        b = two
        for k in range(KICKS):
            slot = (k + mark) % SLOTS
            mark, self.cells[b, slot] = int(self.cells[b, slot]), mark
            b = int(self._other(np.uint64(b), np.uint64(mark)))
            free = np.flatnonzero(self.cells[b] == 0)
            if len(free):
                self.cells[b, free[0]] = mark
                return True
        return False

    def delete(self, h) -> bool:
        mark, one, two = (int(x) for x in self._places(h))
        for b in (one, two):
            held = np.flatnonzero(self.cells[b] == mark)
            if len(held):
                self.cells[b, held[0]] = 0
                return True
        return False

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        m = mark.astype(np.uint16)[:, None]
        return (self.cells[one] == m).any(1) | (self.cells[two] == m).any(1)


def _hash64(keys) -> np.ndarray:
    """The first 8 bytes of each key."""
    return np.frombuffer(b"".join(bytes(k)[:8] for k in keys), ">u8").astype(np.uint64)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(key, 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


# --- state ---------------------------------------------------------------------------------------------------

def refs_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id): the distinct line keys of each document."""
    keys = F.filter(keys_of(lines(F.col("text"))), lambda k: k.isNotNull())
    return docs.select("doc_id", F.explode(keys).alias("key")).distinct()


def counts(refs: DataFrame) -> DataFrame:
    """(key, n_docs, keeper): the exact reference counts. Combined before the shuffle, so a hot key sends a row per task."""
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def add(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Reference table after inserting ``docs``; a document that is there already (same id) is replaced."""
    new = refs_of(docs)
    return written(delete(refs, docs).unionByName(new))


def delete(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Reference table without the documents of ``docs`` (by id)."""
    gone = docs.select(F.col("doc_id").alias("gone_")).distinct()
    return refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_")), "left_anti")


def filters(hot: DataFrame, n_hot: int) -> DataFrame:
    """(shard, buckets, cells): a cuckoo filter per shard of the hot keys; the number of shards follows the number of keys."""
    shards = max(1, -(-n_hot // SHARD_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.built(_hash64(pdf["key"]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "buckets": [f.n], "cells": [f.cells.tobytes()]})

    return hot.select(_shard(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, buckets long, cells binary")


def apply_changes(filter_rows: DataFrame, inserted: DataFrame, deleted: DataFrame, shards: int) -> DataFrame:
    """The filters after hot keys came (``inserted``) and went (``deleted``), shard by shard; a full filter fails over to a
    rebuild by ``filters``."""
    moves = inserted.select("key", F.lit(1).alias("way")).union(deleted.select("key", F.lit(-1).alias("way"))).select(_shard(F.col("key"), shards).alias("shard"), "key", "way")

    def change(key: tuple, old: pd.DataFrame, move: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo(int(old["buckets"].iloc[0]), np.frombuffer(old["cells"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(old) else Cuckoo.sized(len(move))
        for h in _hash64(move["key"][move["way"] < 0]):
            f.delete(h)
        for h in _hash64(move["key"][move["way"] > 0]):
            if not f.insert(h):
                raise RuntimeError("the shard's filter is full: build it anew with filters()")
        return pd.DataFrame({"shard": [key[0]], "buckets": [f.n], "cells": [f.cells.tobytes()]})

    return filter_rows.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(change, "shard int, buckets long, cells binary")


def perhaps(keyed: DataFrame, filter_rows: DataFrame, shards: int) -> DataFrame:
    """The rows of ``keyed`` (with ``key`` and ``doc_id``) that the filters don't rule out. Filters travel to the rows while
    they are few. Beyond ``FILTER_BYTES`` rows go to their shards, and a shard with more than ``PROBE_ROWS`` rows is split by
    document, each part with a copy of the filter: a key with a third of the rows fills many tasks, and the driver sees none."""
    total = filter_rows.agg(F.sum(F.length("cells"))).first()[0] or 0
    if total > FILTER_BYTES:
        return _perhaps_by_shuffle(keyed, filter_rows, shards)
    sent = keyed.sparkSession.sparkContext.broadcast({r["shard"]: (r["buckets"], r["cells"]) for r in filter_rows.collect()})  # at most FILTER_BYTES

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {k: Cuckoo(n, np.frombuffer(c, np.uint16).reshape(-1, SLOTS)) for k, (n, c) in sent.value.items()}
        for pdf in batches:
            if not len(pdf):
                continue
            shard = np.frombuffer(b"".join(bytes(k)[8:12] for k in pdf["key"]), ">u4").astype(np.int64) % shards
            h, keep = _hash64(pdf["key"]), np.zeros(len(pdf), bool)
            for k, f in own.items():
                at = np.flatnonzero(shard == k)
                keep[at] = f.has(h[at])
            yield pdf[keep]

    return keyed.mapInPandas(probe, keyed.schema)


def _perhaps_by_shuffle(keyed: DataFrame, filter_rows: DataFrame, shards: int) -> DataFrame:
    placed = keyed.withColumn("shard_", _shard(F.col("key"), shards))
    # one row per shard, so its size goes with the number of filters
    parts = written(placed.groupBy(F.col("shard_").alias("shard")).agg(F.ceil(F.count(F.lit(1)) / PROBE_ROWS).cast("int").alias("parts")))
    placed = placed.join(parts, placed["shard_"] == parts["shard"]).drop("shard").withColumn("part_", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
    copies = filter_rows.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=["shard_", "part_"])
        if not len(rows) or not len(filters):  # no hot key in this shard
            return rows[:0]
        f = Cuckoo(int(filters["buckets"].iloc[0]), np.frombuffer(filters["cells"].iloc[0], np.uint16).reshape(-1, SLOTS))
        return rows[f.has(_hash64(rows["key"]))]

    return placed.groupBy("shard_", "part_").cogroup(copies.groupBy("shard", "part")).applyInPandas(probe, keyed.schema)


# --- use -----------------------------------------------------------------------------------------------------

def drop_lines(docs: DataFrame, refs: DataFrame | None = None, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines_``, ``n_dropped_`` and the remaining lines as ``kept_``. A key in ``min_docs`` documents of
    ``refs`` (default: of ``docs``) stays in the document with the largest id only."""
    refs = written(refs_of(docs)) if refs is None else refs
    hot = written(counts(refs).where(F.col("n_docs") >= min_docs).select("key", "keeper"))
    n_hot = hot.count()
    shards = max(1, -(-n_hot // SHARD_KEYS))
    doubtful = perhaps(refs.select("doc_id", "key"), written(filters(hot, n_hot)), shards)
    loses = doubtful.join(hot, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    loses = loses.groupBy(F.col("doc_id").alias("lose_id_")).agg(F.collect_set("key").alias("lose_"))
    j = docs.join(loses, docs["doc_id"].eqNullSafe(loses["lose_id_"]), "left")
    ls = lines(docs["text"])
    kept = F.filter(F.zip_with(ls, keys_of(ls), lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda y: ~F.coalesce(F.array_contains(F.col("lose_"), y["k"]), F.lit(False)))
    texts = F.when(F.col("lose_").isNotNull(), F.transform(kept, lambda y: y["x"]))
    whole = F.coalesce(docs["text"], F.lit(""))
    n = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    j = j.select(*(docs[c] for c in docs.columns), n.cast("long").alias("n_lines_"), whole.alias("whole_"), texts.alias("kept_"))
    dropped = F.when(F.col("kept_").isNull(), 0).otherwise(F.col("n_lines_") - F.size("kept_"))
    return j.withColumn("n_dropped_", dropped.cast("long")).withColumn("kept_", F.coalesce(F.array_join("kept_", "\n"), "whole_")).drop("whole_")


def op5(spark, sf_dir: str) -> DataFrame:
    """Per document: lines before dropping, dropped lines, digest of what is kept."""
    d = drop_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2(F.col("kept_").cast("binary"), 256).alias("kept_sha256"))


def lines_sql(source: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    """Common table expressions over ``source`` (row, doc_id, text): kept_ (row, n_lines, n_dropped, text)."""
    return f"""
ln_ AS (SELECT row, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source})),
key_ AS (SELECT *, translate(regexp_replace(l, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM ln_),
hot_ AS (SELECT k, max(doc_id) AS keeper FROM key_ WHERE length(k) >= {min_chars} GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs}),
kept_ AS (SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
          coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '') AS text FROM key_ LEFT JOIN hot_ USING (k) GROUP BY row)"""


SQL = f"""
WITH src_ AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents), {lines_sql("src_")}
SELECT doc_id, n_lines, n_dropped, sha256(kept_.text) AS kept_sha256 FROM kept_ JOIN src_ USING (row)"""
