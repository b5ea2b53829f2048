"""Best-fit packing into bins of several permitted lengths.

A document is cut into pieces of at most the largest length; nothing is dropped. Pieces are taken longest first. A piece goes
to the open bin that it leaves least room in; if none fits, a new bin is opened at the length with the least cost per token
that it can still hold, judged jointly over all lengths: ``cost`` has a part per bin, per token and per square of the length
(attention). At the end each bin shrinks to the smallest length that holds its contents.

Rows are dealt to shards by a hash of the document, about ``SHARD`` each, so tasks are of bounded size whatever the sources
hold; a shard packs ids and lengths only, texts don't travel.

Length is counted in words between white space (``length_of``). Null and empty texts have no tokens and are in no bin: they
get a row with null ``bin_id`` and length 0. Repeated rows are packed each; ties go by doc_id, then order. Extra columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, table

LENGTHS = (512, 1024, 2048, 4096, 8192)
PER_BIN, PER_SQUARE = 64.0, 1 / 16384
SHARD = 20_000


def length_of(text: Column) -> Column:
    return F.size(pieces(text, r"\s+"))


def cost(length: int) -> float:
    return PER_BIN + length + PER_SQUARE * length * length


def pack(pieces: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """For pieces sorted from long to short: (bin, offset) of each, and the final length of each bin."""
    lengths = tuple(sorted(lengths))
    left = sum(pieces)
    room_of: dict[int, list[int]] = defaultdict(list)  # room -> bins, last opened last
    rooms: list[int] = []  # rooms that some bin has, sorted
    size, used, bins, offsets = [], [], [], []
    for p in pieces:
        k = bisect.bisect_left(rooms, p)
        if k < len(rooms):
            room = rooms[k]
            b = room_of[room].pop()
            if not room_of[room]:
                rooms.pop(k)
        else:
            room = min((c for c in lengths if c >= p), key=lambda c: (cost(c) / min(c, left), c))
            b = len(size)
            size.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += p
        left -= p
        if room > p:
            if not room_of[room - p]:
                bisect.insort(rooms, room - p)
            room_of[room - p].append(b)
    return bins, offsets, [lengths[bisect.bisect_left(lengths, u)] for u in used]


def placements(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, length: Column | None = None) -> DataFrame:
    """(bin_id, bin_length, bin_used, offset, doc_id, piece, start, n_tokens): where each piece of each document lies."""
    top = max(lengths)
    d = docs.select("doc_id", (length_of(F.col("text")) if length is None else length).cast("long").alias("total"))
    shards = max(1, -(-docs.count() // SHARD))
    some = d.where("total > 0").select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("total") / top) - 1), lambda i: F.struct(
        i.cast("int").alias("piece"), (i * top).cast("long").alias("start"), F.least(F.lit(top), F.col("total") - i * top).cast("long").alias("n_tokens")))).alias("p"))
    some = some.select("doc_id", "p.*").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        b, at, sizes = pack(pdf["n_tokens"].tolist(), lengths)
        pdf["bin_id"] = pd.Series(b, dtype="int64") + (int(pdf["shard"].iloc[0]) << 32)
        pdf["offset"] = pd.Series(at, dtype="int64")
        pdf["bin_length"] = pd.Series([sizes[k] for k in b], dtype="int64")
        pdf["bin_used"] = pdf.groupby("bin_id")["n_tokens"].transform("sum")
        return pdf[["bin_id", "bin_length", "bin_used", "offset", "doc_id", "piece", "start", "n_tokens"]].astype({"doc_id": "Int64"})

    schema = "bin_id long, bin_length long, bin_used long, offset long, doc_id long, piece int, start long, n_tokens long"
    packed = some.groupBy("shard").applyInPandas(fill, schema)
    none = lambda kind: F.lit(None).cast(kind)
    empty = d.where("total = 0").select(none("long").alias("bin_id"), none("long").alias("bin_length"), none("long").alias("bin_used"), none("long").alias("offset"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.unionByName(empty)


def bins(places: DataFrame) -> DataFrame:
    """One row per bin: its length, use and contents in order. A bin holds at most as many pieces as tokens."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "n_tokens")))
    return places.where("bin_id is not null").groupBy("bin_id", "bin_length", "bin_used").agg(inside.alias("contents"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return placements(table(spark, sf_dir, "documents"))
