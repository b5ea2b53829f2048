"""Benchmark decontamination: a prefix-filtered set join on word shingles, in DataFrame operations only.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window). Its set is its shingles of
``SHINGLE`` words. A text contains a window only if it holds all of the set, so one shingle suffices as the necessary
prefix: the rarest by its count over all documents. Candidates pass the positional bound (the window would begin inside
the text) and the length bound (it would end inside), and are confirmed shingle by shingle at their places.

Nulls and empty texts have no words. Items without words have no windows; a null ``item_id`` is counted nowhere but still
marks words. Repeated rows each get their result. Other columns of the documents stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, words, written

WINDOW, SHINGLE = 10, 3
#: The shingles of the benchmark are broadcast up to this many rows (about 60 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _shingles(ws: Column, n: int) -> Column:
    """Array of (pos, gram): each run of ``n`` words with its place."""
    last = F.size(ws) - F.lit(n) + 1
    run = lambda w, i: F.concat_ws(" ", w, *(F.get(ws, i + k) for k in range(1, n)))
    return F.transform(F.when(last > 0, F.slice(ws, 1, last)).otherwise(F.slice(ws, 1, 0)), lambda w, i: F.struct(i.alias("pos"), run(w, i).alias("gram")))


def _runs(ws: Column, n: int) -> Column:
    """Array of (pos, w0, w1, ...): each run of ``n`` words, as words; missing ones are null."""
    count = F.greatest(F.size(ws) - F.lit(n) + 1, F.lit(0))
    part = lambda k: F.slice(ws, k + 1, count if k < n else F.lit(0)).alias(f"w{k}")
    return F.arrays_zip(F.slice(F.sequence(F.lit(0), F.size(ws)), 1, count).alias("pos"), *(part(k) for k in range(SHINGLE)))


def _number(*run: Column) -> Column:
    return F.xxhash64(*run)


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(wid, len, items, grams): each distinct window once, with the items that hold it and its shingles."""
    ws = F.col("ws")
    it = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    it = it.withColumn("len", F.least(F.size(ws), F.lit(width)))
    it = it.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size(ws) - F.col("len")), lambda s: F.slice(ws, s + 1, F.col("len")))).alias("ws"))
    one = it.groupBy(F.array_join("ws", " ").alias("wid"), "len").agg(F.collect_set("item_id").alias("items"))
    ws = F.split("wid", " ")
    grams = F.when(F.col("len") >= SHINGLE, _shingles(ws, SHINGLE)).when(F.col("len") == 2, _shingles(ws, 2)).otherwise(_shingles(ws, 1))
    return one.withColumn("grams", grams)


def contained(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans, items): per document with at least one window, where windows occur (start, len) and whose they are."""
    wins = written(windows(items, width))
    split = F.split("gram", " ")
    tokens = wins.select(F.explode("grams.gram").alias("gram")).distinct()
    tokens = written(tokens.select(F.col("gram").alias("token"), _number(*(F.get(split, F.lit(k)) for k in range(SHINGLE))).alias("number")))
    sizes = [r[0] for r in wins.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().sort("k").collect()] or [SHINGLE]  # at most SHINGLE values
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("ws"))
    runs = [_runs(F.col("ws"), k) for k in sizes]
    places = d.select("id", "text_hash", F.size("ws").alias("n_words"), F.inline(F.concat(*runs) if len(runs) > 1 else runs[0]))
    # a whole number finds the few places worth a look; the words themselves decide there (as a range, so that they stay no join key)
    run = [F.col(f"w{k}") for k in range(SHINGLE)]
    found = places.withColumn("own", _number(*run)).join(small(tokens, BROADCAST_ROWS), (F.col("own") == F.col("number")) & F.concat_ws(" ", *run).between(F.col("token"), F.col("token")))
    hits = written(found.select("id", "text_hash", "n_words", "pos", F.col("token").alias("gram")).distinct())

    # the prefix of each window: its rarest shingle over all documents; one that occurs nowhere rules the window out
    rarity = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = wins.select("wid", "len", F.size("grams").alias("size"), F.explode("grams").alias("g")).select("wid", "len", "size", F.col("g.pos").alias("offset"), F.col("g.gram").alias("gram"))
    own = own.join(rarity, "gram").groupBy("wid", "len", "size").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "offset", "gram")).alias("p"))
    prefix = written(own.where("found = size").select("wid", "len", F.col("p.offset").alias("offset"), F.col("p.gram").alias("gram")))

    start = F.col("pos") - F.col("offset")
    cand = hits.join(small(prefix, BROADCAST_ROWS), "gram").where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    cand = cand.select("id", "text_hash", start.alias("start"), "len", "wid")

    # confirm: shingles at every SHINGLE-th place and at the end cover all words of the window
    ws = F.split("wid", " ")
    step = F.least("len", F.lit(SHINGLE))
    places = F.array_union(F.sequence(F.lit(0), F.col("len") - step, step), F.array(F.col("len") - step))
    need = cand.select("*", F.size(places).alias("need"), F.explode(places).alias("at"))
    need = need.select("id", "text_hash", "start", "len", "wid", "need", (F.col("start") + F.col("at")).alias("pos"), F.array_join(F.slice(ws, F.col("at") + 1, step), " ").alias("gram"))
    h = hits.select(F.col("id").alias("h_id"), F.col("text_hash").alias("h_hash"), F.col("pos").alias("h_pos"), F.col("gram").alias("h_gram"))
    same = F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")) & (F.col("pos") == F.col("h_pos")) & (F.col("gram") == F.col("h_gram"))
    sure = need.join(h, same).groupBy("id", "text_hash", "start", "len", "wid", "need").agg(F.count(F.lit(1)).alias("seen")).where("seen = need")
    sure = sure.join(small(wins.select("wid", "len", "items"), BROADCAST_ROWS), ["wid", "len"])
    return sure.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """How many words lie inside at least one of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).cast("long").alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def mark(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``hit_``: n_words, n_hit, items (sorted text ids of the items with windows in the text)."""
    found = contained(docs, items, width, id_col, text_col).select(F.col("id").alias("f_id_"), F.col("text_hash").alias("f_hash_"), "spans", F.col("items").alias("items_"))
    # counted and hashed ahead of the join, so that texts need not travel where the caller doesn't want them
    own = docs.withColumns({"hash_": F.xxhash64(text_col), "n_words_": F.size(words(F.col(text_col))).cast("long")})
    ids = F.array_sort(F.transform(F.coalesce(found["items_"], F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    hit = F.struct(own["n_words_"].alias("n_words"), F.coalesce(covered(found["spans"]), F.lit(0).cast("long")).alias("n_hit"), ids.alias("items"))
    return own.join(found, own[id_col].eqNullSafe(found["f_id_"]) & (own["hash_"] == found["f_hash_"]), "left").select(*(own[c] for c in docs.columns), hit.alias("hit_"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, columns unchanged."""
    found = contained(docs, items, width).select(F.col("id").alias("f_id_"), F.col("text_hash").alias("f_hash_"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["f_id_"]) & (F.xxhash64(docs["text"]) == found["f_hash_"]), "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words inside benchmark windows, and the items they come from."""
    from tidemark.llm.common import table

    m = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return m.select("doc_id", "hit_.n_words", "hit_.n_hit", F.size("hit_.items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("hit_.n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def contaminated_sql(source: str, width: int = WINDOW) -> str:
    """Common table expressions over the rows of ``source`` (row, doc_id, text): dw_, hit_ (row, p, item_id)."""
    return f"""
bw_ AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win_ AS (SELECT DISTINCT item_id, least(len(ws), {width}) AS k, array_to_string(ws[s + 1:s + least(len(ws), {width})], ' ') AS w
         FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - {width}, 0) + 1)) AS s FROM bw_ WHERE len(ws) > 0)),
dw_ AS (SELECT row, doc_id, coalesce({_WORDS}, []) AS ws FROM {source}),
dg_ AS (SELECT row, s, k, array_to_string(ws[s + 1:s + k], ' ') AS w
        FROM (SELECT row, ws, k, unnest(range(0, len(ws) - k + 1)) AS s FROM dw_, (SELECT DISTINCT k FROM win_) WHERE len(ws) >= k)),
hit_ AS (SELECT DISTINCT row, s, d.k, item_id FROM dg_ d JOIN win_ w ON d.w = w.w AND d.k = w.k)"""


SQL = f"""
WITH src_ AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents), {contaminated_sql("src_")},
pos_ AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + k)) AS p FROM hit_) GROUP BY row),
its_ AS (SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS i FROM hit_) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw_ LEFT JOIN pos_ USING (row) LEFT JOIN its_ USING (row)"""
