"""A stored inverted index with block maxima, and exact top-k search on it.

Documents are dealt to blocks of about ``BLOCK_DOCS``. A posting list is cut at the blocks: one row per word and block holds the
postings and the greatest share a single posting of it can add to a score. Rows are laid out by a hash of the word
(``bucket``, a partition column), so a search reads the partitions of its words only, and never the texts.

A search deals the lists of its words to parts of the blocks. A part first adds up the maxima per question and block: no document of the
block can score higher. The most promising blocks are scored, their k-th best score is a floor, and of the others only blocks that can
reach it are opened. Ties with the floor are opened as well, so the result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.text import tokens_retrieval
from tidemark.operators.ordering import top_n_per_group
from tidemark.session import scratch_path

# Ranking constants.
K1, B = 1.5, 0.75
BUCKETS, BLOCK_DOCS = 64, 128
#: Blocks that a task works on at once, and questions.
PART_BLOCKS, QUESTIONS = 64, 4_096
#: Scores are compared at nine decimals; a bound may be off by as much.
SLACK = 1e-8


@dataclass
class SearchIndex:
    """Where the tables lie, and the two numbers of the collection that scores need."""

    spark: SparkSession
    path: str
    n: int
    avgdl: float
    buckets: int
    k1: float
    b: float
    id_type: str

    @property
    def blocks(self) -> DataFrame:
        """(bucket, term, block, peak, postings[doc_id, tf, dl])"""
        return self.spark.read.schema(f"term string, block int, peak double, postings array<struct<doc_id: {self.id_type}, tf: bigint, dl: int>>, bucket int").parquet(f"{self.path}/blocks")

    @property
    def terms(self) -> DataFrame:
        """(bucket, term, df)"""
        return self.spark.read.schema("term string, df bigint, bucket int").parquet(f"{self.path}/terms")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def share(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    """What a word that occurs ``tf`` times in a text of ``dl`` words adds per unit of rarity."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def write_index(docs: DataFrame, id_col: str, text: Column, path: str | None = None, buckets: int = BUCKETS,
                block_docs: int = BLOCK_DOCS, k1: float = K1, b: float = B) -> SearchIndex:
    """Tokenise once and store. Rows without words count in the collection size, as rows with an empty text do."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "index")
    words = docs.select(F.col(id_col).alias("doc_id"), tokens_retrieval(text).alias("words")).withColumn("dl", F.size("words"))
    n, total = words.agg(F.count(F.lit(1)), F.sum("dl")).first()
    avgdl = max((total or 0) / n, 1.0) if n else 1.0
    id_type = docs.schema[id_col].dataType.simpleString()
    n_blocks = max(1, -(-n // block_docs))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int")
    dealt = words.where("dl > 0").withColumn("block", block).withColumn("_p", F.pmod("block", F.lit(_parts(spark, n_blocks))).cast("int"))

    def lists(rows: pa.Table) -> pa.Table:
        return posting_lists(rows, avgdl, k1, b)

    # texts go to their block as words, and its posting lists are made there; only those go on to the partitions of their words
    rows = (dealt.groupBy("_p").applyInArrow(lists, f"term string, block int, peak double, postings array<struct<doc_id: {id_type}, tf: bigint, dl: int>>")
            .withColumn("bucket", bucket_of(F.col("term"), buckets)))
    laid = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    index = SearchIndex(spark, path, n, avgdl, buckets, k1, b, id_type)
    df = index.blocks.groupBy("bucket", "term").agg(F.sum(F.size("postings")).alias("df"))
    df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return index


def _parts(spark: SparkSession, n_blocks: int) -> int:
    """In how many parts the blocks are worked on: a part has ``PART_BLOCKS`` of them, fewer in small collections."""
    return max(spark.sparkContext.defaultParallelism, -(-n_blocks // PART_BLOCKS))


def _numbers(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, and those; null is a value."""
    if not pa.types.is_nested(values.type):
        coded = values.dictionary_encode(null_encoding="encode")
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary
    seen: dict[str, int] = {}
    at = np.array([seen.setdefault(repr(v), len(seen)) for v in values.to_pylist()], np.int64)
    return at, values.take(pa.array(np.unique(at, return_index=True)[1]))


def posting_lists(rows: pa.Table, avgdl: float, k1: float, b: float) -> pa.Table:
    """(term, block, peak, postings) of the texts ``rows(doc_id, words, dl, block)``; rows of one id and length count as one text."""
    lists = rows["words"].combine_chunks()
    term, terms = _numbers(lists.flatten())
    doc, ids = _numbers(rows["doc_id"].combine_chunks())
    dl, block = (rows[c].to_numpy().astype(np.int64) for c in ("dl", "block"))
    text, first, same = np.unique(np.stack([doc, dl]), axis=1, return_index=True, return_inverse=True)
    per_word = np.repeat(same.ravel(), pc.list_value_length(lists).to_numpy())
    pair, tf = np.unique(term * len(first) + per_word, return_counts=True)
    term, at = np.divmod(pair, len(first))
    order = np.lexsort((block[first][at], term))
    term, at, tf = term[order], at[order], tf[order]
    own, size = block[first][at], text[1][at]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (own[1:] != own[:-1]))))
    postings = pa.StructArray.from_arrays([ids.take(pa.array(text[0][at])), pa.array(tf.astype(np.int64)), pa.array(size.astype(np.int32))], ["doc_id", "tf", "dl"])
    return pa.table({"term": terms.take(pa.array(term[new])), "block": own[new].astype(np.int32), "peak": np.maximum.reduceat(share(tf, size, avgdl, k1, b), new),
                     "postings": pa.ListArray.from_arrays(pa.array(np.append(new, len(term)).astype(np.int32)), postings)})


def question_terms(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, bucket, weight): each word of a question with its count times its rarity; words of no document drop out."""
    t = (queries.select("query_id", F.explode(tokens_retrieval(F.col("query"))).alias("term"))
         .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).withColumn("bucket", bucket_of(F.col("term"), index.buckets)))
    df = F.col("df")
    return t.join(in_buckets(index.terms, t), ["bucket", "term"]).select("query_id", "term", "bucket", (F.col("qtf") * F.log((index.n - df + 0.5) / (df + 0.5) + 1)).alias("weight"))


def in_buckets(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The partitions of a table that hold the words: at most ``buckets`` numbers come back."""
    wanted = [r[0] for r in terms.select("bucket").distinct().collect()]
    return table.where(F.col("bucket").isin(wanted))


def search(index: SearchIndex, queries: DataFrame, k: int = 50, first_blocks: int | None = None) -> DataFrame:
    """(query_id, doc_id, bm25, rank): the best ``k`` of each question, rank from 0, ties by id.

    The lists of the questions' words go to parts of the blocks; a part returns its best ``k`` of each question, so neither bounds
    nor scores are rows.
    """
    path = scratch_path(index.spark, "search")
    weights = question_terms(index, queries)
    weights.write.parquet(f"{path}/terms")
    weights = index.spark.read.schema(weights.schema).parquet(f"{path}/terms")
    parts = _parts(index.spark, max(1, -(-index.n // BLOCK_DOCS)))
    asked = weights.where("query_id is not null").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    chunks = max(1, -(-asked.count() // QUESTIONS))
    part = F.transform("postings", lambda p: share(p["tf"], p["dl"], index.avgdl, index.k1, index.b)).alias("share")
    left = (in_buckets(index.blocks, weights).join(weights.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
            .select("term", "block", "peak", F.col("postings.doc_id").alias("doc_id"), part, F.pmod("block", F.lit(parts)).cast("int").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c")))
    right = asked.withColumn("_c", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # enough blocks for k documents twice over, if their words were everywhere; fewer hits only lower the floor
    first = first_blocks or max(2, 2 * k // BLOCK_DOCS + 2)

    def cell(lists: pa.Table, questions: pa.Table) -> pa.Table:
        return best_of_blocks(lists, questions, k, first)

    best = left.groupBy("_p", "_c").cogroup(right.groupBy("_p", "_c")).applyInArrow(cell, f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {index.id_type}, bm25 double")
    best = best.withColumn("bm25", F.round("bm25", 9)).where(F.col("bm25") > 0)
    return top_n_per_group(best, "query_id", [F.desc("bm25"), F.asc("doc_id")], k, "rank").withColumn("rank", F.col("rank") - 1)


def best_of_blocks(lists: pa.Table, questions: pa.Table, k: int, first: int) -> pa.Table:
    """(query_id, doc_id, bm25): at least the best ``k`` documents of ``lists(term, block, peak, doc_id, share)`` for each row of
    ``questions(query_id, terms, weights)``.

    No document of a block scores more than the peaks of its words add up to. The ``first`` blocks of each question are scored,
    and of the others those that can reach the k-th best score of some question.
    """
    from tidemark.operators.retrieval import SCORE_CHUNK, best_scores

    block, at = np.unique(lists["block"].to_numpy(), return_inverse=True)
    peak, found = lists["peak"].to_numpy(), []
    for start in range(0, len(questions), SCORE_CHUNK):
        some = questions.slice(start, SCORE_CHUNK)
        words = some["terms"].combine_chunks()
        vocabulary = words.flatten().unique()
        row = np.repeat(np.arange(len(some)), pc.list_value_length(words).to_numpy())
        weight = np.zeros((len(vocabulary), len(some)))
        weight[pc.index_in(words.flatten(), vocabulary).to_numpy(), row] = some["weights"].combine_chunks().flatten().to_numpy()
        known = pc.index_in(lists["term"].combine_chunks(), vocabulary)
        held = np.asarray(known.is_valid().to_numpy(zero_copy_only=False), bool)
        peaks = np.zeros((len(block), len(vocabulary)))
        peaks[at[held], known.drop_null().to_numpy()] = peak[held]
        bound = peaks @ weight
        head = np.zeros(len(block), bool)
        head[np.argsort(-bound, axis=0, kind="stable")[:first].ravel()] = True
        near = best_scores(_postings(lists, held & head[at]), some, k)
        floor = _floor(near, some, k)
        rest = (bound >= floor - SLACK).any(1) & ~head
        found += [near, best_scores(_postings(lists, held & rest[at]), some, k)]
    return pa.concat_tables(found) if found else best_scores(_postings(lists, np.zeros(len(lists), bool)), questions, k)


def _postings(lists: pa.Table, wanted: np.ndarray) -> pa.Table:
    """(doc_id, term, share) of the wanted rows, one per posting."""
    some = lists.filter(pa.array(wanted))
    ids = some["doc_id"].combine_chunks()
    return pa.table({"doc_id": ids.flatten(), "term": some["term"].combine_chunks().take(pc.list_parent_indices(ids)), "share": some["share"].combine_chunks().flatten()})


def _floor(near: pa.Table, questions: pa.Table, k: int) -> np.ndarray:
    """The k-th best score of each question; 0 where there are fewer."""
    at, _ = _numbers(pa.chunked_array([questions["query_id"].combine_chunks().cast(near["query_id"].type), *near["query_id"].chunks]).combine_chunks())
    own, at = at[: len(questions)], at[len(questions) :]
    out = np.zeros(len(questions))
    score = near["bm25"].to_numpy()
    order = np.lexsort((-score, at))
    at, score = at[order], score[order]
    begin, end = np.searchsorted(at, own, "left"), np.searchsorted(at, own, "right")
    full = end - begin >= k
    out[full] = score[begin[full] + k - 1]
    return out


def opened(index: SearchIndex, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, blocks, opened): how many blocks hold a word of the question, and how many of them can reach its k-th score."""
    weights = question_terms(index, queries)
    bounds = in_buckets(index.blocks, weights).join(weights, ["bucket", "term"]).groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("peak")).alias("bound"))
    floor = search(index, queries, k).where(F.col("rank") == k - 1).select("query_id", F.col("bm25").alias("floor"))
    able = F.count_if(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK)
    return bounds.join(floor, "query_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), able.alias("opened"))
