"""BM25, dense search, rank fusion, boosts and the hybrid composition.

Questions are rows: ``queries(query_id, query)``.  One question or a million go
through the same plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.rules import Pack, contains_any, contains_word
from tidemark.functions.text import compact, tokens_retrieval
from tidemark.functions.vectors import mean_vector, zero_vector
from tidemark.operators.blocks import rows_per_block
from tidemark.operators.cells import Cells, best_inner, best_rows, matrix
from tidemark.operators.ordering import rank_bounded, source_diversity_cap, top_n_per_group
from tidemark.operators.search_index import SearchIndex, search

# Ranking constants.
K1, B = 1.5, 0.75
RRF_K = 60
POOL = 50
MIN_COSINE = 0.1
#: Scores of one part of the documents, and most parts.
PART_SCORES, MAX_PARTS = 2_000_000, 20_000
#: Questions scored at once, and numbers of one tile of documents.
SCORE_CHUNK, TILE_NUMBERS = 256, 2_000_000


# --- lexical ------------------------------------------------------------------------------

def search_text(*cols: Column) -> Column:
    """Fields joined with blanks, nulls as empty: what the index sees."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def search_fields() -> Column:
    """What hybrid search looks for words in."""
    return search_text(*[F.col(c) for c in ("title", "text", "source", "topic", "persona")], F.array_join("mentions_competitor", " "))


def build_index(docs: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(postings(term, doc_id, tf, dl), doc_stats(doc_id, dl)).

    Write the postings ``repartition``-ed by term to search them again later.
    """
    toks = docs.select(F.col(id_col).alias("doc_id"), tokens_retrieval(text).alias("_t")).withColumn("dl", F.size("_t"))
    postings = (toks.select("doc_id", "dl", F.explode("_t").alias("term"))
                .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    return postings.select("term", "doc_id", "tf", "dl"), toks.select("doc_id", "dl")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a repeated word counts as often as it occurs."""
    return (queries.select("query_id", F.explode(tokens_retrieval(F.col("query"))).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _weighed(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, k1: float, b: float) -> tuple[DataFrame, DataFrame, int]:
    """(postings(doc_id, dl, term, share), weights(query_id, term, weight), parts): a word adds weight x share to a score.

    Only words of the questions leave the scan: a semi join filters the exploded words. They are placed by document once.
    A part holds at most about ``PART_SCORES`` scores, whatever the documents and questions.
    Collection size and mean length come as one scalar subquery.
    """
    terms = query_terms(queries)
    toks = docs.select(F.col(id_col).alias("doc_id"), tokens_retrieval(text).alias("_t")).withColumn("dl", F.size("_t"))
    stats = toks.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl")).alias("s")).scalar()
    wanted = terms.select("term").distinct()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(-(-docs.count() * queries.count() // PART_SCORES), MAX_PARTS))
    postings = (toks.select("doc_id", "dl", F.explode("_t").alias("term"))
                .join(wanted, "term", "left_semi").repartition(parts, "doc_id")
                .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    df_n = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = stats["n"], F.greatest(stats["avgdl"], F.lit(1.0))
    weights = terms.join(df_n, "term").select("query_id", "term", (F.col("qtf") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("weight"))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return postings.select("doc_id", "dl", "term", share.alias("share")), weights, parts


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str, text: Column,
                k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, bm25) for every document with a positive score.

    Counting words, scoring and summing per question all group below the placement by document.
    """
    postings, weights, _ = _weighed(docs, queries, id_col, text, k1, b)
    return (postings.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("share")).alias("bm25"))
            .where(F.col("bm25") > 0))


def bm25_topk(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, k: int = POOL) -> DataFrame:
    """Scores are compared at nine decimals: equal documents may differ in the last bits by summation order.

    Every document is scored for every question, as products of a part of the documents with a chunk of the questions; a
    task keeps the best ``k`` per question, so scores are never rows.
    """
    postings, weights, parts = _weighed(docs, queries, id_col, text, K1, B)
    asked = weights.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    chunks = max(1, -(-queries.count() // SCORE_CHUNK))
    left = postings.select("doc_id", "term", "share", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c"))
    right = asked.withColumn("_c", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    id_type, query_type = docs.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def cell(words: pa.Table, questions: pa.Table) -> pa.Table:
        return best_scores(words, questions, k)

    best = left.groupBy("_p", "_c").cogroup(right.groupBy("_p", "_c")).applyInArrow(cell, f"query_id {query_type}, doc_id {id_type}, bm25 double")
    return rank_list(best.withColumn("bm25", F.round("bm25", 9)), "bm25", k)


def _nullable(t: pa.DataType) -> pa.DataType:
    return pa.struct([(f.name, _nullable(f.type)) for f in t]) if pa.types.is_struct(t) else t


def best_scores(words: pa.Table, questions: pa.Table, k: int) -> pa.Table:
    """(query_id, doc_id, bm25): the best ``k`` documents of ``words(doc_id, term, share)`` for each row of
    ``questions(query_id, terms, weights)``, ties by id; documents without a word of the question are left out."""
    lists = questions["terms"].combine_chunks()
    vocabulary = lists.flatten().unique()
    at = pc.index_in(words["term"].combine_chunks(), vocabulary)
    words, at = words.filter(at.is_valid()), at.drop_null().to_numpy()
    ids = words["doc_id"].combine_chunks()
    named = ids.unique()
    named = named.take(pc.sort_indices(named, null_placement="at_start"))  # documents count up with their ids
    doc = pc.index_in(ids, named).to_numpy()
    share = words["share"].to_numpy()
    order = np.argsort(doc, kind="stable")
    doc, at, share = doc[order], at[order], share[order]
    n, width = len(questions), max(len(vocabulary), 1)
    weight = np.zeros((width, n))
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    weight[pc.index_in(lists.flatten(), vocabulary).to_numpy(), row] = questions["weights"].combine_chunks().flatten().to_numpy()
    best, who = np.zeros((0, n)), np.zeros((0, n), np.int64)
    tile = max(1, TILE_NUMBERS // max(width, n))
    for start in range(0, len(named), tile):
        lo, hi = np.searchsorted(doc, [start, start + tile])
        rows = min(tile, len(named) - start)
        held = np.bincount((doc[lo:hi] - start).astype(np.int64) * width + at[lo:hi], weights=share[lo:hi], minlength=rows * width).reshape(rows, width)
        scores = held @ weight
        scores = np.vstack([best, np.where(scores > 0, np.round(scores, 9), -1.0)])
        which = np.vstack([who, np.repeat(np.arange(start, start + rows)[:, None], n, 1)])
        top = np.argsort(-scores, axis=0, kind="stable")[:k]
        best, who = np.take_along_axis(scores, top, 0), np.take_along_axis(which, top, 0)
    i, q = np.nonzero(best >= 0)
    asked = questions["query_id"].combine_chunks()
    # a struct may come with fields that are never null, which the result's type does not say
    asked = pa.array(asked.to_pylist(), _nullable(asked.type)) if pa.types.is_struct(asked.type) else asked
    return pa.table({"query_id": asked.take(pa.array(q)), "doc_id": named.take(pa.array(who[i, q])), "bm25": best[i, q]})


def rank_list(scored: DataFrame, score: str, k: int = POOL) -> DataFrame:
    """0-based position per query, best first, ties by id; cut at ``k``."""
    ranked = top_n_per_group(scored, "query_id", [F.desc(score), F.asc("doc_id")], k, "rank")
    return ranked.withColumn("rank", F.col("rank") - 1)


# --- dense -----------------------------------------------------------------------------------

QUERY_CHUNK = 4_096


def dense_topk(vectors: "DataFrame | Cells", query_vectors: DataFrame, k: int = POOL, min_sim: float = MIN_COSINE,
               chunk_rows: int = QUERY_CHUNK, block_rows: int = 20_000) -> DataFrame:
    """(query_id, doc_id, sim, rank): inner product above ``min_sim``, best ``k`` per query.

    ``vectors(doc_id, vec)``, ``query_vectors(query_id, vec)``, unit length. Vectors dealt to cells before
    (``cells.build_cells``) are searched best cell first with an exact stopping bound; plain vectors are all compared, in
    hashed chunks of questions and blocks of vectors. A task keeps its best ``k`` before anything is shuffled; there is
    one plan for any number of questions.
    """
    if isinstance(vectors, Cells):
        part = best_inner(vectors, query_vectors, k, min_sim, chunk=chunk_rows)
    else:
        part = _grid_topk(vectors, query_vectors, k, min_sim, chunk_rows, block_rows)
    return rank_list(part, "sim", k)


def _grid_topk(vectors: DataFrame, queries: DataFrame, k: int, min_sim: float, chunk_rows: int, block_rows: int) -> DataFrame:
    q, v = queries.select("query_id", "vec").where("vec is not null"), vectors.select("doc_id", "vec").where("vec is not null")
    # never more than MAX_BLOCKS chunks a side while they hold BLOCK_ROWS rows or fewer, so copies grow with the input
    of = lambda df, rows: F.greatest(df.agg(F.ceil(F.count(F.lit(1)) / rows_per_block(F.count(F.lit(1)), rows))).scalar(), F.lit(1)).cast("int")
    n_q, n_v = of(q, chunk_rows), of(v, block_rows)
    q = q.withColumn("_q", F.pmod(F.xxhash64("query_id"), n_q).cast("int")).withColumn("_v", F.explode(F.sequence(F.lit(0), n_v - 1)))
    v = v.withColumn("_v", F.pmod(F.xxhash64("doc_id"), n_v).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), n_q - 1)))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "doc_id": [], "sim": []})
        return best_rows(left["query_id"].to_numpy(), matrix(left["vec"]), right["doc_id"].to_numpy(), matrix(right["vec"]), k, min_sim)

    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, sim double"
    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInPandas(cell, types)


def max_similarity(vectors: DataFrame, exemplars: DataFrame, scale: float = 100.0) -> DataFrame:
    """(doc_id, semantic): largest inner product with any exemplar, times ``scale``; no row for a null vector.

    The vectors are the questions here and the exemplars what is searched, in the same grid of chunks and blocks.
    """
    asked = vectors.select(F.col("doc_id").alias("query_id"), "vec")
    top = _grid_topk(exemplars.select(F.col("query_id").alias("doc_id"), "vec"), asked, 1, float("-inf"), 20_000, QUERY_CHUNK)
    return top.groupBy(F.col("query_id").alias("doc_id")).agg((F.max("sim") * scale).alias("semantic"))


def proxy_query_vector(bm25_ranked: DataFrame, vectors: DataFrame, n: int = 5) -> DataFrame:
    """Question vector without an encoder: unit mean of the vectors of its best lexical hits."""
    top = bm25_ranked.where(F.col("rank") < n).select("query_id", "doc_id")
    return mean_vector(top.join(vectors, "doc_id"), ["query_id"], "vec", "vec")


def align_vectors(rows: DataFrame, vectors: DataFrame, dim: int, key: str = "fingerprint") -> DataFrame:
    """Left join on the fingerprint; rows without a vector get zeros and ``matched = false``; of repeated keys the largest vector counts."""
    v = vectors.groupBy(key).agg(F.max("vec").alias("_v"))
    return (rows.join(v, key, "left").withColumn("matched", F.col("_v").isNotNull())
            .withColumn("vec", F.coalesce(F.col("_v"), zero_vector(dim))).drop("_v"))


# --- fusion ------------------------------------------------------------------------------------

def rrf_fuse(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf) from ranked lists (query_id, doc_id, rank)."""
    lists = [r.select("query_id", "doc_id", "rank") for r in ranked]
    union = lists[0]
    for r in lists[1:]:
        union = union.unionByName(r)
    return union.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.col("rank") + (k + 1))).alias("rrf"))


def merge_variants(ranked: DataFrame, k: int = POOL * 2) -> DataFrame:
    """One list per query from several variants' lists: earlier variants first, first occurrence counts.

    Lists are bounded by the pool, so the window holds a few hundred rows per query.
    """
    first = ranked.groupBy("query_id", "doc_id").agg(F.min(F.struct("variant", "rank")).alias("_p"))
    flat = first.select("query_id", "doc_id", F.col("_p.variant").alias("variant"), F.col("_p.rank").alias("_r"))
    out = top_n_per_group(flat, "query_id", [F.asc("variant"), F.asc("_r")], k, "rank")
    return out.select("query_id", "doc_id", (F.col("rank") - 1).alias("rank"))


def expand_query(queries: DataFrame, expansions: Pack, limit: int = 2) -> DataFrame:
    """(query_id, variant, query): the question itself and the first triggered expansion appended.

    Rules carry the appended words in ``attrs['expansion']``; rule order decides.
    """
    lo = F.lower(F.col("query"))
    text = None
    for rule in expansions.rules:
        extra = dict(rule.attrs)["expansion"]
        hit = contains_any(lo, rule.substr or (rule.label,))
        text = F.when(hit, F.lit(extra)) if text is None else text.when(hit, F.lit(extra))
    extra = text if text is not None else F.lit(None).cast("string")
    variants = compact(F.array(
        F.col("query"), F.when(extra.isNotNull(), F.concat_ws(" ", F.col("query"), extra))))
    return queries.select("query_id", F.posexplode(F.slice(variants, 1, limit)).alias("variant", "query"))


def topic_variants(queries: DataFrame, expansions: Pack, context_words: list[str], domain_words: list[str],
                   both: list[str], domain_only: list[str], limit: int = 6) -> DataFrame:
    """Up to ``limit`` distinct search variants of a topic.

    The topic, its quoted form when it has several words, the phrases of the first
    triggered expansion (``attrs['phrases']``, ``;``-separated), then context suffixes
    when the topic lacks them.
    """
    q, lo = F.col("query"), F.lower(F.col("query"))
    phrases = None
    for rule in expansions.rules:
        arr = F.array(*[F.lit(p.strip()) for p in dict(rule.attrs)["phrases"].split(";")])
        hit = contains_any(lo, rule.substr or (rule.label,))
        phrases = F.when(hit, arr) if phrases is None else phrases.when(hit, arr)
    phrases = F.coalesce(phrases, F.array().cast("array<string>")) if phrases is not None else F.array().cast("array<string>")
    quoted = F.when(F.size(F.split(F.trim(lo), r"\s+")) >= 2, F.concat(F.lit('"'), q, F.lit('"')))
    has_ctx, has_dom = contains_any(lo, context_words), contains_any(lo, domain_words)
    suffix = (F.when(~has_ctx & ~has_dom, F.array(*[F.concat_ws(" ", q, F.lit(s)) for s in both]))
              .when(~has_ctx, F.array(*[F.concat_ws(" ", q, F.lit(s)) for s in domain_only]))
              .otherwise(F.array().cast("array<string>")))
    every = compact(F.concat(F.array(q, quoted), phrases, suffix))
    keyed = F.transform(every, lambda s, i: F.struct(F.lower(F.trim(s)).alias("k"), i.alias("i"), s.alias("s")))
    # First occurrence per folded text, at most a dozen entries per row.
    firsts = F.filter(keyed, lambda e: ~F.exists(keyed, lambda o: (o["k"] == e["k"]) & (o["i"] < e["i"])))
    return queries.select("query_id", F.posexplode(F.slice(F.transform(firsts, lambda e: e["s"]), 1, limit)).alias("variant", "query"))


# --- boosts ---------------------------------------------------------------------------------------

def signal_boosts(lo_query: Column, as_of: Column, packs: dict[str, Pack], text: Column, source: Column,
                  strength: Column, score: Column, day: Column, competitors: Column) -> Column:
    """Additive boost of one candidate for one question.

    ``packs`` holds the word lists: review_words, persona_words, competitive_words,
    review_sources, community_sources, news_sources, competitor_names, breaking_terms.
    """
    words = {name: [t for r in pack.rules for t in r.substr] for name, pack in packs.items()}
    src = F.lower(F.coalesce(source, F.lit("")))
    review, persona, competitive = (contains_any(lo_query, words[n]) for n in ("review_words", "persona_words", "competitive_words"))
    strength, score = F.coalesce(strength, F.lit(0)), F.coalesce(score, F.lit(0))
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    boost = F.when(strength > 60, 0.02).when(strength > 30, 0.01).otherwise(0.0)
    boost = boost + F.when(score >= 50, 0.015).when(score >= 10, 0.005).otherwise(0.0)
    boost = boost + (F.when(day >= F.date_sub(as_of, 30), 0.03).when(day >= F.date_sub(as_of, 90), 0.015)
                     .when(day >= F.date_sub(as_of, 365), 0.0).otherwise(-0.02))
    boost = boost + add(review & contains_any(src, words["review_sources"]), 0.03)
    boost = boost + add(persona & src.isin(*words["community_sources"]), 0.02)
    boost = boost + add(competitive & (F.size(competitors) > 0), 0.025)
    boost = boost + add(competitive & contains_any(src, words["news_sources"]), 0.035)
    for name in words["competitor_names"]:
        boost = boost + add(competitive & lo_query.contains(name) & src.contains(name), 0.04)
    return boost + add(competitive & contains_any(text, words["breaking_terms"]), 0.06)


def hybrid_search(docs: DataFrame, queries: DataFrame, vectors: DataFrame | None, packs: dict[str, Pack], as_of: Column,
                  k: int = 25, pool: int = POOL, max_per_source: int = 15, id_col: str = "post_id",
                  query_vectors: DataFrame | None = None, index: "SearchIndex | None" = None) -> DataFrame:
    """Expansion, BM25 and dense lists, fusion, boosts, source cap.

    With a stored ``index`` of ``search_fields(docs)`` no text is split into words here; only the candidates' rows are read.

    ``docs`` needs id, text, title, source, topic, persona, signal_strength, score,
    post_date and mentions_competitor.  Only the fused candidates (at most twice the
    pool per question and list) are joined back to the wide rows.
    """
    variants = expand_query(queries, packs["expansions"])
    vkey = F.struct("query_id", "variant")
    vq = variants.withColumn("query_id", vkey)
    lexical = search(index, vq, pool) if index else bm25_topk(docs, vq, id_col, search_fields(), pool)
    # The candidates feed several branches; they are small and written once.
    split = lambda r: r.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.variant").alias("variant"), "doc_id", "rank")
    lists = [merge_variants(split(lexical), pool * 2)]
    if vectors is not None:
        if query_vectors is None:
            proxy = proxy_query_vector(lexical, vectors)
            # The search takes plain numbers as ids; the variants, a few per question, give the pair back.
            key = lambda q, v: F.xxhash64(F.col(q), F.col(v))
            flat = proxy.select(key("query_id.query_id", "query_id.variant").alias("query_id"), "vec")
            names = variants.select(key("query_id", "variant").alias("_key"), "query_id", "variant").distinct()
            dense = dense_topk(vectors, flat, pool).withColumnRenamed("query_id", "_key").join(names, "_key").select("query_id", "variant", "doc_id", "rank")
        else:
            dense = dense_topk(vectors, query_vectors, pool).select("query_id", F.lit(0).alias("variant"), "doc_id", "rank")
        lists.append(merge_variants(dense, pool * 2))
    fused = rrf_fuse(*lists)
    cand = (fused.join(docs.withColumnRenamed(id_col, "doc_id"), "doc_id")
            .join(queries.select("query_id", F.lower("query").alias("_q")), "query_id"))
    lo_text = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))))
    boost = signal_boosts(F.col("_q"), as_of, packs, lo_text, F.col("source"), F.col("signal_strength"),
                          F.col("score"), F.col("post_date"), F.col("mentions_competitor"))
    scored = cand.withColumn("retrieval_score", F.round(F.col("rrf") + boost, 9)).drop("_q")
    return source_diversity_cap(scored, ["query_id"], "source", [F.desc("retrieval_score"), F.asc("doc_id")],
                                max_per_source, k)


# --- keyword fallback ---------------------------------------------------------------------------------

def keyword_scores(df: DataFrame, query: str, packs: dict[str, Pack], text: Column, topic: Column, source: Column,
                   competitor: Column, entity: Column, strength: Column, score: Column) -> Column:
    """Additive score of one question over every row; the expanded terms are literals."""
    words = {name: [t for r in pack.rules for t in r.substr] for name, pack in packs.items()}
    q = query.lower()
    terms = {w for w in q.split() if len(w) > 2}
    for rule in packs["term_expansions"].rules:
        if rule.label in q:
            terms.update(rule.substr)
    exact = set(words["exact_terms"])
    has = lambda name: any(t in q for t in words[name])
    pts = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0))
    total = F.lit(0)
    for term in sorted(t for t in terms if len(t) > 2):
        if term in exact:
            total = total + pts(contains_word(text, [term]), 6) + pts(competitor.contains(term), 8) + pts(entity.contains(term), 8)
        else:
            total = total + pts(text.contains(term), 2) + pts(topic.contains(term), 4) + pts(source.contains(term), 2)
    total = total + F.when(strength > 60, 3).when(strength > 30, 1).otherwise(0)
    total = total + F.when(score >= 50, 2).when(score >= 10, 1).otherwise(0)
    community = source.isin(*words["community_sources"])
    review_src = contains_any(source, words["review_sources"])
    if has("review_question"):
        total = total + pts(review_src, 5) + pts(community, 3)
    if has("persona_question"):
        total = total + pts(community, 3)
    if has("fee_question"):
        total = total + pts(contains_any(text, words["fee_terms"]), 3)
    if has("subsidiary_words"):
        total = total + pts(review_src, 6) + pts(community, 3)
    total = total - pts((score == 0) & (F.length(text) < 100), 3)
    if has("competitive_question"):
        total = total + pts(contains_any(source, words["news_sources"]), 4) + pts(contains_any(text, words["breaking_terms"]), 6)
    return total


def keyword_search(df: DataFrame, query: str, packs: dict[str, Pack], k: int = 25, max_per_source: int = 24,
                   pos: str = "pos") -> DataFrame:
    """Top rows of the additive scorer: positive, not promotional, capped per source."""
    lo = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    base = df.withColumn("_lo", lo)
    scored = base.withColumn("relevance", keyword_scores(
        base, query, packs, F.col("_lo"), low("topic"), low("source"), low("competitor"), low("entity_name"),
        F.col("signal_strength"), F.col("score")))
    kept = scored.where((F.col("relevance") > 0) & ~contains_any(F.col("_lo"), [t for r in packs["promotional"].rules for t in r.substr]))
    return source_diversity_cap(kept.drop("_lo"), [], "source", [F.desc("relevance"), F.asc(pos)], max_per_source, k)


def stratified_topics(df: DataFrame, topic: str = "topic", persona: str = "persona", strength: str = "signal_strength",
                      score: str = "score", pos: str = "pos", n_topics: int = 20, per_topic: int = 2,
                      personas: list[str] | None = None, limit: int = 40) -> DataFrame:
    """The two strongest rows of each frequent topic plus the strongest row of each named persona, with their ``rank``."""
    named = df.where(F.col(topic).isNotNull() & ~F.col(topic).isin("General", ""))
    top = named.groupBy(topic).count().orderBy(F.desc("count"), F.asc(topic)).limit(n_topics)
    ranked_topics = rank_bounded(top, [F.desc("count"), F.asc(topic)], "_t").select(topic, "_t")
    by_topic = df.join(F.broadcast(ranked_topics), topic)
    best = top_n_per_group(by_topic, topic, [F.desc(F.col(strength) + F.col(score)), F.asc(pos)], per_topic, "_i")
    people = df.where(F.col(persona).isin(*(personas or [])))
    extra = top_n_per_group(people, persona, [F.desc(strength), F.asc(pos)], 1).join(best.select(pos), pos, "left_anti")
    order = F.array_position(F.array(*[F.lit(p) for p in (personas or [""])]), F.col(persona))
    out = best.unionByName(extra.withColumn("_t", F.lit(1_000) + order.cast("int")).withColumn("_i", F.lit(1)))
    return rank_bounded(out.orderBy("_t", "_i").limit(limit), ["_t", "_i"], "rank").drop("_t", "_i")


# --- vectors from text ----------------------------------------------------------------------------------

def vectorize_texts(df: DataFrame, text: Column, id_col: str, dim: int = 4096) -> DataFrame:
    """Unit TF-IDF vectors over hashed words (Spark ML); a model of one's own plugs in through ``embed_with``."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    words = df.select(F.col(id_col), tokens_retrieval(text).alias("_w"))
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(words)
    tfidf = IDF(inputCol="_tf", outputCol="_x").fit(tf).transform(tf)
    return Normalizer(inputCol="_x", outputCol="features").transform(tfidf).select(id_col, "features")


def embed_with(df: DataFrame, text: Column, id_col: str, encode, normalize: bool = True) -> DataFrame:
    """``encode(list[str]) -> matrix`` runs once per Arrow batch on the executors."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            mat = np.asarray(encode(pdf["_text"].fillna("").tolist()), dtype=np.float32)
            if normalize:
                size = np.linalg.norm(mat, axis=1, keepdims=True)
                mat = mat / np.where(size > 0, size, 1)
            yield pd.DataFrame({id_col: pdf[id_col], "vec": list(mat)})

    return df.select(F.col(id_col), text.alias("_text")).mapInPandas(run, f"{id_col} {id_type}, vec array<float>")
