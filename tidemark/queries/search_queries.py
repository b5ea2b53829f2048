"""Retrieval and clustering (group R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import PRIME, hash_family
from tidemark.functions.text import STOP_COHERENCE, STOP_QUALITY
from tidemark.functions.vectors import norm
from tidemark.operators import clustering as cl, encoder, retrieval as rt, search_index as si
from tidemark.operators.cells import build_cells, met_blocks, near_blocks
from tidemark.queries.base import AS_OF, INSIGHTS, P, POSTS, as_of, insights, posts, q, query, sql_any, sql_labels, sql_pack, table
from tidemark.queries.label_queries import WORKSTREAM, with_workstream
from tidemark.queries.text_queries import TOK_BM25
from tidemark.session import cut_lineage

R6 = lambda c: F.round(c, 6)
_words = lambda name: [t for r in P[name].rules for t in r.substr]


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOKQ = TOK_BM25.replace("lower(text)", "lower(query)")
BM25 = f"""qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKQ}) AS term FROM qs) GROUP BY 1, 2),
dt AS (SELECT doc_id, {TOK_BM25} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(t)), 1) AS avgdl FROM dt), pt AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df FROM pt GROUP BY 1), bm AS (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qt JOIN pt USING (term) JOIN dfs USING (term), st GROUP BY 1, 2 HAVING bm25 > 0)"""
_RANKED = "bk AS (SELECT * FROM (SELECT query_id, doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) - 1 AS rank FROM bm) WHERE rank < 50)"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("bm25_scores", f"WITH {BM25} SELECT query_id, count(*) AS n, round(sum(bm25), 5) AS total FROM bm GROUP BY 1")
def _bm25(spark, sf):
    s = rt.bm25_scores(_docs(spark, sf), questions(spark, sf), "doc_id", F.col("text"))
    return s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bm25"), 5).alias("total"))


@query("bm25_topk", f"WITH {BM25}, {_RANKED} SELECT query_id, doc_id, rank FROM bk")
def _topk(spark, sf):
    return rt.bm25_topk(_docs(spark, sf), questions(spark, sf), "doc_id", F.col("text")).select("query_id", "doc_id", "rank")


@query("bm25_topk_stored", f"WITH {BM25}, {_RANKED} SELECT query_id, doc_id, rank FROM bk")
def _topk_stored(spark, sf):
    """The same from a stored index: written once, then searched by partitions of words with block maxima."""
    return si.search(si.write_index(_docs(spark, sf), "doc_id", F.col("text")), questions(spark, sf)).select("query_id", "doc_id", "rank")


@query("bm25_index", f"WITH {BM25} SELECT (SELECT count(*) FROM pt) AS postings, (SELECT count(*) FROM dfs) AS terms, (SELECT CAST(sum(len(t)) AS BIGINT) FROM dt) AS tokens, (SELECT max(df) FROM dfs) AS max_df")
def _index(spark, sf):
    postings, docs = rt.build_index(_docs(spark, sf), "doc_id", F.col("text"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    t = df.agg(F.sum("df").alias("postings"), F.count(F.lit(1)).alias("terms"), F.max("df").alias("max_df"))
    return t.select("postings", "terms", docs.agg(F.sum("dl").cast("bigint")).scalar().alias("tokens"), "max_df")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


_DENSE = """dp AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM (SELECT * FROM embeddings WHERE vec_id % 10 = 3) a, embeddings b),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) - 1 AS rank FROM dp WHERE sim > 0.1) WHERE rank < 50)"""


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, doc_id, rank, round(sim, 6) AS sim FROM dk")
def _dense(spark, sf):
    v = _vectors(spark, sf)
    qv = v.where("doc_id % 10 = 3").select(F.col("doc_id").alias("query_id"), "vec")
    return rt.dense_topk(v, qv).withColumn("sim", R6(F.col("sim")))


@query("dense_topk_grid", f"WITH {_DENSE} SELECT query_id, doc_id, rank, round(sim, 6) AS sim FROM dk")
def _dense_grid(spark, sf):
    """The same through many chunks of questions and blocks of vectors."""
    v = _vectors(spark, sf)
    qv = v.where("doc_id % 10 = 3").select(F.col("doc_id").alias("query_id"), "vec")
    return rt.dense_topk(v, qv, chunk_rows=16, block_rows=200).withColumn("sim", R6(F.col("sim")))


@query("dense_topk_cells", f"WITH {_DENSE} SELECT query_id, doc_id, rank, round(sim, 6) AS sim FROM dk")
def _dense_cells(spark, sf):
    """The same through cells, best first, stopping when no cell can hold a better vector."""
    v = _vectors(spark, sf)
    qv = v.where("doc_id % 10 = 3").select(F.col("doc_id").alias("query_id"), "vec")
    return rt.dense_topk(build_cells(v, [], "doc_id", block_rows=500), qv).withColumn("sim", R6(F.col("sim")))


@query("near_blocks", "SELECT CAST(count(*) AS BIGINT) AS vectors, true AS complete FROM embeddings")
def _near_blocks(spark, sf):
    """Every vector is in one block, and every pair within eps lies in a pair of blocks that is compared."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    cells = build_cells(v, [], "id", block_rows=200)
    met = near_blocks(cells, 0.62)
    lost = met_blocks(cells.rows, 0.62).join(met, ["_lo", "_hi"], "left_anti")
    return cells.rows.agg(F.count_distinct("id").alias("vectors")).withColumn("complete", F.lit(lost.agg(F.count(F.lit(1))).scalar() == 0))


@query("proxy_query_vector", f"""WITH {BM25}, {_RANKED}, v AS (SELECT query_id, i, avg(x::DOUBLE) AS m FROM (SELECT query_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM bk JOIN embeddings e ON e.vec_id = bk.doc_id WHERE rank < 5) GROUP BY 1, 2),
w AS (SELECT query_id, i, m / sqrt(sum(m * m) OVER (PARTITION BY query_id)) AS m FROM v) SELECT query_id, round(max(m), 5) AS hi, round(min(m), 5) AS lo FROM w GROUP BY 1""")
def _proxy(spark, sf):
    ranked = rt.bm25_topk(_docs(spark, sf), questions(spark, sf), "doc_id", F.col("text"))
    p = rt.proxy_query_vector(ranked, _vectors(spark, sf))
    return p.select("query_id", F.round(F.array_max("vec"), 5).alias("hi"), F.round(F.array_min("vec"), 5).alias("lo"))


_LIST_A = "la AS (SELECT * FROM (SELECT event_type AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS rank FROM events) WHERE rank < 50)"
_LIST_B = "lb AS (SELECT * FROM (SELECT event_type AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY event_type ORDER BY value * (user_id % 7) DESC, event_id) - 1 AS rank FROM events) WHERE rank < 50)"


@query("rrf_fuse", f"WITH {_LIST_A}, {_LIST_B} SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS rrf FROM (SELECT * FROM la UNION ALL SELECT * FROM lb) GROUP BY 1, 2")
def _rrf(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("doc_id"), "value", "user_id")
    a = rt.rank_list(e, "value", 50)
    b = rt.rank_list(e.withColumn("value", F.col("value") * (F.col("user_id") % 7)), "value", 50)
    return rt.rrf_fuse(a, b).withColumn("rrf", F.round("rrf", 9))


_EXP = P["expansions"].rules
_EXT = "CASE " + " ".join(f"WHEN contains(lower(text), {q(r.label)}) THEN {q(dict(r.attrs)['expansion'])}" for r in _EXP) + " END"


@query("expand_query", f"SELECT item_id AS query_id, 0 AS variant, md5(text) AS query FROM benchmark UNION ALL SELECT item_id, 1, md5(text || ' ' || {_EXT}) FROM benchmark WHERE {_EXT} IS NOT NULL")
def _expand(spark, sf):
    return rt.expand_query(questions(spark, sf), P["expansions"]).withColumn("query", F.md5("query"))


@query("topic_variants", """WITH b AS (SELECT item_id AS query_id, text AS t, lower(text) AS lo FROM benchmark), p AS (SELECT *, CASE WHEN contains(lo, 'with') THEN ['thing one', 'thble two', 'The Thing'] WHEN contains(lo, 'that') THEN ['onhe three'] ELSE [] END AS ph,
CASE WHEN NOT contains(lo, 'thwh') AND NOT contains(lo, 'thble') THEN [t || ' cards', t || ' shop'] WHEN NOT contains(lo, 'thwh') THEN [t || ' shop'] ELSE [] END AS sx FROM b),
v AS (SELECT query_id, ([t] || CASE WHEN len(string_split_regex(trim(lo), '\\s+')) >= 2 THEN ['"' || t || '"'] ELSE [] END || ph || sx)[1:6] AS l FROM p) SELECT query_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS variant, md5(unnest(l)) AS query FROM v""")
def _variants(spark, sf):
    return rt.topic_variants(questions(spark, sf), P["topic_phrases"], ["thwh"], ["thble"], ["cards", "shop"], ["shop"]).withColumn("query", F.md5("query"))


def _boost_sql(query: str = "qlo") -> str:
    add = lambda cond, v: f"CASE WHEN {cond} THEN {v} ELSE 0 END"
    rev, per, com = (sql_any(query, _words(n)) for n in ("review_words", "persona_words", "competitive_words"))
    d = lambda n: f"DATE '{AS_OF}' - INTERVAL {n} DAY"
    parts = ["CASE WHEN signal_strength > 60 THEN 0.02 WHEN signal_strength > 30 THEN 0.01 ELSE 0 END", "CASE WHEN score >= 50 THEN 0.015 WHEN score >= 10 THEN 0.005 ELSE 0 END",
             f"CASE WHEN post_date >= {d(30)} THEN 0.03 WHEN post_date >= {d(90)} THEN 0.015 WHEN post_date >= {d(365)} THEN 0 ELSE -0.02 END",
             add(f"{rev} AND {sql_any('source', _words('review_sources'))}", 0.03), add(f"{per} AND source IN ({', '.join(q(s) for s in _words('community_sources'))})", 0.02),
             add(f"{com} AND n_comp > 0", 0.025), add(f"{com} AND {sql_any('source', _words('news_sources'))}", 0.035)]
    parts += [add(f"{com} AND contains({query}, {q(n)}) AND contains(source, {q(n)})", 0.04) for n in _words("competitor_names")]
    parts.append(add(f"{com} AND {sql_any('blo', _words('breaking_terms'))}", 0.06))
    return "(" + " + ".join(parts) + ")::DOUBLE"


_BASE = f"bi AS (SELECT *, len({sql_labels('competitors', 'tlo')}) AS n_comp, lower(text || ' ' || title) AS blo FROM insights)"


def _search_docs(spark, sf):
    from tidemark.operators.enrich import mentions

    return insights(spark, sf).withColumn("mentions_competitor", mentions(F.lower("text"), P)["mentions_competitor"])


@query("signal_boosts", f"WITH {INSIGHTS}, {_BASE} SELECT post_id, round({_boost_sql(q('is the thing with src1 better'))}, 6) AS boost FROM bi")
def _boosts(spark, sf):
    d = _search_docs(spark, sf).withColumn("blo", F.lower(F.concat_ws(" ", "text", "title")))
    b = rt.signal_boosts(F.lit("is the thing with src1 better"), as_of(), P, F.col("blo"), F.col("source"), F.col("signal_strength"), F.col("score"), F.col("post_date"), F.col("mentions_competitor"))
    return d.select("post_id", R6(b).alias("boost"))


_LEX_TEXT = "title || ' ' || text || ' ' || source || ' ' || topic || ' ' || persona || ' ' || array_to_string(mc, ' ')"


_HYBRID_SQL = f"""WITH {INSIGHTS}, {_BASE}, dx AS (SELECT *, {_LEX_TEXT} AS full_text FROM (SELECT *, list_sort({sql_labels('competitors', 'tlo')}) AS mc FROM bi)), qs AS (SELECT item_id AS query_id, text AS query, lower(text) AS qlo FROM benchmark),
qv AS (SELECT query_id, 0 AS variant, query FROM qs UNION ALL SELECT query_id, 1, query || ' ' || ext FROM (SELECT query_id, query, {_EXT.replace('lower(text)', 'qlo')} AS ext FROM qs) WHERE ext IS NOT NULL),
qt AS (SELECT query_id, variant, term, count(*) AS qtf FROM (SELECT query_id, variant, unnest({_TOKQ}) AS term FROM qv) GROUP BY 1, 2, 3), dt AS (SELECT post_id AS doc_id, {TOK_BM25.replace('lower(text)', 'lower(full_text)')} AS t FROM dx),
st AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(t)), 1) AS avgdl FROM dt), pt AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY 1, 2, 3), dfs AS (SELECT term, count(*) AS df FROM pt GROUP BY 1),
bm AS (SELECT query_id, variant, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qt JOIN pt USING (term) JOIN dfs USING (term), st GROUP BY 1, 2, 3),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY round(bm25, 9) DESC, doc_id) - 1 AS r FROM bm) WHERE r < 50), fi AS (SELECT query_id, doc_id, min(variant * 1000 + r) AS o FROM bk GROUP BY 1, 2),
mg AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS rank FROM fi), sc AS (SELECT query_id, doc_id, source, round(1.0::DOUBLE / (61 + rank) + {_boost_sql()}, 9) AS s FROM mg JOIN bi ON bi.post_id = mg.doc_id JOIN qs USING (query_id) WHERE rank < 100),
cp AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY s DESC, doc_id) AS rs FROM sc), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM cp WHERE rs <= 3)
SELECT query_id, doc_id, rank, round(s, 6) AS retrieval_score FROM fr WHERE rank <= 25"""


_FUSED = _HYBRID_SQL[: _HYBRID_SQL.index(", sc AS (")] + f""",
pv AS (SELECT query_id, variant, i, avg(x::DOUBLE) AS m FROM (SELECT query_id, variant, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM bk JOIN embeddings e ON e.vec_id = bk.doc_id WHERE r < 5) GROUP BY 1, 2, 3),
pu AS (SELECT query_id, variant, list(m / size ORDER BY i) AS v FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY query_id, variant)) AS size FROM pv) GROUP BY 1, 2),
dd AS (SELECT query_id, variant, vec_id AS doc_id, list_dot_product(v, embedding::DOUBLE[]) AS sim FROM pu, embeddings), db AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY sim DESC, doc_id) - 1 AS r FROM dd WHERE sim > 0.1) WHERE r < 50),
md AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS rank FROM (SELECT query_id, doc_id, min(variant * 1000 + r) AS o FROM db GROUP BY 1, 2)),
rr AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (61 + rank)) AS rrf FROM (SELECT query_id, doc_id, rank FROM mg UNION ALL SELECT query_id, doc_id, rank FROM md) WHERE rank < 100 GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, source, round(rrf + {_boost_sql()}, 9) AS s FROM rr JOIN bi ON bi.post_id = rr.doc_id JOIN qs USING (query_id)),
cp AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY s DESC, doc_id) AS rs FROM sc), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM cp WHERE rs <= 15)
SELECT query_id, doc_id, source, rank, round(s, 6) AS retrieval_score FROM fr WHERE rank <= 25"""


@query("hybrid_search", _FUSED)
def _hybrid(spark, sf):
    docs = cut_lineage(_search_docs(spark, sf).select("post_id", "text", "title", "source", "topic", "persona", "signal_strength", "score", "post_date", "mentions_competitor"))
    out = rt.hybrid_search(docs, questions(spark, sf), _vectors(spark, sf), P, as_of())
    return out.select("query_id", "doc_id", "source", R6(F.col("retrieval_score")).alias("retrieval_score"), "rank")


@query("hybrid_search_lexical", _HYBRID_SQL)
def _hybrid_lexical(spark, sf):
    docs = cut_lineage(_search_docs(spark, sf).select("post_id", "text", "title", "source", "topic", "persona", "signal_strength", "score", "post_date", "mentions_competitor"))
    out = rt.hybrid_search(docs, questions(spark, sf), None, P, as_of(), max_per_source=3)
    return out.select("query_id", "doc_id", "rank", R6(F.col("retrieval_score")).alias("retrieval_score"))


@query("hybrid_search_stored", _HYBRID_SQL)
def _hybrid_stored(spark, sf):
    """The same from a stored index of the collection."""
    docs = cut_lineage(_search_docs(spark, sf).select("post_id", "text", "title", "source", "topic", "persona", "signal_strength", "score", "post_date", "mentions_competitor"))
    index = si.write_index(docs, "post_id", rt.search_fields())
    out = rt.hybrid_search(docs, questions(spark, sf), None, P, as_of(), max_per_source=3, index=index)
    return out.select("query_id", "doc_id", "rank", R6(F.col("retrieval_score")).alias("retrieval_score"))


@query("encode_texts")
def _encode(spark, sf):
    """How much of each text the fitted directions keep, and the length of its vector; held against a dense SVD in tests."""
    d = _docs(spark, sf)
    made = encoder.encode(d, F.col("text"), encoder.fit(d, F.col("text")), share="share")
    return made.select("doc_id", F.round("share", 3).alias("share"), F.round(norm(F.col("vec")), 3).alias("length"))


@query("hybrid_search_encoded")
def _hybrid_encoded(spark, sf):
    """Hybrid search with vectors of its own: texts and questions through the encoder fitted to the collection."""
    docs = cut_lineage(_search_docs(spark, sf).select("post_id", "text", "title", "source", "topic", "persona", "signal_strength", "score", "post_date", "mentions_competitor"))
    e = encoder.fit(docs, F.col("text"))
    vectors = encoder.encode(docs.select(F.col("post_id").alias("doc_id"), "text"), F.col("text"), e).select("doc_id", "vec")
    asked = encoder.encode(questions(spark, sf), F.col("query"), e).select("query_id", "vec")
    out = rt.hybrid_search(docs, questions(spark, sf), vectors, P, as_of(), query_vectors=asked)
    return out.select("query_id", "doc_id", "source", R6(F.col("retrieval_score")).alias("retrieval_score"), "rank")


def _legacy_sql() -> str:
    question = "with thing then"
    terms = sorted({"with", "thing", "then", "thble", "onhe", "src7"})
    parts = []
    for t in terms:
        if t == "thing":
            parts.append("CASE WHEN regexp_matches(lo, '(?:^|[^\\p{L}\\p{N}_])thing(?:$|[^\\p{L}\\p{N}_])') THEN 6 ELSE 0 END + CASE WHEN contains('', 'thing') THEN 8 ELSE 0 END + CASE WHEN contains(lower(entity_name), 'thing') THEN 8 ELSE 0 END")
        else:
            parts.append(f"CASE WHEN contains(lo, {q(t)}) THEN 2 ELSE 0 END + CASE WHEN contains(lower(topic), {q(t)}) THEN 4 ELSE 0 END + CASE WHEN contains(source, {q(t)}) THEN 2 ELSE 0 END")
    com, rev = f"source IN ({', '.join(q(s) for s in _words('community_sources'))})", sql_any("source", _words("review_sources"))
    parts += ["CASE WHEN signal_strength > 60 THEN 3 WHEN signal_strength > 30 THEN 1 ELSE 0 END", "CASE WHEN score >= 50 THEN 2 WHEN score >= 10 THEN 1 ELSE 0 END"]
    has = lambda n: any(t in question for t in _words(n))
    pts = lambda cond, v: f"CASE WHEN {cond} THEN {v} ELSE 0 END"
    if has("review_question"):
        parts += [pts(rev, 5), pts(com, 3)]
    if has("persona_question"):
        parts.append(pts(com, 3))
    if has("fee_question"):
        parts.append(pts(sql_any("lo2", _words("fee_terms")), 3))
    if has("subsidiary_words"):
        parts += [pts(rev, 6), pts(com, 3)]
    parts.append("CASE WHEN score = 0 AND length(lo) < 100 THEN -3 ELSE 0 END")
    if has("competitive_question"):
        parts += [pts(sql_any("source", _words("news_sources")), 4), pts(sql_any("lo", _words("breaking_terms")), 6)]
    return f"""WITH {INSIGHTS}, a AS (SELECT post_id, pos, source, score, signal_strength, topic, CASE WHEN topic IN ('Things', 'Rivals') THEN topic ELSE '' END AS entity_name, lower(text || ' ' || title) AS lo FROM insights),
s AS (SELECT *, {' + '.join(parts)} AS rel FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rel DESC, pos) AS rs FROM s WHERE rel > 0 AND NOT {sql_pack('promotional')})
SELECT post_id, rel AS relevance, row_number() OVER (ORDER BY rel DESC, pos) AS rank FROM k WHERE rs <= 4 ORDER BY rel DESC, pos LIMIT 25"""


@query("keyword_search_legacy", _legacy_sql())
def _legacy(spark, sf):
    d = insights(spark, sf).withColumn("competitor", F.lit(""))
    return rt.keyword_search(d, "With thing then", P, max_per_source=4).select("post_id", "relevance", "rank")


@query("stratified_sample_topics", f"""WITH {INSIGHTS}, t AS (SELECT topic, row_number() OVER (ORDER BY count(*) DESC, topic) AS t FROM insights WHERE topic NOT IN ('General', '') GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 4),
b AS (SELECT post_id, t, i FROM (SELECT i.*, t.t, row_number() OVER (PARTITION BY topic ORDER BY signal_strength + score DESC, pos) AS i FROM insights i JOIN t USING (topic)) WHERE i <= 2),
e AS (SELECT post_id, CASE persona WHEN 'Investor' THEN 1001 ELSE 1002 END AS t, 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY signal_strength DESC, pos) AS r FROM insights WHERE persona IN ('Investor', 'Collector')) WHERE r = 1 AND post_id NOT IN (SELECT post_id FROM b))
SELECT post_id FROM (SELECT * FROM b UNION ALL SELECT * FROM e) ORDER BY t, i LIMIT 9""")
def _stratified(spark, sf):
    return rt.stratified_topics(insights(spark, sf), n_topics=4, personas=["Investor", "Collector"], limit=9).select("post_id")


@query("vectorize_texts")
def _vectorize(spark, sf):
    from pyspark.ml.functions import vector_to_array

    v = rt.vectorize_texts(_docs(spark, sf), F.col("text"), "doc_id", 256)
    a = vector_to_array("features")
    return v.select("doc_id", R6(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


@query("embed_with")
def _embed(spark, sf):
    def encode(texts):
        import numpy as np

        return np.array([[len(t), t.count("e"), t.count("n"), 1.0] for t in texts])

    from tidemark.functions.vectors import dot

    v = rt.embed_with(_docs(spark, sf), F.col("text"), "doc_id", encode)
    return v.select("doc_id", F.round(dot(F.col("vec"), F.col("vec")), 4).alias("norm"))


# --- clustering ----------------------------------------------------------------------------------

@query("cluster_workstreams", f"WITH {INSIGHTS}, {WORKSTREAM} SELECT workstream, count(*) AS n FROM ws WHERE workstream <> 'EXCLUDE' GROUP BY 1 HAVING count(*) >= 3")
def _groups(spark, sf):
    return cl.cluster_workstreams(with_workstream(spark, sf)).groupBy("workstream").agg(F.count(F.lit(1)).alias("n"))


_HEX = lambda c, at: f"CAST('0x' || substr({c}, {at}, 15) AS BIGINT)"


@query("cluster_key", f"""WITH {POSTS}, f AS (SELECT source, md5(md5(lower(text))) AS h FROM posts), g AS (SELECT source, {_HEX('h', 1)} AS lo, {_HEX('h', 17)} AS hi FROM f)
SELECT source, md5(concat_ws(':', count(*), sum(lo), sum(hi), bit_xor(lo), bit_xor(hi))) AS cluster_id FROM g GROUP BY 1""")
def _key(spark, sf):
    p = posts(spark, sf).withColumn("fp", F.md5(F.lower("text")))
    return cl.cluster_ids(p, "source", "fp")


def coherence_sql(stop) -> str:
    """Word sets (tk) and the mean overlap of all pairs per source (mj), with the same hash functions."""
    family = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(hash_family(cl.HASHES)))
    return f"""tk AS (SELECT source, doc_id AS pos, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([{', '.join(q(s) for s in stop)}], x))) AS tok FROM documents),
hx AS (SELECT source, pos, {_HEX('md5(t)', 1)} % {PRIME} AS h FROM (SELECT source, pos, unnest(tok) AS t FROM tk)), fam(k, a, b) AS (VALUES {family}),
sg AS (SELECT source, pos, k, min((a * h + b) % {PRIME}) AS v FROM hx, fam GROUP BY 1, 2, 3), cn AS (SELECT source, k, v, count(*) AS n FROM sg GROUP BY 1, 2, 3),
sm AS (SELECT source, sum(n * (n - 1))::DOUBLE AS same, sum(n) / {cl.HASHES}::DOUBLE AS r FROM cn GROUP BY 1), mj AS (SELECT source, same / {cl.HASHES} / (r * (r - 1)) AS m FROM sm WHERE r > 1)"""


@query("cluster_coherence_fast", f"WITH {coherence_sql(STOP_COHERENCE)}, w AS (SELECT source, count(*) AS size, min(len(tok)) AS least FROM tk GROUP BY 1) SELECT source, size, round(CASE WHEN size <= 2 THEN 0.85 WHEN least = 0 THEN 0.75 ELSE 0.6 + 0.4 * coalesce(m, 0.5) END, 6)::DOUBLE AS coherence FROM w LEFT JOIN mj USING (source)")
def _coherence(spark, sf):
    d = _docs_src(spark, sf)
    return cl.coherence_fast(d, "source", F.col("text")).withColumn("coherence", R6(F.col("coherence")))


def _docs_src(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


@query("mean_pairwise_jaccard", f"WITH {coherence_sql(STOP_QUALITY)} SELECT source, round(m, 6) AS token_coherence FROM mj")
def _jaccard(spark, sf):
    return cl.mean_pairwise_jaccard(_docs_src(spark, sf), "source", F.col("text")).withColumn("token_coherence", R6(F.col("token_coherence")))


_EPS = 0.68
_VP = f"vp AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query("eps_neighbours", f"WITH {_VP} SELECT a, b, round(distance, 6) AS distance FROM vp WHERE distance <= 0.62")
def _eps(spark, sf):
    v = table(spark, sf, "embeddings")
    return cl.eps_neighbours(v, 0.62, id_col="vec_id", vec="embedding", block_rows=150).withColumn("distance", R6(F.col("distance")))


@query("dbscan_cosine", f"""WITH RECURSIVE {_VP}, nb AS (SELECT a, b FROM vp WHERE distance <= {_EPS} UNION ALL SELECT b, a FROM vp WHERE distance <= {_EPS}), core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 4),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id),
comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1), border AS (SELECT nb.a AS id, min(comp.cluster) AS cluster FROM nb JOIN comp ON comp.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT id, cluster, TRUE AS is_core FROM comp UNION ALL SELECT id, cluster, FALSE FROM border""")
def _dbscan(spark, sf):
    v = table(spark, sf, "embeddings")
    return cl.dbscan_cosine(v, _EPS, 4, id_col="vec_id", vec="embedding", block_rows=200)


@query("dbscan_by_label", f"""WITH RECURSIVE {_VP}, nb AS (SELECT la AS label, a, b FROM vp WHERE la = lb AND distance <= 0.85 UNION ALL SELECT la, b, a FROM vp WHERE la = lb AND distance <= 0.85), core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 5),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id),
comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1), border AS (SELECT nb.a AS id, min(comp.cluster) AS cluster FROM nb JOIN comp ON comp.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY 1), al AS (SELECT * FROM comp UNION ALL SELECT * FROM border)
SELECT e.label, al.id, al.cluster FROM al JOIN embeddings e ON e.vec_id = al.id""")
def _dbscan_label(spark, sf):
    v = table(spark, sf, "embeddings")
    return cl.dbscan_cosine(v, 0.85, 5, ["label"], "vec_id", "embedding", block_rows=30).select("label", "id", "cluster")


@query("mean_pairwise_cosine", f"WITH {_VP}, n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) SELECT la AS label, any_value(size) AS size, round(avg(1 - distance), 6) AS avg_similarity FROM vp JOIN n ON n.label = la WHERE la = lb GROUP BY 1")
def _pair_cos(spark, sf):
    return cl.mean_pairwise_cosine(table(spark, sf, "embeddings"), ["label"], "embedding").withColumn("avg_similarity", R6(F.col("avg_similarity")))


_COMMON = ["the", "thing", "thble", "que", "und", "onhe", "ering"]
_TOKI = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([" + ", ".join(q(s) for s in STOP_COHERENCE) + "], x)))"


@query("overlap_penalty", f"""WITH tk AS (SELECT source, doc_id, {_TOKI} AS tok FROM documents), n AS (SELECT source, count(*) AS n, min(len(tok)) AS least FROM tk GROUP BY 1),
p AS (SELECT a.source, avg(len(list_intersect(list_intersect(a.tok, b.tok), [{', '.join(q(s) for s in _COMMON)}])) / greatest(1, len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)))::DOUBLE) AS m FROM tk a JOIN tk b ON a.source = b.source AND a.doc_id < b.doc_id GROUP BY 1)
SELECT source, round(CASE WHEN n < 2 OR least = 0 THEN 0 ELSE least(0.15, m * 0.6) END, 6)::DOUBLE AS penalty FROM n JOIN p USING (source)""")
def _penalty(spark, sf):
    return cl.overlap_penalty(_docs_src(spark, sf), ["source"], "doc_id", F.col("text"), block_rows=300, common=_COMMON).withColumn("penalty", R6(F.col("penalty")))


@query("overlap_penalty_sketch", f"""WITH tk AS (SELECT source, doc_id, {_TOKI} AS tok FROM documents), n AS (SELECT source, count(*) AS n, min(len(tok)) AS least FROM tk GROUP BY 1),
hx AS (SELECT source, doc_id, {_HEX('md5(t)', 1)} % {PRIME} AS h, CASE WHEN t IN ({', '.join(q(s) for s in _COMMON)}) THEN 0 ELSE 1 END AS plain FROM (SELECT source, doc_id, unnest(tok) AS t FROM tk)),
fam(k, a, b) AS (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(hash_family(cl.PENALTY_HASHES)))}),
sg AS (SELECT source, doc_id, k, min(2 * ((a * h + b) % {PRIME}) + plain) AS v FROM hx, fam GROUP BY 1, 2, 3), cn AS (SELECT source, k, v, count(*) AS c FROM sg WHERE v % 2 = 0 GROUP BY 1, 2, 3),
p AS (SELECT source, sum(c * (c - 1))::DOUBLE / {cl.PENALTY_HASHES} AS s FROM cn GROUP BY 1)
SELECT source, round(CASE WHEN n < 2 OR least = 0 THEN 0 ELSE least(0.15, coalesce(s, 0) / (n * (n - 1)) * 0.6) END, 6)::DOUBLE AS penalty FROM n LEFT JOIN p USING (source)""")
def _penalty_sketch(spark, sf):
    return cl.overlap_penalty_sketch(_docs_src(spark, sf), ["source"], "doc_id", F.col("text"), common=_COMMON).withColumn("penalty", R6(F.col("penalty")))


def _labelled(spark, sf):
    """Vectors next to the text of the document with the same id."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return v.join(d, "id")


_COHERENT = f"""mb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label, {_TOKI} AS tok FROM embeddings JOIN documents ON doc_id = vec_id), vs AS (SELECT label, count(*) AS size, min(len(tok)) AS least FROM mb GROUP BY 1),
vp AS (SELECT a.label, a.id AS a, b.id AS b, list_dot_product(a.vec, b.vec) AS sim, len(list_intersect(list_intersect(a.tok, b.tok), [{', '.join(q(s) for s in cl.COMMON_TOKENS)}])) / greatest(1, len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)))::DOUBLE AS glue FROM mb a JOIN mb b ON a.label = b.label AND a.id < b.id),
vm AS (SELECT label, avg(sim) AS sim, avg(glue) AS glue FROM vp GROUP BY 1),
ch AS (SELECT label, size, CASE WHEN size <= 2 THEN 1 ELSE greatest(0, sim - CASE WHEN least = 0 THEN 0 ELSE least(0.15, glue * 0.6) END) END AS coherence FROM vs LEFT JOIN vm USING (label))"""


@query("cluster_coherence_vector", f"WITH {_COHERENT} SELECT label, size, round(coherence, 6)::DOUBLE AS coherence, size <= 2 OR coherence >= 0 AS coherent FROM ch")
def _coh_vector(spark, sf):
    v = cl.coherence_vector(_labelled(spark, sf), ["label"], "id", F.col("text"), threshold=0.0)
    return v.withColumn("coherence", R6(F.col("coherence")))


@query("split_incoherent", f"""WITH RECURSIVE {_COHERENT}, bad AS (SELECT label FROM ch WHERE size > 3 AND coherence < {cl.COHERENCE_THRESHOLD}), nb AS (SELECT label, a, b FROM vp JOIN bad USING (label) WHERE 1 - sim <= 0.8 UNION ALL SELECT label, b, a FROM vp JOIN bad USING (label) WHERE 1 - sim <= 0.8),
reach(label, id, root) AS (SELECT DISTINCT label, a, a FROM nb UNION SELECT nb.label, nb.b, reach.root FROM reach JOIN nb ON nb.a = reach.id), cm AS (SELECT label, id, min(root) AS cluster FROM reach GROUP BY 1, 2),
sb AS (SELECT label, id, CASE WHEN count(*) OVER (PARTITION BY label, cluster) <= 2 THEN id ELSE cluster END::VARCHAR AS sub FROM cm UNION ALL SELECT label, id, label::VARCHAR FROM mb WHERE label NOT IN (SELECT label FROM bad))
SELECT label, count(DISTINCT sub) AS subs, count(*) AS kept FROM sb GROUP BY 1""")
def _split(spark, sf):
    m = _labelled(spark, sf)
    verdict = cl.coherence_vector(m, ["label"], "id", F.col("text"))
    return cl.split_incoherent(m, verdict, "label", eps=0.8).groupBy("label").agg(F.count_distinct("sub").alias("subs"), F.count(F.lit(1)).alias("kept"))


@query("unique_cluster_names", f"""WITH {INSIGHTS}, c AS (SELECT persona AS cluster_id, count(*) AS n FROM insights GROUP BY 1), t AS (SELECT persona, arg_min(topic, -c * 1000 + r) AS dom FROM (SELECT persona, topic, c, row_number() OVER (PARTITION BY persona ORDER BY topic) AS r FROM (SELECT persona, topic, count(*) AS c FROM insights WHERE topic NOT IN ('General', 'Unknown', '') GROUP BY 1, 2)) GROUP BY 1)
SELECT cluster_id, 'Theme ' || length(cluster_id) % 3 || CASE WHEN count(*) OVER (PARTITION BY length(cluster_id) % 3) > 1 AND dom IS NOT NULL THEN ': ' || dom ELSE '' END AS theme FROM c LEFT JOIN t ON t.persona = c.cluster_id""")
def _names(spark, sf):
    i = insights(spark, sf)
    cards = i.select(F.col("persona").alias("cluster_id")).distinct().withColumn("theme", F.concat(F.lit("Theme "), (F.length("cluster_id") % 3).cast("string"))).withColumn("title", F.col("theme"))
    return cl.unique_names(cards, i.withColumn("cluster_id", F.col("persona"))).select("cluster_id", "theme")
