"""Steps without SQL against brute force on small fixtures."""

import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import rules, text
from tidemark.operators import clustering, enrich, retrieval
from tidemark.plans import weekly

M = rules.load_packs("marketplace")


def toks(s):
    return [t for t in re.findall("[a-z0-9]+(?:'[a-z]+)?", s.lower()) if t not in text.STOP_RETRIEVAL and len(t) > 1]


def brute_hybrid(docs, questions, mat, cap, k):
    corpus = [toks(f"{d['title']} {d['text']} {d['source']} {d['topic']} {d['persona']} ") for d in docs]
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = Counter(t for c in corpus for t in set(c))

    def bm25(q):
        s = np.zeros(n)
        for t in toks(q):
            if t in df:
                idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
                for i, c in enumerate(corpus):
                    tf = c.count(t)
                    s[i] += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c) / avg))
        s = np.round(s, 9)
        return [i for i in sorted(range(n), key=lambda i: (-s[i], i)) if s[i] > 0][:50]

    out = set()
    for qid, q in questions:
        variants = [q]
        for r in M["expansions"].rules:
            if r.label in q.lower():
                variants.append(f"{q} {dict(r.attrs)['expansion']}")
                break
        lex, den = [], []
        for v in variants:
            best = bm25(v)
            lex += best
            if best:
                proxy = mat[best[:5]].mean(0)
                sims = mat @ (proxy / np.linalg.norm(proxy))
                den += [i for i in sorted(range(n), key=lambda i: (-sims[i], i)) if sims[i] > 0.1][:50]
        score = defaultdict(float)
        for ranked in (list(dict.fromkeys(lex))[:100], list(dict.fromkeys(den))[:100]):
            for r, i in enumerate(ranked):
                score[i] += 1 / (61 + r)
        final = sorted(((round(s - 0.02, 9), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))
        used, rank = Counter(), 0
        for s, i in final:
            if used[docs[i]["source"]] < cap and rank < k:
                used[docs[i]["source"]] += 1
                rank += 1
                out.add((qid, i, rank))
    return out


def test_hybrid_search(spark):
    rng = random.Random(11)
    words = "vault card fees slow grade label crate green stone river paper north".split()
    docs = [dict(post_id=i, text=" ".join(rng.choice(words) for _ in range(rng.randint(3, 20))), title="", source="hot" if i % 3 == 0 else f"s{i % 7}", topic="T", persona="P",
                 signal_strength=1.0, score=0, post_date=dt.date(2020, 1, 1), mentions_competitor=[]) for i in range(60)]
    mat = np.random.default_rng(2).normal(size=(60, 6))
    mat = (mat / np.linalg.norm(mat, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    d = spark.createDataFrame(docs, "post_id long, text string, title string, source string, topic string, persona string, signal_strength double, score long, post_date date, mentions_competitor array<string>")
    v = spark.createDataFrame([(i, [float(x) for x in mat[i]]) for i in range(60)], "doc_id long, vec array<float>")
    qs = [(1, "green vault card"), (2, "river stone"), (3, "slow fees paper")]
    got = retrieval.hybrid_search(d, spark.createDataFrame(qs, "query_id long, query string"), v, M, F.lit("2024-01-01").cast("date"), k=12, max_per_source=3)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == brute_hybrid(docs, qs, mat, 3, 12)


def test_coherence_and_split(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(2, 5)) * 3
    pts = np.concatenate([centers[i % 2] + 0.2 * rng.normal(size=(1, 5)) for i in range(16)] + [rng.normal(size=(2, 5)) + 50])
    pts = pts / np.linalg.norm(pts, axis=1, keepdims=True)
    words = ["alpha refund", "beta refund case", "gamma", "delta seller case"]
    rows = [(i, "mixed" if i < 16 else "tight", [float(np.float32(x)) for x in pts[i]], words[i % 4] + f" w{i}") for i in range(18)]
    d = spark.createDataFrame(rows, "id long, g string, vec array<float>, text string").cache()
    verdict = clustering.coherence_vector(d, ["g"], "id", F.col("text"))
    got = {r.g: r for r in verdict.collect()}
    mat = np.array([r[2] for r in rows[:16]])
    sims = [mat[i] @ mat[j] for i in range(16) for j in range(i + 1, 16)]
    sets = [set(re.findall("[a-z0-9]+", r[3])) for r in rows[:16]]
    common = set(clustering.COMMON_TOKENS)
    over = [len(sets[i] & sets[j] & common) / len(sets[i] | sets[j]) for i in range(16) for j in range(i + 1, 16)]
    want = max(0.0, np.mean(sims) - min(0.15, np.mean(over) * 0.6))
    assert abs(got["mixed"].coherence - want) < 1e-5 and not got["mixed"].coherent and got["tight"].coherent
    parts = defaultdict(set)
    for r in clustering.split_incoherent(d, verdict, "g").collect():
        parts[(r.g, r.sub)].add(r.id)
    assert sorted(map(sorted, (v for (g, _), v in parts.items() if g == "mixed"))) == [list(range(0, 16, 2)), list(range(1, 16, 2))]
    assert {i for (g, _), v in parts.items() if g == "tight" for i in v} == {16, 17}


def test_feedback_patterns(spark):
    s = "pos long, response string"
    liked = spark.createDataFrame([(i, "### 🎯 Bottom Line\n" + "[S1] " * (9 if i == 5 else 1)) for i in range(6)], s)
    bad = spark.createDataFrame([(0, "I don't have it"), (1, "Signals " + "[S1] [S2] [S3] " * 20)], s)
    got = {(r.kind, r.note) for r in enrich.feedback_patterns(liked, bad, M).collect()}
    assert ("style", "Always start with the Bottom Line heading") in got and ("style", "Use dense citations (9+ sources)") in got
    assert ("avoid", "Avoid extremely short responses (<200 chars)") in got and ("avoid", "When data is lacking, provide related insights") in got
    assert sum(k == "style" for k, _ in got) == 2


def test_feedback_patterns_read_whole_answers(spark):
    """Style notes of the newest three against a plain count over whole answers."""
    s = "pos long, response string"
    texts = ["x" * 1500 + "\n### Executive Answer\n" + "[S1] " * 3, "y" * 1190 + "[S2] " * 9, "### 🎯 Bottom Line\n" + "z" * 2000 + "\n### Implications for eBay"]
    liked = spark.createDataFrame([(0, "### What the Signals Show"), *((k + 1, t) for k, t in enumerate(texts))], s)
    want = {r.label for r in M["style_notes"].rules for t in texts if any(x in t for x in r.substr)} | {f"Use dense citations ({t.count('[S')}+ sources)" for t in texts if t.count("[S") >= 8}
    got = {r.note for r in enrich.feedback_patterns(liked, spark.createDataFrame([], s), M).collect()}
    assert got == want and len(want) == 4


def test_weekly_run_writes_consistent_tables(spark, tmp_path):
    texts = ["My ebay vault withdraw is stuck and support gives no response, terrible problem"] * 5 + [f"ebay seller fee problem number {i}, the commission is too high" for i in range(6)] + ["unrelated"]
    cols = "post_id long, pos long, text string, title string, source string, subreddit string, url string, username string, post_date date, score long, like_count long, num_comments long"
    posts = spark.createDataFrame([(i, i, t, "", "Reddit", "", f"u{i}", "a", dt.date(2024, 1, 1), i, 0, 0) for i, t in enumerate(texts)], cols)
    as_of = F.lit("2024-03-01").cast("date")
    first = weekly.weekly_run(spark, posts, M, as_of, str(tmp_path / "a"))
    c = first.counts.first()
    assert (c.total_posts_loaded, c.total_relevant, c.total_insights) == (12, 11, 7)
    assert {r.metric: r.value for r in first.snapshot.where("metric_group = 'total'").collect()} == {"total_insights": 7.0}
    cards = {r.workstream: r.insight_count for r in first.cards.collect()}
    assert cards == {"Seller Economics & Fees": 6}
    second = weekly.weekly_run(spark, posts.where("post_id < 7"), M, as_of, str(tmp_path / "b"), previous=first.snapshot)
    # The five equal posts fold to one and two of the six fee posts remain.
    assert second.insights.count() == 3
    assert [(r.metric, r.delta, r.severity) for r in second.deltas.collect()] == [("fees", -4.0, "high")]


def test_broad_questions_give_the_same_columns(spark):
    broad = next(t for r in M["question_intents"].rules if r.label == "broad" for t in r.substr)
    rows = [(i, f"text {i}", f"title {i}", "s", f"t{i % 3}", "Collector", float(i), i, "Negative") for i in range(12)]
    d = spark.createDataFrame(rows, "post_id long, text string, title string, source string, topic string, persona string, signal_strength double, score int, brand_sentiment string")
    d = d.withColumn("post_date", F.lit("2024-02-01").cast("date")).withColumn("mentions_competitor", F.array().cast("array<string>"))
    got = weekly.ask(broad, d, M, F.lit("2024-03-01").cast("date")).sources.select("doc_id", "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len({r.doc_id for r in got}) == len(got) == 6
