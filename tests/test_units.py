"""Hand-made fixtures: traps, invariants, skew, plans."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from tidemark.functions import automaton, dates, hashing, rules, text
from tidemark.operators import clustering, dedup, enrich, evaluation, filters, joins, ordering, retrieval, trends
from tidemark.sources import readers, sinks
from tidemark.streaming import incremental as st
from tidemark.streaming.upsert import BucketTable

M = rules.load_packs("marketplace")


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


# --- text ---------------------------------------------------------------------------------

@pytest.mark.parametrize("raw, want", [
    ("a\nb\nc\nd", "abcd"), ("a\nb\nhello", "ab hello"), ("the the cat", "the cat"), ("zero​width", "zerowidth"),
    ("ｆｕｌｌ width", "full width"), ("  two   blanks ", "two blanks"), ("a\n\nb", "a b"), ("i\nn\ns\nt end", "inst end"), ("", "")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize_text) == want


def test_substring_trap(spark):
    df = spark.createDataFrame([("i know each feedback",)], "lo string")
    got = df.select(rules.any_hit(F.col("lo"), rules.Pack.words("u", ["now"])), rules.any_hit(F.col("lo"), rules.Pack.whole_words("u", ["now", "ach", "fee"]))).first()
    assert got == (True, False)


def test_rule_conditions(spark):
    pack = rules.Pack.of("p", [{"label": "both", "all_of": [["psa"], ["vault"]]}, {"label": "flag", "flags": ["f"], "none_of": ["x"]}, {"label": "rx", "regex": [r"\$\d+k"]}])
    rows = [("psa vault", False), ("plain", True), ("plain x", True), ("paid $5k", None)]
    got = spark.createDataFrame(rows, "lo string, f boolean").select(rules.first_label(F.col("lo"), pack, "none", None)).collect()
    assert [r[0] for r in got] == ["both", "flag", "none", "rx"]


@pytest.mark.parametrize("table_bytes", [1 << 26, 400])
def test_explode_hits_of_lists_and_tables(spark, table_bytes):
    """One plan for a list, a table, and a table in many parts; nulls, empty texts and terms, other scripts, long texts."""
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("abcdé 漢") for _ in range(rng.randint(0, 40))), "x") for i in range(60)]
    docs += [(100, None, "x"), (101, "", "x"), (102, "ab" * 3000 + "漢dc", "x"), (103, "ABCD", "x")]
    lex = sorted({"".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 5))) for _ in range(80)} | {"abababababab", "b漢dc", "zz"})
    d = spark.createDataFrame(docs, "id int, text string, other string")
    table = spark.createDataFrame([(t,) for t in [*lex, "", None, lex[0]]], "term string")
    want = {(i, t) for i, s, _ in docs if s for t in lex if t in s.lower()}
    for lexicon in (lex, table):
        got = [(r.id, r.term) for r in rules.explode_hits(d, "text", lexicon, table_bytes=table_bytes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    n = len(list(automaton.parts(table, "term", table_bytes)))
    assert n == 1 if table_bytes > 400 else n > 5
    assert rules.explode_hits(d, "text", []).count() == 0 == rules.explode_hits(d.limit(0), "text", lex).count()


def test_automaton_cuts_texts_into_stretches():
    """Terms across the seams of stretches are found, terms across two texts are not."""
    machine = automaton.build(["seam", "eam", "x", "mse"])
    texts = ["a" * (automaton.STRETCH - 2) + "seam" + "b" * 5000 + "x", "sea", "mx"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *map(len, texts)])
    rows, terms = automaton.find(machine, np.frombuffer(data, np.uint8), at[:-1], at[1:])
    assert {(r, machine.terms[t]) for r, t in zip(rows, terms)} == {(0, "seam"), (0, "eam"), (0, "x"), (2, "x")}


def test_simhash_against_a_plain_loop(spark):
    def slow(t):
        toks = [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in text.STOP_DEDUP and len(w) > 2]
        s = " ".join(toks)
        grams = [s] if len(s) < 3 else [s[i:i + 3] for i in range(len(s) - 2)]
        votes = [0] * 64
        for g in grams:
            h = int(hashlib.md5(g.encode()).hexdigest(), 16)
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        v = sum(1 << i for i in range(64) if votes[i] > 0)
        return v - (1 << 64) if v >> 63 else v

    rng = random.Random(1)
    texts = ["", "a", "the of", "Hello world"] + [" ".join(rng.choice(["card", "vault", "Refund", "née", "x9"]) + str(rng.randint(0, 50)) for _ in range(30)) for _ in range(20)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.simhash64(F.col("t"))).collect()
    assert all(r[1] == slow(r[0]) for r in got)


@pytest.mark.parametrize("raw, want", [("2024-01-05", "2024-01-05"), ("2024-01-05T10:00:00Z", "2024-01-05"), ("Jan 5, 2024", "2024-01-05"), ("1/5/2024", "2024-01-05"), ("garbage", "None"), (None, "None"),
                                       ("Mon, 01 Jan 2024 12:00:00 GMT", "None")])
def test_dates(spark, raw, want):
    assert str(one(spark, raw, dates.parse_date_multi)) == want


def test_feed_date(spark):
    assert str(one(spark, "Mon, 01 Jan 2024 12:00:00 GMT", dates.parse_feed_date)) == "2024-01-01"


# --- shipped vocabulary ---------------------------------------------------------------------

def posts(spark, *texts, **cols):
    rows = [Row(post_id=i, pos=i, text=t, title="", source=cols.get("source", "Reddit"), subreddit=cols.get("subreddit", ""), url=f"u{i}", username="a", post_date=None,
                score=cols.get("score", 0), like_count=cols.get("like_count", 0), num_comments=0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "post_id long, pos long, text string, title string, source string, subreddit string, url string, username string, post_date date, score long, like_count long, num_comments long")


def test_default_enrichment(spark):
    d = posts(spark, "I switched to whatnot because ebay fees are too high and support is terrible",
              "How do I withdraw my card from the psa vault? I have waited for weeks now", "I love ebay, the best marketplace for a collector like me", "The weather is mild and calm in the valley today")
    got = {r.post_id: r for r in enrich.enrich_posts(d, M, F.lit("2024-03-01").cast("date")).collect()}
    assert (got[0].topic, got[0].type_tag, got[0].brand_sentiment, got[0].is_churn_signal) == ("Competitive Churn", "Churn Signal", "Negative", True)
    assert got[1].has_vault and got[1].type_tag == "Question" and got[1].is_urgent
    assert got[2].type_tag == "Praise" and got[2].brand_sentiment == "Positive" and got[2].persona == "Collector"
    assert (got[3].topic, got[3].persona, got[3].topic_focus) == ("General", "General", ["General"])


def test_default_relevance(spark):
    d = posts(spark, "My ebay buyer opened a case and I got no response, terrible problem", "just pulled my grail, mail day, so happy with this psa slab", "[WTS] psa 10 for sale, ebay problem", "comc sent my cards", "nothing here at all")
    kept = {r.post_id for r in filters.route_relevant(d, M, "YouTube (comment)").collect() if r.route == "relevant"}
    assert 0 in kept and not kept & {1, 2, 4}
    comments = posts(spark, "x" * 60 + " grading price is bad", "short fee", source="YouTube (comment)", like_count=5)
    assert {r.post_id for r in filters.route_relevant(comments, M, "YouTube (comment)").where("route = 'quality_comment'").collect()} == {0}


def test_vertical_lines_count_in_the_whole_text(spark):
    ok = "My ebay buyer opened a case and I got no response, terrible problem"
    late = "\n".join([ok, *["an ordinary line"] * 40, *"sold!"])
    kept = {r.post_id for r in filters.route_relevant(posts(spark, late, late[:-2], ok), M, "YouTube (comment)").collect() if r.route == "relevant"}
    assert kept == {1, 2}


def test_default_workstreams(spark):
    d = posts(spark, "psa vault withdraw failed at checkout", "authentication of my card was wrong", "seller fee on every listing went up", "use my link to win", "a quiet day in the garden")
    rows = enrich.workstream_of(enrich.enrich_posts(d, M, F.lit("2024-03-01").cast("date")), M).select("post_id", "workstream").collect()
    got = {r.post_id: r.workstream for r in rows}
    assert got[0] == "Payment & Checkout Friction" and got[1] == "Authentication & Grading Confidence" and got[2] == "Seller Economics & Fees"
    assert got.get(3, "EXCLUDE") == "EXCLUDE" and got.get(4, "General Platform Feedback") == "General Platform Feedback"


def test_query_expansion_default(spark):
    q = spark.createDataFrame([(1, "vault fees"), (2, "hello")], "query_id int, query string")
    got = {(r.query_id, r.variant): r.query for r in retrieval.expand_query(q, M["expansions"]).collect()}
    assert got == {(1, 0): "vault fees", (1, 1): "vault fees PSA vault eBay vault storage withdrawal vaulted cards", (2, 0): "hello"}


# --- de-duplication ------------------------------------------------------------------------

def test_text_url_cross(spark):
    d = spark.createDataFrame([(0, "alpha", "u1"), (1, "beta", "u1"), (2, "beta", "u2"), (3, "gamma", ""), (4, "", "")], "pos int, text string, url string")
    # Row 1 claims the text in the first pass and loses its url in the second, so row 2 goes too.
    assert {r.pos for r in dedup.dedup_text_or_url(d).collect()} == {0, 3, 4}


def test_dedup_invariants(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(90):
        t = base[0] if i % 3 == 0 else base[i % 12]           # a third of the rows are one text
        toks = t.split()
        if i % 5 == 0:
            toks[-1] = rng.choice(words)
        rows.append((i, " ".join(toks), rng.randint(0, 9)))
    d = spark.createDataFrame(rows, "pos long, text string, score long")
    kept = dedup.deduplicate(d).cache()
    again = dedup.deduplicate(kept)
    assert {r.pos for r in again.collect()} == {r.pos for r in kept.collect()}
    stats = dedup.dedup_stats(d, dedup.dedup_prefix(d), kept).first()
    assert stats.unique + stats.exact_dupes + stats.near_dupes == stats.total
    split = dedup.near_dup_simhash(dedup.dedup_prefix(d), hot_bucket=0)
    assert {r.pos for r in split.collect()} == {r.pos for r in dedup.near_dup_simhash(dedup.dedup_prefix(d)).collect()}


def test_hot_band_split_loses_no_pair(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    hashes = {base & ~(1 << 63)}
    for _ in range(60):
        h = base & ~(1 << 63)
        for b in rng.sample(range(16, 63), rng.randint(1, 7)):  # band 0 stays equal for all
            h ^= 1 << b
        hashes.add(h)
    d = spark.createDataFrame([(h,) for h in hashes], "simhash long")
    want = {(min(a, b), max(a, b)) for a in hashes for b in hashes if a != b and bin(a ^ b).count("1") <= 5}
    for hot in (0, 10_000):
        assert {(r.a, r.b) for r in dedup.near_pairs(d, hot_bucket=hot).collect()} == want


def test_near_pairs_are_all_pairs_within_the_threshold(spark):
    """One differing bit in each 16-bit quarter: such pairs share none of four bands."""
    base = random.Random(4).getrandbits(63)
    hashes = [base, base ^ (1 << 3 | 1 << 20 | 1 << 40 | 1 << 50), base ^ (1 << 7 | 1 << 30 | 1 << 33 | 1 << 60 | 1 << 61), base ^ 0b111111]
    want = {(min(a, b), max(a, b)) for a in hashes for b in hashes if a != b and bin(a ^ b).count("1") <= 5}
    d = spark.createDataFrame([(h,) for h in hashes], "simhash long")
    assert len(want) == 2 and all({(r.a, r.b) for r in dedup.near_pairs(d, hot_bucket=hot).collect()} == want for hot in (0, 5_000))


# --- ordering --------------------------------------------------------------------------------

def test_next_rows_across_blocks(spark):
    ids = random.Random(2).sample(range(10_000), 157)
    d = spark.createDataFrame([(i,) for i in ids], "pos long")
    got = {(r.pos, r.next_pos, r.step) for r in ordering.next_rows(d, "pos", ["pos"], 5, block=10).collect()}
    s = sorted(ids)
    assert got == {(s[i], s[i + k], k) for i in range(len(s)) for k in range(1, 6) if i + k < len(s)}


def test_source_cap_is_kept(spark):
    d = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i}", 100 - i) for i in range(60)], "pos int, source string, score int")
    got = ordering.source_diversity_cap(d, [], "source", [F.desc("score"), F.asc("pos")], 4, 15).orderBy("rank").collect()
    want, seen = [], {}
    for i in range(60):
        s = "hot" if i % 3 else f"s{i}"
        if seen.get(s, 0) < 4 and len(want) < 15:
            want.append(i)
            seen[s] = seen.get(s, 0) + 1
    assert [r.pos for r in got] == want


def test_plans(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = ordering.top_n_per_group(d, "l_returnflag", [F.desc("l_extendedprice")], 3).select("l_orderkey")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>" in plan
    from tidemark.queries import catalog

    for name in ("bm25_topk", "source_distribution", "detect_trends", "explode_hits", "priority_minmax", "temporal_edges"):
        text_plan = catalog.SPARK[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text_plan and "BroadcastNestedLoopJoin" not in text_plan, name


# --- clustering ----------------------------------------------------------------------------------

def brute_dbscan(ids, mat, eps, k):
    near = (1 - mat @ mat.T) <= eps + 0.0
    core = near.sum(1) >= k
    label = {}
    for i in range(len(ids)):
        if core[i] and ids[i] not in label:
            stack = [i]
            label[ids[i]] = ids[i]
            while stack:
                u = stack.pop()
                for v in np.flatnonzero(near[u]):
                    if ids[v] not in label:
                        label[ids[v]] = ids[i]
                        if core[v]:
                            stack.append(v)
    return label


def test_dbscan_with_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(4, 8))
    mat = np.concatenate([c + 0.25 * rng.normal(size=(25, 8)) for c in centers] + [rng.normal(size=(20, 8))])
    mat[::3] = mat[0]                                          # a third of the rows are one vector
    mat = (mat / np.linalg.norm(mat, axis=1, keepdims=True)).astype(np.float32)
    ids = list(range(len(mat)))
    d = spark.createDataFrame([(i, [float(x) for x in mat[i]]) for i in ids], "id long, vec array<float>")
    want = brute_dbscan(ids, mat.astype(np.float64), 0.15, 3)
    got = {r.id: r.cluster for r in clustering.dbscan_cosine(d, 0.15, 3, block_rows=15).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    nodes = spark.range(400).withColumnRenamed("id", "node")
    edges = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = clustering.connected_components(nodes, edges).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got)[-1] == 300 and len(got) == 101


def test_cluster_id_does_not_depend_on_order(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "y"), ("c", "x"), ("d", "x")], "c string, fp string")
    one = {r.c: r.cluster_id for r in clustering.cluster_ids(d, "c", "fp").collect()}
    two = {r.c: r.cluster_id for r in clustering.cluster_ids(d.repartition(3).orderBy(F.desc("fp")), "c", "fp").collect()}
    assert one == two and one["a"] == one["c"] and len(set(one.values())) == 3


def test_mean_overlap_counts_all_rows(spark):
    """Far more rows than a sample would take: the estimate stays near the exact mean over all pairs."""
    words = [[f"w{(i * 7 + k) % 40}" for k in range(12)] for i in range(60)]
    d = spark.createDataFrame([("a", " ".join(w)) for w in words] + [("b", "same words here"), ("b", "same words here"), ("c", "alone"), ("d", "")], "c string, t string")
    got = {r.c: r.token_coherence for r in clustering.mean_pairwise_jaccard(d, "c", F.col("t"), hashes=256).collect()}
    sets = [set(w) for w in words]
    exact = [len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[:i]]
    assert abs(got["a"] - sum(exact) / len(exact)) < 0.04 and got["b"] == 1.0 and set(got) == {"a", "b"}


def test_rrf_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "query_id int, doc_id int, rank int")
    x, y = ({(r.doc_id, round(r.rrf, 12)) for r in retrieval.rrf_fuse(*p).collect()} for p in ((a, b), (b, a)))
    assert x == y and (11, round(1 / 62 + 1 / 61, 12)) in x


# --- trends -------------------------------------------------------------------------------------------

def test_history_starts_at_first_appearance(spark):
    rows = [("a", p, 4, 0) for p in range(5)] + [("late", 2, 3, 0), ("late", 4, 3, 0), ("new", 4, 6, 6), ("gone", 0, 9, 0), ("gone", 1, 9, 0)]
    p = spark.createDataFrame(rows, "topic string, period_idx int, n long, neg long")
    s = {r.topic: r for r in trends.topic_baseline(p).collect()}
    assert (s["a"].mean_n, s["a"].std_n, s["a"].z) == (4.0, 0.0, 0.0)
    assert (s["late"].history, s["late"].mean_n) == (2, 1.5)          # periods 2 and 3, not 0 to 3
    assert s["new"].history == 0 and s["new"].z is None
    alerts = {(r.alert_type, r.topic) for r in trends.detect_trends(p).collect()}
    assert ("emerging", "new") in alerts and ("emerging", "late") not in alerts
    silent = {r.topic: r.baseline_avg for r in trends.silent_topics(p).collect()}
    assert silent == {"gone": 4.5}                                     # all four earlier periods count


def test_too_few_periods(spark):
    p = spark.createDataFrame([("a", 0, 1, 0), ("a", 1, 9, 0)], "topic string, period_idx int, n long, neg long")
    assert trends.detect_trends(p).count() == 0


def test_run_deltas_edges(spark):
    s = "metric_group string, metric string, value double"
    prev = spark.createDataFrame([("total", "t", 9052.0), ("churn", "churn", 47.0), ("entity", "G", 137.0), ("entity", "T", 166.0), ("signal", "a", 100.0), ("signal", "b", 100.0), ("signal", "c", 0.0), ("topic", "old", 5.0)], s)
    cur = spark.createDataFrame([("total", "t", 9449.0), ("churn", "churn", 49.0), ("entity", "G", 167.0), ("entity", "T", 260.0), ("signal", "a", 114.0), ("signal", "b", 130.0), ("signal", "c", 50.0), ("topic", "old", 5.0), ("topic", "two", 2.0), ("topic", "many", 56.0)], s)
    got = {r.metric: (r.delta, r.pct_change, r.severity) for r in trends.run_deltas(cur, prev).collect()}
    assert got == {"t": (397, None, "info"), "churn": (2, None, "high"), "G": (30, 22, "medium"), "T": (94, 57, "medium"), "b": (30, 30, "high"), "many": (56, None, "medium")}


def test_gold_sample_is_stable(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("s"))
    a = {r.id for r in evaluation.stratified_gold_sample(d, ["s"], "id", 200).collect()}
    b = {r.id for r in evaluation.stratified_gold_sample(d.repartition(7), ["s"], "id", 200).collect()}
    assert a == b and len(a) <= 200


# --- sources -----------------------------------------------------------------------------------------------

def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "one", "score": 3}, {"text": "two"}]))
    (tmp_path / "broken.json").write_text("{not json")
    good, bad = readers.split_corrupt(readers.read_posts_json(spark, [str(tmp_path / n) for n in ("a.json", "missing.json", "broken.json")]).cache())
    assert sorted(r.text for r in good.collect()) == ["one", "two"] and bad.count() == 1
    (tmp_path / "env.json").write_text(json.dumps({"items": [{"raw_text": "see http://x.y café"}, {"text": " "}]}))
    env = readers.read_posts_envelope(spark, [str(tmp_path / "env.json"), str(tmp_path / "a.json")], F.lit("2024-01-01").cast("date")).collect()
    assert sorted(r.text for r in env) == ["one", "see caf", "two"]
    assert {r.post_id for r in env if r.text == "one"} == {hashlib.md5(b"one").hexdigest()}


def test_source_from_path(spark):
    paths = ["/data/reddit_x.json", "/d/x_posts.json", "/d/extra.txt", "/d/bsky.json", "/d/community.json"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(readers.infer_source(F.col("p"))).collect()]
    assert got == ["Reddit", "Twitter/X", "Unknown", "Bluesky", "Forums"]


def test_listing_and_depth(spark, tmp_path):
    child = lambda **k: {"kind": "t3", "data": k}
    long = "a body that is long enough to be kept"
    payload = {"data": {"children": [child(title="T", selftext=long, id="1", permalink="/p", created_utc=1704067200, thumbnail="self", preview={"images": [{"source": {"url": "http://i?a=1&amp;b=2"}}]}),
                                     child(title=long, selftext="[removed]", id="2"), child(title="short", id="3")]}}
    (tmp_path / "l.json").write_text(json.dumps(payload))
    r = readers.flatten_listing(readers.read_listing_json(spark, [str(tmp_path / "l.json")]), F.lit("2024-05-05").cast("date")).collect()
    assert len(r) == 1 and r[0].text == f"T\n\n{long}" and r[0].image_url == "http://i?a=1&b=2" and str(r[0].post_date) == "2024-01-01"
    c = spark.createDataFrame([("a", "post"), ("b", "a"), ("c", "b"), ("d", "gone")], "id string, parent_id string")
    assert {x.id: x.comment_depth for x in readers.comment_depth(c).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
    <item><title>A long enough title</title><link>http://a</link><description>&lt;p&gt;short&lt;/p&gt;</description><content:encoded><![CDATA[<p>Full <b>body</b> &amp; more</p>]]></content:encoded><pubDate>Mon, 01 Jan 2024 12:00:00 GMT</pubDate><dc:creator>Ann</dc:creator><category>x</category><category>y</category></item>
    <item><title>tiny</title></item></channel></rss>""")
    r = readers.read_feed_xml(spark, [str(tmp_path / "f.xml")], "Feed", F.lit("2024-05-05").cast("date")).collect()
    assert len(r) == 1
    assert (r[0].text, r[0].username, str(r[0].post_date), r[0].categories, r[0].source) == ("A long enough title\n\nFull body & more", "Ann", "2024-01-01", ["x", "y"], "News:Feed")


def test_markdown_and_cards(spark):
    d = spark.createDataFrame([("c1", "T", "B", ["x"], "sum", ["q1"], [])], "cluster_id string, title string, brand string, topic_focus_tags array<string>, summary string, quotes array<string>, top_ideas array<string>")
    v = sinks.card_markdown(d).first()[0]
    assert v.startswith("# Cluster: T\n- Brand: B\n- Tags: x") and "> q1" in v and "Suggestions" not in v


# --- streaming -----------------------------------------------------------------------------------------------

def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, text string"
    batches = [[("2024-01-01 10:00:00", "vault"), ("2024-01-05 10:00:00", "vault")], [("2024-01-06 10:00:00", "vault")],
               [("2024-01-01 11:00:00", "vault late"), ("2024-01-09 10:00:00", "psa")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "t string, text string").select(F.to_timestamp("t").alias("ts"), "text").coalesce(1).write.mode("append").parquet(src)
    s = st.read_stream(spark, src, schema, files_per_trigger=1)
    out = st.run_to_table(st.trend_counts(s, rules.Pack.words("k", ["vault", "psa"]), "ts", "text"), "append", "late")
    got = {(str(r.day), r.keyword): r.n for r in out.collect()}
    assert got.get(("2024-01-05", "vault")) == 1 and got.get(("2024-01-01", "vault")) == 1  # the late row is dropped
    assert ("2024-01-09", "psa") not in got                              # still open


def test_novel_rows_are_labelled_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for ks in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(k,) for k in ks], "k string").coalesce(1).write.mode("append").parquet(src)
    made = BucketTable(spark, out, "k", "k string, label string", 8)
    seen = []
    label = lambda d: seen.extend(r.k for r in d.collect()) or d.withColumn("label", F.upper("k"))
    st.enrich_novel(st.read_stream(spark, src, "k string", 1), made, label, chk).awaitTermination()
    assert sorted((r.k, r.label) for r in made.read().collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert sorted(seen) == ["a", "b", "c"]


def test_a_deep_page_reads_its_own_ranges(spark):
    rng = random.Random(2)
    values = [rng.randrange(50) for _ in range(5000)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
    kept = ordering.store_order(d, [F.desc("v"), F.asc("id")], parts=16)
    want = sorted(range(5000), key=lambda i: (-values[i], i))
    for number in (0, 77, 499, 10_000, -3):
        got = kept.page(number, 10)
        at = min(max(number, 0), 499)
        assert [r.id for r in got.orderBy(F.desc("v"), "id").collect()] == want[at * 10 : at * 10 + 10]
        assert {(r.page, r.n_pages) for r in got.collect()} == {(at + 1, 500)}
    plan = kept.page(10_000, 10)._jdf.queryExecution().toString()
    assert len(kept.starts) > 8 and "PartitionFilters: [isnotnull(_part" in plan and "Sort" not in plan
    assert [r.id for r in kept.positions().orderBy("position").collect()] == want
    empty = ordering.store_order(d.limit(0), ["v", "id"])
    assert empty.page(3, 10).count() == 0 == empty.positions().count()
