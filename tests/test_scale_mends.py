"""Forms that broke at scale: many range cuts, long reply chains, equal base names, texts that differ late, missing shared folder."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.rules import load_packs
from tidemark.functions.hashing import cache_key
from tidemark.functions.text import strip_html
from tidemark.operators import clustering, dedup, enrich, joins, ordering, retrieval
from tidemark.sources import readers


def test_positions_plan_with_many_buckets(spark):
    d = spark.range(20_000).select((F.col("id") * 7 % 20_011).alias("pos"))
    got = ordering.dense_position(d, "pos", buckets=5_000).agg(F.min("_pos"), F.max("_pos"), F.count_distinct("_pos")).first()
    assert tuple(got) == (0, 19_999, 20_000)


def test_long_reply_chain_is_complete(spark):
    t = spark.range(1_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = readers.comment_depth(t).where("comment_depth <> id").count(), readers.comment_depth(t).count()
    assert got == (0, 1_000)


def test_replies_in_a_circle_are_reported(spark):
    with pytest.raises(ValueError):
        readers.comment_depth(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"))


def test_unfinished_components_are_reported(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        clustering.connected_components(spark.range(201).withColumnRenamed("id", "node"), edges, max_rounds=1)


def test_equal_base_names_keep_their_order(spark, tmp_path):
    for k, folder in enumerate(("b", "a b", "my")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / ("my_posts.json" if folder == "my" else "posts.json")).write_text(json.dumps([{"text": f"t{k}"}]))
    paths = [str(tmp_path / "b/posts.json"), str(tmp_path / "a b/posts.json"), str(tmp_path / "m*")]
    got = {r["text"]: r["file_order"] for r in readers.read_posts_json(spark, paths).collect()}
    assert got == {"t0": 0, "t1": 1, "t2": 2}


def test_texts_that_differ_late_stay_apart(spark):
    long = "same beginning " * 200
    d = spark.createDataFrame([(0, long + "a", 1), (1, long + "b", 1), (2, " " + long.upper() + "A ", 0)], "pos long, text string, score long")
    assert sorted(r["pos"] for r in dedup.dedup_prefix(d).collect()) == [0, 1]
    assert d.select(cache_key(F.col("text"))).distinct().count() == 3


def test_insights_keep_whole_texts(spark):
    text = "word " * 1_000
    d = spark.createDataFrame([(1, text)], "post_id long, text string")
    rows = d.select("*", F.lit("title").alias("title"), F.lit(1).alias("score"), F.lit("s").alias("source"), F.lit("r").alias("subreddit"), F.lit(None).cast("date").alias("post_date"))
    p = load_packs("marketplace")
    out = enrich.enrich_posts(rows, p, F.lit("2024-03-01").cast("date"), normalize=False).first()
    assert out["text"] == text


def test_repeated_keys_on_the_right_never_multiply_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    ideas = spark.createDataFrame([("a", ["x"]), ("a", ["y"])], "text string, ideas array<string>")
    assert sorted((r.doc_id, r.ideas) for r in joins.attach_ideas(rows, ideas).collect()) == [(1, ["y"]), (2, [])]
    keyed = rows.select("doc_id", F.col("text").alias("fingerprint"))
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("a", [1.0, 0.0])], "fingerprint string, vec array<float>")
    got = sorted((r.doc_id, r.matched, r.vec) for r in retrieval.align_vectors(keyed, vectors, 2).collect())
    assert got == [(1, True, [1.0, 0.0]), (2, False, [0.0, 0.0])]


def test_feed_entities_are_all_decoded(spark):
    rows = [(0, "it&#8217;s &rsquo;n&rsquo; &#x27;x&#x27; &amp;lt; caf&eacute;<br>&nbsp;end"), (1, None), (2, "a & b")]
    df = spark.createDataFrame(rows, "i int, h string")
    got = {r.i: r.t for r in df.select("i", strip_html(F.col("h"), all_entities=True).alias("t")).collect()}
    assert got == {0: "it\u2019s \u2019n\u2019 'x' &lt; caf\u00e9 end", 1: "", 2: "a & b"}


def test_a_label_of_many_rows_is_not_one_task(spark):
    rows = spark.range(200).select(F.when(F.col("id") % 9 > 0, "a").otherwise("b").alias("workstream"), F.col("id").cast("string").alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        got = clustering.cluster_workstreams(rows.unionByName(spark.createDataFrame([("c", "x"), ("EXCLUDE", "x")], rows.schema)))
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert {r["workstream"]: r["cluster_size"] for r in got.collect()} == {"a": 177, "b": 23} and got.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_large_pack_is_one_pass_and_labels_as_its_rules_do(spark):
    from tidemark.functions import rules
    from tidemark.functions.text import compact

    many = [f"term{i}" for i in range(40)]
    pack = rules.Pack.of("p", [{"label": "any", "substr": many}, {"label": "word", "word": ["pay", "été", "PSA 10"]}, {"label": "pattern", "regex": [r"\bask\b.{0,3}me", "k(?=z)", "end$", r"a\sb"]},
                               {"label": "both", "all_of": [["pay", "term7"], ["for"]], "none_of": ["never"]}, {"label": "no", "none_of": ["a", "e"]}, {"label": "all", "regex": ["x+"], "all_regex": [r"\d\d", "y"]},
                               {"label": "any", "word": ["again"]}])
    texts = [None, "", "term39 pay for it", "repay", "pay.", "l'été", "étés", "never pay for", "asK me; asK! me", "ask.me", "task me", "kz", "the end\n", "a\x0bb", "a\rb", "XX 12 y", "again", "rook", "PSA 10", "xx y", "term1 term2 again"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    slow = lambda p: compact(F.array(*[F.when(rules.any_of([rules.rule_hit(F.col("t"), r) for r in p.rules if r.label == n]), F.lit(n)) for n in p.labels]))
    plain = rules.Pack("q", tuple(r for r in pack.rules if not (r.word or r.regex)))
    for p in (pack, plain):
        fast = rules.all_labels(F.col("t"), p)
        assert [r[:] for r in df.select("i", fast).collect()] == [r[:] for r in df.select("i", slow(p)).collect()]
        searches = df.select(fast)._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in df.select(fast)._jdf.queryExecution().executedPlan().toString() and searches.count("Contains(") < 40


def test_whole_words_are_looked_for_by_their_letters_first(spark):
    from tidemark.functions import rules

    plan = spark.createDataFrame([("a word",)], "t string").select(rules.contains_word(F.col("t"), ["word"]))
    assert plan.first()[0] and "Contains(" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_periods_read_the_rows_once(spark, tmp_path):
    from tidemark.operators import trends

    spark.createDataFrame([("a", "2024-01-01", True), ("a", "2024-01-01", None), ("a", "2024-01-09", False), (None, "2024-01-02", True), ("b", None, True)], "topic string, day string, bad boolean") \
        .withColumn("day", F.col("day").cast("date")).write.parquet(str(tmp_path / "rows"))
    counts = trends.period_counts(spark.read.parquet(str(tmp_path / "rows")), "topic", "day", F.col("bad"))
    assert sorted(map(tuple, counts.collect()), key=str) == [("a", 0, 2, 1), ("a", 1, 1, 0), (None, 0, 1, 1)]
    assert "parquet" not in counts._jdf.queryExecution().executedPlan().toString().lower()


def test_simhash_by_histogram_is_the_vote_of_all_windows():
    import numpy as np

    from tidemark.functions.hashing import _bits, _signs, simhash_batch

    draw = np.random.default_rng(3)
    for n in (3, 5):
        texts = [bytes(draw.choice(list(b"abcdefgh "), size).tolist()) for size in (0, 1, 2, 3, 9, 60, 4_000, 9_000)]
        wanted = [_bits(sum(_signs(w.decode()) for w in ([t[i : i + n] for i in range(len(t) - n + 1)] or [t]))[None, :])[0] for t in texts]
        assert simhash_batch(texts, n).tolist() == wanted
