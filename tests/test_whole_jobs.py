"""Queries and plans that do their whole job, on rows of their own."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import rules
from tidemark.operators import clustering, dedup
from tidemark.plans import weekly

M = rules.load_packs("marketplace")
POST = "post_id long, pos long, text string, title string, source string, subreddit string, url string, username string, post_date date, score long, like_count long, num_comments long"


def _posts(spark, texts, title=""):
    return spark.createDataFrame([(i, i, t, title, "Reddit", "", f"u{i}", "a", dt.date(2024, 1, 1), 10 * i, 0, 0) for i, t in enumerate(texts)], POST)


#: The three that name a rival form a theme.
RIVALS = ["ebay seller fee: the commission is too high and terrible",
          "ebay seller fee: " + "and so on " * 12 + "leaving ebay for whatnot, worst commission ever" + " and on" * 40,
          "ebay seller fee: the commission is too high, listed on whatnot too, terrible",
          "ebay seller fee, stop using it, commission compared to fanatics"]


def test_lsh_candidates_gives_every_pair_with_its_distance(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(50)] for _ in range(4)]
    texts = [" ".join([*b[: rng.randint(46, 50)], *rng.choices(words, k=rng.randint(0, 1))]) for b in base for _ in range(8)] + [" ".join(base[0])] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    hashes = sorted({r.simhash for r in dedup.with_simhash(docs).collect()})
    far = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    want = sorted((a, b, far(a, b)) for a in hashes for b in hashes if a < b and far(a, b) <= 5)
    got = entry.queries()["lsh_candidates"](spark, str(tmp_path))
    assert got.columns == ["a", "b", "distance"] and sorted(map(tuple, got.collect())) == want and len(want) > 4


def test_theme_cards_carry_every_part_of_a_card(spark, tmp_path):
    """Brand, label sets, readiness, ideas and quotes of a theme, by hand."""
    rows = _posts(spark, RIVALS).withColumn("ideas", F.array(F.lit("Show the fees earlier"), F.lit("short"), F.when(F.col("post_id") == 2, "Match whatnot on commission")))
    run = weekly.weekly_run(spark, rows, M, F.lit("2024-03-01").cast("date"), str(tmp_path / "a"))
    (card,) = run.cards.collect()
    assert card.workstream == card.theme == card.title == "Competitive Positioning" and (card.insight_count, card.min_score, card.max_score) == (3, 10, 30)
    # (score + 5 x frustration + 5 x impact) / 3; the first two are complaints.
    assert card.avg_cluster_ready == pytest.approx(((10 + 15 + 10) / 3 + (20 + 15 + 10) / 3 + (30 + 5 + 10) / 3) / 3)
    assert card.brand == "Whatnot" and card.type == "Churn Signal" and card.sentiments == ["Negative", "Neutral"] and card.mentions_competitor == ["fanatics", "whatnot"]
    assert card.opportunity_tags == ["Competitor Signal", "Retention Risk"] and card.effort_levels == ["High"]
    assert card.top_ideas == ["Show the fees earlier", "Match whatnot on commission"]
    # Two name a keyword of the theme, the complaint first; a long text is cut around it.
    at = RIVALS[1].index("leaving ebay")
    assert card.quotes == [f"- _{('…' + RIVALS[1][at - 90 : at + 130].strip() + '…')[:220]}_", f"- _{RIVALS[3]}_"]


def test_a_theme_without_quotes_says_so(spark, tmp_path):
    """Texts of less than 40 characters are counted but not quoted."""
    run = weekly.weekly_run(spark, _posts(spark, [f"ebay seller fee problem {i} bad" for i in range(3)]), M, F.lit("2024-03-01").cast("date"), str(tmp_path / "a"))
    card = run.cards.first()
    assert card.insight_count == 3 and card.quotes == [weekly.NO_QUOTES] and card.top_ideas == [] and card.effort_levels == ["Unknown"]


def test_weekly_run_writes_all_it_returns(spark, tmp_path):
    """Cards with their quotes, the distribution of sources and the changes since the run before lie below the folder."""
    as_of = F.lit("2024-03-01").cast("date")
    fees = [f"ebay seller fee problem number {i}, the commission is too high" for i in range(6)]
    first = weekly.weekly_run(spark, _posts(spark, RIVALS + fees), M, as_of, str(tmp_path / "a"))
    second = weekly.weekly_run(spark, _posts(spark, RIVALS[:2]), M, as_of, str(tmp_path / "b"), previous=first.snapshot)
    for name, run in (("a", first), ("b", second)):
        meta = spark.read.parquet(f"{tmp_path}/{name}/meta").collect()
        assert meta == run.meta.collect() and meta[0].source_distribution == {"Reddit": run.insights.count()}
    cards = {r.workstream: r for r in spark.read.parquet(f"{tmp_path}/a/clusters/cards").collect()}
    assert cards == {r.workstream: r for r in first.cards.collect()}
    assert {w: len(r.quotes) for w, r in cards.items()} == {"Competitive Positioning": 2, "Seller Economics & Fees": 3}
    deltas = {r.metric for r in spark.read.parquet(f"{tmp_path}/b/deltas").collect()}
    assert first.deltas is None and "fees" in deltas and deltas == {r.metric for r in second.deltas.collect()}


@pytest.mark.parametrize("rows", [3, 16, 1_000])
def test_glued_blocks_in_tiles_agree_with_brute_force(rows):
    """Frequent and rare words, numbered or whole, copies, and sets without a common word between them."""
    rng = np.random.default_rng(4)
    often = np.sort(np.array([5, 9, 11, *range(100, 140)]))
    shared = np.array([5, 9, 1_007])
    sets = sorted({tuple(sorted({int(rng.choice(shared)), *rng.choice(often[2:], rng.integers(0, 30)).tolist(), *rng.integers(1_000, 1_030, rng.integers(0, 9)).tolist()})) for _ in range(70)})
    w = rng.integers(1, 4, len(sets)).astype(float)

    def table(which):
        code = [[int(np.searchsorted(often, x)) - (1 << 15) for x in sets[i] if x in often] for i in which]
        return pa.table({"code": pa.array(code, pa.list_(pa.int16())), "rest": pa.array([[x for x in sets[i] if x not in often] for i in which], pa.list_(pa.int64())), "w": w[which]})

    def share(i, j):
        x, y = set(sets[i]), set(sets[j])
        return len(x & y & set(shared.tolist())) / len(x | y)

    a, b = np.arange(len(sets))[::2], np.arange(len(sets))[1::2]
    assert clustering.glued(table(a), table(b), often, shared, rows) == pytest.approx(sum(w[i] * w[j] * share(i, j) for i in a for j in b), rel=1e-12)
    own = sum(w[i] * w[j] * share(i, j) for i in a for j in a if i < j) + sum(w[i] * (w[i] - 1) / 2 * share(i, i) for i in a)
    assert clustering.glued(table(a), None, often, shared, rows) == pytest.approx(own, rel=1e-12)


def test_a_large_cluster_is_many_tasks(spark, monkeypatch):
    """The units of one cluster's grid are tasks of their own; before, a cluster was one task."""
    monkeypatch.setattr(clustering, "PAIRS_PER_TASK", 50)
    d = spark.createDataFrame([("a", i, f"refund w{i % 7} v{i}") for i in range(60)], "g string, id int, text string")
    plan = clustering.overlap_penalty(d, ["g"], "id", F.col("text"), block_rows=10)
    assert "21), REPARTITION_BY_NUM" in plan._jdf.queryExecution().toString() or "21, REPARTITION_BY_NUM" in plan._jdf.queryExecution().toString()
    want = sum(1 / (5 - (i % 7 == j % 7)) for i in range(60) for j in range(i)) / (60 * 59 / 2)
    assert plan.first()["penalty"] == pytest.approx(min(0.15, 0.6 * want), abs=1e-9)


def test_words_that_most_sets_hold_are_numbered(spark):
    """Ties at the cut stay out, so no more than asked for come to the driver."""
    d = spark.createDataFrame([([1, 2, 3],), ([1, 2, 4],), ([1, 5, 6],), ([1, 5, 7],)], "tok array<bigint>")
    assert [clustering._frequent(d, most).tolist() for most in (0, 1, 2, 3, 6, 7)] == [[], [1], [1], [1, 2, 5], [1, 2, 5], [1, 2, 3, 4, 5, 6, 7]]
