"""Models learn from every labelled row, in places that no single task hands out; rows by turn go through their layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, quality, toxicity


def test_every_labelled_row_outside_the_held_out_fold(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.union(spark.createDataFrame([(None, 1), (2, None), (4, 1)], "doc_id long, quality int"))
    own = common.labelled(labels, "quality")
    assert own.count() == spark.range(30_000).where(~common.held_out(F.col("id"))).count()
    assert {r["quality"] for r in own.where("doc_id = 4").collect()} <= {1}


def test_places_and_quantiles_from_ranges(spark):
    x = np.random.default_rng(7).integers(0, 50, 999) / 7
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, s double").repartition(5)
    rows = common.numbered(df, [F.col("s"), F.col("id")], "i").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(999)) and [r["s"] for r in rows] == sorted(x)
    for share in (0.0, 0.123, 0.5, 1.0):
        assert quality._quantile(df.select("s"), "s", share, 999) == pytest.approx(np.quantile(x, share))
    assert quality._quantile(df.limit(1).select("s"), "s", 0.4, 1) in x


def test_rows_by_turn_are_mapped_by_their_layout(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "b", "y\\\"\n"), (1, 0, "a", "x"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = lambda: {r["conv_id"]: [tuple(t) for t in r["turns_"]] for r in chat.turns_of(rows).collect()}
    assert got() == {1: [("a", "x"), ("b", "y\\\"\n")], 2: [("", "")]}
    name, shape, (path, role, text) = chat.LAYOUTS[0]
    monkeypatch.setattr(chat, "LAYOUTS", [(name, shape, (path, text, role)), *chat.LAYOUTS[1:]])
    assert got() == {1: [("x", "a"), ("y\\\"\n", "b")], 2: [("", "")]}


def test_no_text_is_moved_to_its_label(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 7) + ("ok." if i % 2 else "|| !!")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    plans = []
    monkeypatch.setattr(quality, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.written(df))
    assert not isinstance(quality.fit(docs, labels), float)
    join = plans[0][plans[0].index("Join"):]
    assert "MapInArrow" in join and "rightHint=(strategy=merge)" in join


def test_each_term_is_one_row_and_labels_stay_where_they_are(spark, monkeypatch):
    texts = ["bad Badly good", "bad", "", None, "good goods BAD", "fine", "bad good", "bad"] * 6
    rows = spark.createDataFrame([(t, k % 2, (k // 2) % 2) for k, t in enumerate(texts)], "text string, half int, mark int").repartition(3)
    want = {}
    for k, t in enumerate(texts):
        for e in {e for w in (t or "").lower().split() for e in toxicity.entries(w)}:
            want.setdefault(e, [0] * 4)[2 * (k % 2) + (k // 2) % 2] += 1
    counts = toxicity.term_counts(rows)
    assert sorted(map(tuple, counts.collect())) == sorted((e, *n) for e, n in want.items())
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    plans = []
    monkeypatch.setattr(toxicity, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or common.written(df))
    assert not isinstance(toxicity.fit(docs, spark.range(48).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))), float)
    assert "ShuffledHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_features_of_odd_texts():
    text = "You're SO b4d!! s.t.u.p.i.d  Sooo \u00c9\u00c9\u00c9 a-b :-) \u4e2d\u6587\u3002 AAA___111"
    got = dict(zip(toxicity.NAMES, toxicity.features_of({"stupid": 0.9, "bad": 0.7, "so": 0.5})()(text)))
    n = len(toxicity._WORD.findall(text.lower()))
    assert got["capitals"] == sum(map(str.isupper, text)) / len(text) and got["punctuation"] == len(toxicity._PUNCT.findall(text)) / n
    assert got["elongated"] == 3 / n and got["decoded_hits"] == 0.9 and got["second_near_hit"] == 1.0 and got["repeated_marks"] == 1 / n


def test_tasks_without_a_kind_of_row_count_nothing(spark):
    rows = spark.createDataFrame([("bad", 0, 1), ("good", 1, 0)], "text string, half int, mark int").repartition(5)
    assert {tuple(r) for r in toxicity.term_counts(rows).collect()} == {("bad", 0, 1, 0, 0), ("good", 0, 0, 1, 0), ("good*", 0, 0, 1, 0)}
