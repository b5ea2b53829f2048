"""Each stage of the pipeline against brute force on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute
from tests.llm.test_operators import lines_brute
from tidemark.llm import toxicity
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in cp.STAGES:
        out.append((docs, written(f(spark, docs, SF))))
        docs = out[-1][1]
    return out


def test_columns_stay(stages):
    assert all(after.columns == cp.COLUMNS for _, after in stages[:-1])


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    score = toxicity.scored(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in score.where("toxic_score_ < 0.7").select("doc_id").collect()}


def test_lines(stages):
    before, after = stages[1]
    want = lines_brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == want
    assert after.where(F.col("n_chars") != F.char_length("text")).isEmpty() or not before.where(F.col("n_chars") != F.char_length("text")).isEmpty()


def test_near_copies(stages):
    before, after = stages[2]
    want = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, (c, _, _) in want.items() if c == i}


def test_benchmark(spark, stages):
    before, after = stages[3]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    wins = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        wins.setdefault(min(10, len(w)), set()).update(runs(w, min(10, len(w))) if w else set())
    clean = {r["doc_id"] for r in before.collect() if not any(runs(words(r["text"]), n) & s for n, s in wins.items())}
    assert {r["doc_id"] for r in after.collect()} == clean


def test_packing_and_run(spark, stages):
    before, after = stages[4]
    assert {r[0] for r in before.select("doc_id").collect()} == {r[0] for r in after.select("doc_id").collect()}
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "n_tokens").collect()))
    assert key(cp.run(spark, SF)) == key(after)


LONG = " ".join(f"token{k}" for k in range(60_000))
SHARED = "this line of more than twenty characters is shared"
ODD = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, LONG, "en", "s", len(LONG)), (4, LONG + " end", "en", "s", None), (None, "a text without an id", "en", "s", 20), (None, None, None, None, None),
       (5, f"first\n{SHARED}", "en", "s", 1), (6, f"second\n{SHARED}", "de", None, 1), (7, f"third\n{SHARED}", "de", "s", 1), (8, "same words here", "en", "s", 1), (8, "same words here", "en", "s", 1), (9, "Same, words HERE!", "en", "s", 1)]


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("node", "seq", "hit_", "kept_", "score", "bin_id", "toxic_score_")})
    name, f = cp.STAGES[stage]
    out = f(spark, docs, SF)
    rows = out.collect()
    ids = sorted(r["doc_id"] or 0 for r in rows)
    if stage < 4:
        assert out.columns == cp.COLUMNS
    if name == "toxicity":
        assert ids == sorted(r[0] or 0 for r in ODD)
    if name == "line_dedup":
        text = {r["doc_id"]: r["text"] for r in rows if r["doc_id"]}
        assert len(rows) == len(ODD) and (text[5], text[6], text[7]) == ("first", "second", f"third\n{SHARED}") and text[1] is None and text[3] == LONG
        assert {r["doc_id"]: r["n_chars"] for r in rows}[5] == 5
    if name == "ngram_jaccard_join":
        assert ids == [0, 0, 1, 2, 3, 5, 6, 7, 8, 8]
    if name == "benchmark_decontamination":
        item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()["text"]
        marked = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit("x " * 30_000 + item)}))
        assert ids == sorted(r[0] or 0 for r in ODD) == sorted(r["doc_id"] or 0 for r in f(spark, marked, SF).collect())
    if name == "best_fit_packing":
        tokens = {}
        for r in rows:
            tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
        assert tokens[3] == 60_000 and tokens[4] == 60_001 and tokens[1] == tokens[2] == 0 and tokens[8] == 6
        assert all((r["bin_id"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert f(spark, docs.limit(0), SF).count() == 0
