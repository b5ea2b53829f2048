"""Cells of vectors and the stored search index: equal to brute force, and how much they leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import tokens_retrieval
from tidemark.operators import cells, clustering, retrieval, search_index


@pytest.fixture(scope="module")
def clustered(spark):
    """Thirty tight clusters of unit vectors, some repeated, one without a vector."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 12))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 40, axis=0) + rng.standard_normal((1200, 12)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[5]
    rows = [(i, "even" if i % 2 == 0 else "odd", v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, (5000, "odd", None)], "id long, half string, vec array<double>").cache()


def pairs_of(x, eps, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    i, j = np.nonzero(np.triu(1 - x @ x.T <= eps, 1))
    return {(int(ids[a]), int(ids[b])) for a, b in zip(i, j)}


def test_far_blocks_never_meet(clustered):
    x, df = clustered
    made = cells.build_cells(df, [], "id", block_rows=40)
    n = made.blocks.count()
    met = cells.near_blocks(made, 0.05).count()
    assert n >= 30 and met < n * (n + 1) / 2 * 0.4
    assert made.rows.count() == 1200 and made.blocks.agg(F.sum("n")).first()[0] == 1200
    got = clustering.eps_neighbours(df, 0.05, block_rows=40)
    assert {(r["a"], r["b"]) for r in got.collect()} == pairs_of(x, 0.05)
    halves = clustering.eps_neighbours(df, 0.05, ["half"], block_rows=40).collect()
    even = np.arange(0, 1200, 2)
    assert {(r["a"], r["b"]) for r in halves if r["half"] == "even"} == pairs_of(x[even], 0.05, even)


def brute_dbscan(x, eps, least):
    near = 1 - x @ x.T <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(1), -1)
        if (new == label).all():
            break
        label = new
    out = {i: int(label[i]) for i in np.flatnonzero(core)}
    for i in np.flatnonzero(~core):
        around = [label[j] for j in np.flatnonzero(near[i] & core)]
        if around:
            out[int(i)] = int(min(around))
    return out


@pytest.mark.parametrize("eps", [0.004, 0.05])
def test_clusters_equal_brute_force(clustered, eps):
    x, df = clustered
    got = {r["id"]: r["cluster"] for r in clustering.dbscan_cosine(df, eps, 4, block_rows=50).collect()}
    assert got == brute_dbscan(x, eps, 4)


def test_best_first_opens_few_cells(spark, clustered, monkeypatch):
    x, df = clustered
    made = cells.build_cells(df.withColumnRenamed("id", "doc_id"), [], "doc_id", block_rows=40)
    opened = []
    plain = cells._search
    monkeypatch.setattr(cells, "_search", lambda c, q, wanted, *a: opened.append(wanted.count()) or plain(c, q, wanted, *a))
    asked = df.where("id % 100 = 3").select(F.col("id").alias("query_id"), "vec")
    got = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.dense_topk(made, asked, 10).collect()}
    want = set()
    for q in range(3, 1200, 100):
        sims = x @ x[q]
        want |= {(q, int(d), k) for k, d in enumerate(np.lexsort((np.arange(1200), -sims))[:10]) if sims[d] > retrieval.MIN_COSINE}
    assert got == want
    assert sum(opened) < 12 * made.blocks.count() * 0.4
    assert got == {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.dense_topk(df.withColumnRenamed("id", "doc_id").drop("half"), asked, 10, chunk_rows=5, block_rows=100).collect()}


def test_cells_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert clustering.eps_neighbours(empty, 0.1).count() == 0 == clustering.dbscan_cosine(empty).count()
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    assert retrieval.dense_topk(cells.build_cells(empty.withColumnRenamed("id", "doc_id"), [], "doc_id"), asked).count() == 0
    assert retrieval.dense_topk(empty.withColumnRenamed("id", "doc_id"), asked).count() == 0


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 30)), p=np.arange(400, 0, -1) / 80_200))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "the of"), (2003, "w399 w399 w398"), (2004, "w399 w399 w398")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_stored_index_equals_scoring_everything(spark, library):
    asked = spark.createDataFrame([(1, "w399 w398"), (2, "w1 w2 w3 w1"), (3, "nowhere"), (4, None), (5, "W7, w399!")], "query_id long, query string")
    index = search_index.write_index(library, "doc_id", F.col("text"), buckets=16, block_docs=20)
    for k in (3, 50, 5000):
        want = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.bm25_topk(library, asked, "doc_id", F.col("text"), k).collect()}
        got = {(r["query_id"], r["doc_id"], r["rank"]) for r in search_index.search(index, asked, k).collect()}
        assert got == want and want
    counts = {r["query_id"]: (r["blocks"], r["opened"]) for r in search_index.opened(index, asked, 3).collect()}
    assert counts[1][1] <= counts[1][0] / 2  # a rare word: half the blocks that hold it cannot reach the third score
    words = index.terms.agg(F.sum("df"), F.count(F.lit(1))).first()
    direct = library.select("doc_id", F.explode(F.array_distinct(tokens_retrieval(F.col("text")))).alias("t"))
    assert (words[0], words[1]) == (direct.count(), direct.select("t").distinct().count())


def test_a_search_reads_its_partitions_only(spark, library):
    index = search_index.write_index(library, "doc_id", F.col("text"), buckets=16)
    asked = spark.createDataFrame([(1, "w5")], "query_id long, query string")
    plan = search_index.search(index, asked)._jdf.queryExecution().toString()
    blocks = [line for line in plan.splitlines() if "FileScan" in line and "/blocks" in line]
    bucket = spark.range(1).select(search_index.bucket_of(F.lit("w5"), 16)).first()[0]
    assert blocks and all(f"PartitionFilters: [isnotnull(bucket" in b and f"= {bucket})" in b for b in blocks)
    assert "regexp" not in plan and "split(" not in plan


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w5")], "query_id long, query string")
    index = search_index.write_index(empty, "doc_id", F.col("text"))
    assert index.n == 0 and search_index.search(index, asked).count() == 0


def test_the_overlap_sketch_is_close_to_all_pairs(spark):
    rng = np.random.default_rng(12)
    words = [*clustering.COMMON_TOKENS[:12], *(f"w{i}" for i in range(60))]
    rows = [(i, i % 3, " ".join(rng.choice(words, 12, replace=False))) for i in range(240)]
    d = spark.createDataFrame(rows, "id long, g int, text string")
    exact = {r["g"]: r["penalty"] for r in clustering.overlap_penalty(d, ["g"], "id", F.col("text")).collect()}
    sketch = {r["g"]: r["penalty"] for r in clustering.overlap_penalty_sketch(d, ["g"], "id", F.col("text")).collect()}
    assert exact.keys() == sketch.keys() and all(0 < exact[g] < 0.15 and abs(exact[g] - sketch[g]) < 0.01 for g in exact)


def test_the_index_is_its_lists_alone_and_searches_as_the_direct_form_does(spark):
    import os

    rows = [(i % 60 if i % 9 else None, " ".join(f"w{(i * j) % 23}" for j in range(1, i % 13 + 2)) if i % 17 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 1} w7") for q in range(20)] + [(90, "nothing"), (91, None)], "query_id long, query string")
    index = search_index.write_index(docs, "doc_id", F.col("text"), buckets=4, block_docs=8)
    assert {f for f in os.listdir(index.path) if not f.startswith((".", "_"))} == {"blocks", "terms"} and index.n == 200
    for k, first in ((3, 1), (50, None)):
        found = {(r["query_id"], r["doc_id"], r["rank"], r["bm25"]) for r in search_index.search(index, asked, k, first).collect()}
        assert found == {(r["query_id"], r["doc_id"], r["rank"], r["bm25"]) for r in retrieval.bm25_topk(docs, asked, "doc_id", F.col("text"), k).collect()}
    pairs = asked.select(F.struct("query_id", F.lit(1).alias("variant")).alias("query_id"), "query")
    assert search_index.search(index, pairs, 5).count() == search_index.search(index, asked, 5).count() > 0
