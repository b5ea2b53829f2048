"""Pair work whose copies and memory are bounded: against plain brute force on rows of their own."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, cells, clustering, dedup, encoder, retrieval


def test_a_row_is_copied_to_a_bounded_number_of_blocks(spark):
    d = blocks.block_pairs(blocks.assign_blocks(spark.range(5_000), [], "id", 10))
    assert d.groupBy("id").count().agg(F.max("count")).first()[0] <= blocks.MAX_BLOCKS
    few = blocks.assign_blocks(spark.range(100), [], "id", 10)
    assert few.first()["_nblk"] == 10  # small groups keep the size asked for


def test_overlap_penalty_with_copies_and_many_tiles(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["refund", "item", "order", *[f"w{k}" for k in range(40)]]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 12))) for _ in range(60)]
    rows = [("a", i, t) for i, t in enumerate(texts + texts[:25])] + [("b", 1, "refund one"), ("c", 1, "none here"), ("c", 2, "nothing at all")]
    d = spark.createDataFrame(rows, "g string, id int, text string")
    got = {r["g"]: r["penalty"] for r in clustering.overlap_penalty(d, ["g"], "id", F.col("text"), block_rows=7).collect()}
    sets = [set(t.split()) for g, _, t in rows if g == "a"]
    common = set(clustering.COMMON_TOKENS)
    mean = np.mean([len(x & y & common) / len(x | y) for x, y in itertools.combinations(sets, 2)])
    assert got["a"] == pytest.approx(min(0.15, 0.6 * mean), abs=1e-9) and got["b"] == got["c"] == 0.0


def _unit(rng, n, dim=8):
    a = rng.standard_normal((n, dim))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


@pytest.mark.parametrize("scale", [1.0, 1e20, 1e-30])
def test_near_tiles_agree_with_double_precision(monkeypatch, scale):
    monkeypatch.setattr(cells, "TILE", 500)
    a = _unit(np.random.default_rng(1), 120)
    a[3] = a[4]
    eps = 1 - float(a[0] @ a[1]) * scale * scale  # exactly one pair on the bound
    got = np.zeros((120, 120), bool)
    for start, mask in cells.near_tiles(a * scale, a * scale, eps):
        got[start : start + len(mask)] = mask
    clear = np.abs(1 - (a @ a.T) * scale * scale - eps) > 1e-12 * max(1, scale * scale)
    assert (got == (1 - (a * scale) @ (a * scale).T <= eps))[clear].all()


def test_large_groups_have_larger_blocks_not_more(spark):
    a = _unit(np.random.default_rng(2), 1_500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vec array<double>")
    made = cells.build_cells(df, [], "id", block_rows=10)
    assert made.blocks.count() <= 2 * cells.MAX_CELLS and made.rows.count() == 1_500
    met = {tuple(r) for r in cells.met_blocks(made.rows, 0.05, block_rows=100).collect()}
    at = {r["id"]: r["_blk"] for r in made.rows.collect()}
    close = np.argwhere(np.triu(1 - a @ a.T <= 0.05, 1))
    assert met == {tuple(sorted((at[i], at[j]))) for i, j in close}
    assert met <= {tuple(r) for r in cells.near_blocks(made, 0.05).collect()}


def test_density_clusters_of_many_blocks_and_copies(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([_unit(rng, 300, 4), _unit(rng, 20, 4).repeat(3, axis=0)])
    df = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(a)], "g int, id long, vec array<double>")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in clustering.dbscan_cosine(df, 0.02, 4, ["g"], block_rows=9).collect()}
    want = {}
    for g in (0, 1):
        ids = np.arange(len(a))[np.arange(len(a)) % 2 == g]
        near = 1 - a[ids] @ a[ids].T <= 0.02
        np.fill_diagonal(near, True)
        core = near.sum(1) >= 4
        label = np.where(core, ids, 1 << 40)
        while True:
            new = np.where(core, np.where(near & core[None, :], label[None, :], 1 << 40).min(1), label)
            if (new == label).all():
                break
            label = new
        edge = np.where(near & core[None, :], label[None, :], 1 << 40).min(1)
        want |= {int(ids[k]): (int(edge[k]), bool(core[k])) for k in range(len(ids)) if edge[k] < 1 << 40}
    assert got == want and any(not c for _, c in got.values())


def test_best_rows_take_a_few_questions_at_a_time(monkeypatch):
    a = _unit(np.random.default_rng(4), 90)
    whole = cells.best_rows(np.arange(90), a, np.arange(90), a, 3, -2.0)
    monkeypatch.setattr(cells, "TILE", 200)
    parts = cells.best_rows(np.arange(90), a, np.arange(90), a, 3, -2.0)
    assert whole[["query_id", "doc_id"]].equals(parts[["query_id", "doc_id"]]) and len(parts) == 270


def test_encoder_works_on_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(encoder, "SLICE_WORDS", 5)
    lists = pa.array([[1, 2, 3], None, [], [4, 4], [5] * 9, [], [6]], pa.list_(pa.int32()))
    parts = list(encoder._slices(lists))
    assert pa.concat_arrays(parts).to_pylist() == lists.to_pylist()
    assert [sum(len(t or ()) for t in p.to_pylist()) for p in parts] == [5, 9, 1]
    idf, q = np.ones(8), np.random.default_rng(6).standard_normal((8, 3))
    whole = encoder._times(*encoder._rows(lists, idf), q, len(lists))
    assert np.allclose(whole, np.concatenate([encoder._times(*encoder._rows(p, idf), q, len(p)) for p in parts]))


def test_lexical_scores_of_a_part_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i % 5} beta{i % 3} gamma") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "alpha1 gamma"), (1, "beta2 alpha4")], "query_id long, query string")
    whole = {(r[0], r[1], round(r[2], 9)) for r in retrieval.bm25_scores(docs, asked, "doc_id", F.col("text")).collect()}
    monkeypatch.setattr(retrieval, "PART_SCORES", 4)
    scored = retrieval.bm25_scores(docs, asked, "doc_id", F.col("text"))
    assert "30), REPARTITION_BY_NUM" in scored._jdf.queryExecution().toString()
    assert {(r[0], r[1], round(r[2], 9)) for r in scored.collect()} == whole


def _far_bits(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def _hashes(rng, n=150):
    """Signed hashes in families, with pairs that share several bands."""
    made = {0, -1}
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 5)]
    while len(made) < n:
        h = base[rng.integers(5)] & ((1 << 64) - 1)
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            h ^= 1 << int(bit)
        made.add(h - (1 << 64) if h >> 63 else h)
    return sorted(made)


@pytest.mark.parametrize("hot", [0, 7, 32_768])
def test_near_links_count_every_pair_once_and_name_components(spark, hot):
    """The pairs of a family are folded where they are met, in any number of blocks."""
    hashes = _hashes(np.random.default_rng(3))
    near = {h: [x for x in hashes if x != h and _far_bits(h, x) <= 5] for h in hashes}
    root = {h: h for h in hashes}
    for _ in hashes:
        root = {h: min([root[h], *(root[x] for x in near[h])]) for h in hashes}
    d = spark.createDataFrame([(h,) for h in hashes for _ in range(2)] + [(None,)], "simhash long")
    got = {r["simhash"]: (r["class_id"], r["n_links"]) for r in dedup.near_links(d, hot_bucket=hot).collect()}
    assert got == {h: (root[h], len(near[h])) for h in hashes}
    pairs = [(r["a"], r["b"]) for r in dedup.near_pairs(d, hot_bucket=hot).collect()]
    assert sorted(pairs) == sorted((h, x) for h in hashes for x in near[h] if h < x)


def test_beaten_hashes_are_those_near_a_better_one():
    rng = np.random.default_rng(8)
    h = np.array(_hashes(rng, 400))
    s, p = rng.integers(0, 4, len(h)).astype(float), rng.permutation(len(h)).astype(float)
    p[:9] = np.nan  # without a position: beaten by a better score only
    better = lambda i, j: s[i] > s[j] or (s[i] == s[j] and p[i] < p[j])
    want = {j for j in range(len(h)) if any(_far_bits(int(h[i]), int(h[j])) <= 5 and better(i, j) for i in range(len(h)))}
    assert set(dedup._beaten(h.view(np.uint64), s, p, 5).tolist()) == want


def test_best_scores_in_tiles_are_those_of_every_document(monkeypatch):
    """Ties go to the smaller id, a repeated id adds up, and documents without a word of the question are left out."""
    monkeypatch.setattr(retrieval, "TILE_NUMBERS", 40)
    rng = np.random.default_rng(2)
    words = [(int(d), f"w{t}", float(rng.integers(1, 4))) for d in rng.permutation(60) for t in rng.choice(9, 3, replace=False)]
    words += [(7, "w1", 1.0), (7, "w1", 2.0), (99, "other", 5.0)]
    asked = {"a": {"w1": 1.0, "w2": 0.5}, "b": {"w3": 2.0}, "c": {"none": 1.0}}
    table = pa.table({"doc_id": [w[0] for w in words], "term": [w[1] for w in words], "share": [w[2] for w in words]})
    questions = pa.table({"query_id": list(asked), "terms": [list(v) for v in asked.values()], "weights": [list(v.values()) for v in asked.values()]})
    got = retrieval.best_scores(table, questions, 5).to_pylist()
    for name, weight in asked.items():
        score = {}
        for d, t, s in words:
            if t in weight:
                score[d] = score.get(d, 0.0) + weight[t] * s
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(((r["doc_id"], r["bm25"]) for r in got if r["query_id"] == name), key=lambda x: (-x[1], x[0])) == want


def test_bm25_topk_takes_structs_as_question_ids(spark):
    """Fields that are never null, as the variants of hybrid search have."""
    d = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "a long, query string").select(F.struct("a", F.lit(0).alias("variant")).alias("query_id"), "query")
    got = retrieval.bm25_topk(d, q, "doc_id", F.col("text")).collect()
    assert {(r["query_id"]["a"], r["query_id"]["variant"], r["doc_id"], r["rank"]) for r in got} == {(1, 0, 1, 0), (2, 0, 2, 0)}
