import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join as jj
from tidemark.llm.common import shingles, word_hashes


def brute(rows):
    """(doc_id -> class, copy_of, n_links) by comparing all pairs of texts."""
    import re

    sets, seqs = {}, {}
    for i, t in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if ws:
            n = min(5, len(ws))
            sets[i], seqs[i] = {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)}, tuple(ws)
    first = {}
    for i in sorted(seqs):
        first.setdefault(seqs[i], i)
    node = {i: first[seqs[i]] for i in seqs}
    nodes = sorted(set(node.values()))
    inv = {}
    for i in nodes:
        for s in sets[i]:
            inv.setdefault(s, []).append(i)
    links = {i: set() for i in nodes}
    for i in nodes:
        near = {}
        for s in sets[i]:
            for k in inv[s]:
                near[k] = near.get(k, 0) + 1
        for k, c in near.items():
            if k != i and c >= 0.8 * (len(sets[i]) + len(sets[k]) - c) - 1e-9:
                links[i].add(k)
    root = {}
    for i in nodes:
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return {i: (root[node[i]], node[i], len(links[node[i]])) if i in node else (i, i, 0) for i, _ in rows}


def got(df):
    return {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in jj.similar_documents(df).collect()}


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    have = got(docs)
    pairs = lambda m: sum(v[2] for v in m.values())
    assert have.keys() == want.keys()
    assert pairs(have) >= 0.999 * pairs(want)
    assert sum(have[k] != want[k] for k in want) <= 0.001 * len(want)


def test_large_group_needs_several_blocks(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(400):
        ws = list(base)
        for k in rng.integers(0, 300, rng.integers(1, 9)):
            ws[k] = f"x{i}y{k}"
        rows.append((i, " ".join(ws)))
    rows += [(1000, " ".join(f"other{k}" for k in range(50)))]
    want = brute(rows)
    have = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(have[k][2] for k in have) == pytest.approx(sum(v[2] for v in want.values()), rel=2e-3)
    assert sum(have[k][0] != want[k][0] for k in want) <= 2


def test_edge_cases(spark):
    long = " ".join(f"a{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one TWO!"), (5, long), (6, long + " end"), (7, "one two three"), (None, "one two"), (8, "é è"), (8, "é è"), (9, "É è")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("root", F.lit(1))
    out = jj.similar_documents(df).collect()
    have = {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in out}
    assert len(out) == len(rows)
    assert have[4] == (3, 3, 0) and have[6] == (5, 6, 1) and have[7] == (7, 7, 0) and have[9] == (9, 9, 0)
    assert have[1] == (1, 1, 0) and have[2] == (2, 2, 0) and have[None][2] == 0
    assert sorted(r["doc_id"] or 0 for r in jj.keep_one(df).collect()) == [0, 1, 2, 3, 5, 7, 8, 8, 9]
    assert jj.similar_documents(df.limit(0)).count() == 0


def test_ids_that_repeat_lose_no_link(spark):
    """Every row is judged by its own text; the texts of one id are different nodes."""
    a, b = "alpha " + " ".join(f"p{k}" for k in range(40)), " ".join(f"q{k}" for k in range(120))
    rows = [(1, a), (1, b), (5, b), (6, b + " more")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        out = sorted((r["doc_id"], r["class_id"], r["copy_of"], r["n_links"]) for r in jj.similar_documents(df).collect())
        assert out == [(1, 1, 1, 0), (1, 1, 1, 1), (5, 1, 1, 1), (6, 1, 6, 1)]
        assert sorted((r["doc_id"], r["text"]) for r in jj.keep_one(df).collect()) == [(1, a), (1, b)]


def test_prefixes_shorten_until_the_recall_is_reached(spark):
    """Near-identical texts are met at the longest prefixes; looser ones need shorter ones, down to the depth for the threshold."""
    rng = np.random.default_rng(8)

    def steps(changes):
        rows = []
        for i in range(60):
            base = [f"w{k}" for k in rng.integers(0, 10**6, 200)]
            for c in range(2):
                ws = list(base)
                for k in rng.integers(0, 200, changes * c):
                    ws[k] = f"x{i}y{k}"
                rows.append((2 * i + c, " ".join(ws)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        depths = range(jj.depth_for(), jj.LONGEST + 1)
        sk = jj.sketches(df, depths).withColumn("node", F.col("doc_id"))
        return [d for d, _ in jj.forest_edges(sk, depths)[1]]

    assert steps(1) == [jj.LONGEST]
    assert steps(5)[:2] == [jj.LONGEST, jj.LONGEST - 1]


def test_depth_meets_recall():
    d = jj.depth_for()
    assert 1 - (1 - 0.8**d) ** jj.TREES >= jj.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jj.TREES


def test_hashes_depend_on_words_alone():
    a, b = word_hashes("The cat, THE dog"), word_hashes("xx the cat the dog")
    assert a[0] == a[2] and (a == b[1:]).all() and len(set(a.tolist())) == 3
    assert len(shingles(a, 5)) == 1 and len(shingles(word_hashes(None), 5)) == 0
