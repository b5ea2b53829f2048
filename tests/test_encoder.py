"""The fitted encoder against a dense SVD of the same matrix."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import encoder as en, retrieval

SF = "/root/testdata/sf0.001"


def dense_matrix(spark, docs, encoder):
    rows = docs.orderBy("doc_id").select(en.hashed(F.coalesce("text", F.lit("")), encoder.features).alias("h")).collect()
    a = np.zeros((len(rows), encoder.features))
    for i, r in enumerate(rows):
        for c in r["h"]:
            a[i, c] += 1
    a *= encoder.idf
    size = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(size > 0, size, 1)


def test_reconstruction_close_to_the_dense_svd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    e = en.fit(docs, F.col("text"), dim=20, features=1024)
    a = dense_matrix(spark, docs, e)
    _, s, _ = np.linalg.svd(a, full_matrices=False)
    assert abs(e.energy - (a * a).sum()) < 1e-8
    best = (s[20:] ** 2).sum()  # what the best 20 directions leave
    left = np.linalg.norm(a - a @ e.vectors @ e.vectors.T) ** 2
    assert best - 1e-9 <= left <= best * 1.02
    assert np.allclose(e.singular[:4], s[:4], rtol=1e-5) and np.allclose(e.singular, s[:20], rtol=0.1)
    assert np.allclose(e.vectors.T @ e.vectors, np.eye(20), atol=1e-9)
    got = en.encode(docs, F.col("text"), e, share="share").orderBy("doc_id").collect()
    x = a @ e.vectors
    for r, v in zip(got, x):
        size = np.linalg.norm(v)
        assert abs(r["share"] - size) < 1e-9
        assert np.allclose(r["vec"], v / size if size > 0 else v, atol=1e-6)


def test_new_and_empty_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta gamma", "alpha beta delta", "omega psi chi", "omega psi phi", None, "", "the of"] * 3)], "doc_id long, text string")
    e = en.fit(docs, F.col("text"), dim=3, features=256)
    new = spark.createDataFrame([(1, "beta alpha"), (2, "psi omega"), (3, None), (4, "unseen words")], "query_id long, text string")
    v = {r["query_id"]: np.array(r["vec"]) for r in en.encode(new, F.col("text"), e).collect()}
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-5 and not v[3].any()
    assert v[1] @ v[2] < 0.1  # different themes are far apart
    vectors = en.encode(docs, F.col("text"), e).select("doc_id", "vec")
    top = retrieval.dense_topk(vectors, en.encode(new, F.col("text"), e).select("query_id", "vec").where("query_id < 3"), 6).collect()
    assert {r["doc_id"] % 7 for r in top if r["query_id"] == 1} == {0, 1} and {r["doc_id"] % 7 for r in top if r["query_id"] == 2} == {2, 3}
    assert en.encode(docs.limit(0), F.col("text"), e).count() == 0
