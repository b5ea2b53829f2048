"""Whitening, collocations and the curriculum against brute force, and their edge cases."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, curriculum, whitening

SF = "/root/testdata/sf0.01"


# --- whitening ------------------------------------------------------------------------------------------------

def dense(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n = len(x)
    c = x - x.mean(0)
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    s = [int(v) for v in x.sum(0)]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, c @ vecs / np.sqrt(values), values / np.trace(c.T @ c / n)


def check_whitening(df, vectors, ids):
    got = df.toPandas()
    n, deviation, w, explained = dense(vectors)
    g = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((g * w).sum(0))
    assert np.abs(g - w * sign).max() < 1e-9
    assert set(got["n"]) == {n}
    assert got.groupby("vec_id")["deviation"].first().loc[ids].tolist() == deviation
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_equals_a_dense_solver(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    check_whitening(whitening.op11(spark, SF), np.stack(e["embedding"]), e["vec_id"].tolist())


def run_whitening(spark, rows, schema="vec_id long, embedding array<float>, n int, w string"):
    x = whitening.whole(spark.createDataFrame([(*r, 1, "a") for r in rows], schema))
    model = whitening.fit(x)
    return model, whitening.whitened(x, model).collect()


def test_whitening_leaves_out_broken_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(30)]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e30] * 5)]
    model, rows = run_whitening(spark, good + bad)
    assert sorted(r["vec_id"] for r in rows) == list(range(30)) and model.n == 30 and len(model.values) == 5
    _, deviation, w, _ = dense([v for _, v in good], 5)
    got = np.array([r["w"] for r in sorted(rows, key=lambda r: r["vec_id"])])
    assert np.abs(got - w * np.sign((got * w).sum(0))).max() < 1e-9
    assert [r["deviation"] for r in sorted(rows, key=lambda r: r["vec_id"])] == deviation


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4 + [(None, [1.0, 2.0])]):
        model, out = run_whitening(spark, rows)
        assert model.n == len(rows) and len(model.values) == 0 and len(out) == len(rows)
    # one direction only: one component, repeated rows and ties included
    model, out = run_whitening(spark, [(i % 3, [float(i % 3), 0.0, 0.0]) for i in range(9)])
    assert len(model.values) == 1 and model.n == 9 and {len(r["w"]) for r in out} == {1}


def test_leading_needs_fewer_passes_than_rows_of_the_matrix():
    """The polynomial does the work: a nearly flat spectrum is solved to double precision, counted in passes over single columns."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    values = np.sort(np.concatenate([np.linspace(50, 51, 390), np.linspace(60, 70, 10)]))[::-1]
    a = (q * values) @ q.T
    passes = []
    got, vecs = whitening.leading(lambda x: passes.append(x.shape[1]) or a @ x, 400)
    assert np.allclose(got, values[:8], rtol=1e-12) and len(passes) < 60 and max(passes) <= 32
    assert np.abs(np.abs((vecs * q[:, :8]).sum(0)) - 1).max() < 1e-9


# --- collocations ---------------------------------------------------------------------------------------------

def brute_collocations(rows, least, top, longest=4):
    n, f = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for s in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[s : s + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    longer = Counter()
    for (lang, p), c in f.items():
        for k in range(2, len(p)):
            for s in range(len(p) - k + 1):
                longer[lang, p[s : s + k]] = max(longer[lang, p[s : s + k]], c)
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and not 100 * longer[lang, p] >= 80 * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def got_collocations(spark, rows, least, top, schema="lang string, text string, rank int, n int"):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    return sorted(tuple(r) for r in collocations.collocations(df, least, top=top).collect())


@pytest.mark.parametrize("shard", [200, 1 << 20])
def test_collocations_equal_brute_force(spark, monkeypatch, shard):
    """Small and large shards, nulls, empty, repeated and very long texts, ties."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    rng = np.random.default_rng(5)
    vocabulary = [*"abcdefgh", "New", "york", "é", " x", "ÀB"]
    rows = [("en" if i % 3 else None, "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", " ", " ", "\t", ". ", "\n", ",,", "  "])) for _ in range(rng.integers(0, 40)))) for i in range(60)]
    rows += [("en", None), ("de", ""), ("de", "! , ."), (None, "new york city. " * 40), ("und", "New York City"), ("en", "a b c d " * 500 + "." + "x y; " * 900)] + [("fr", "le chat noir dort")] * 3
    for least, top in ((3, 1000), (5, 7)):
        want = brute_collocations(rows, least, top)
        assert want and got_collocations(spark, rows, least, top) == want


def test_collocations_of_nothing(spark):
    assert got_collocations(spark, [], 2, 5) == []
    assert got_collocations(spark, [("en", None), (None, "")], 1, 5) == []


def test_intervals_keep_in_step():
    """Every phrase's interval has its count in both directions, and extensions on either side agree."""
    row, = collocations._each_shard([collocations._index("en", b"to be or not to be, that is. to be or be to; or not to be")])
    counts, words = row["counts"], collocations._words(row).to_pylist()
    ahead, back = (collocations.Direction(row[c], counts) for c in ("ahead", "back"))
    first = counts.cumsum() - counts
    pairs = []
    for d in (ahead, back):
        of, word, n, _, _ = d.extend(first[1:], first[1:] + counts[1:])
        pairs.append({((words[w - 1], words[o]) if d is ahead else (words[o], words[w - 1])): c for o, w, c in zip(of, word, n)})
    assert pairs[0] == pairs[1] and pairs[0]["to", "be"] == 4 and pairs[0]["or", "not"] == 2 and ("be", "that") not in pairs[0]


# --- curriculum -----------------------------------------------------------------------------------------------

def water_fill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: Fraction(cap * sizes[s]) if s in full else Fraction(left * weight[s], share) for s in names}
        above = {s for s in names if s not in full and out[s] > cap * sizes[s]}
        if not above:
            return out
        full |= above


def run_curriculum(spark, rows, schema="doc_id long, text string, source string, size int, target int"):
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], schema)
    return df, curriculum.mixed(df).collect()


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size_of(text)
    want, taken = water_fill(sizes), Counter()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), size_of(t)) for i, t, _ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) for s in want)


def test_curriculum_meets_its_targets(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), str(rng.choice(["a", "b", "c", "d", "é", "z"], p=[0.02, 0.4, 0.3, 0.1, 0.08, 0.1]))) for i in range(200)]
    rows += [(None, "one two", None), (None, "one two", None), (500, None, "b"), (501, "", "b"), (501, "", "b"), (502, " \t\x0b  x", "q"), (503, "long " * 20_000, "b")] + [(504, "same text here", "c")] * 50
    _, got = run_curriculum(spark, rows)
    check_mix(rows, got)


def test_curriculum_positions(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(300)]
    df, got = run_curriculum(spark, rows)
    at = sorted((c["position"], c["time"], r["source"], c["words"]) for r in got for c in r["copies"])
    assert 0 <= at[0][0] and at[-1][0] <= sum(a[3] for a in at)
    # the demand of all sources up to a place is what lies before it, to within some documents
    before = 0
    for position, _, _, words in at:
        assert abs(position - before - words / 2) < 60
        before += words
    # light sources come late: the mean time of c is above that of a
    mean = {s: np.average([a[1] for a in at if a[2] == s], weights=[a[3] for a in at if a[2] == s]) for s in "abc"}
    assert mean["a"] < 0.5 < mean["c"]
    stream = curriculum.arranged(df).collect()
    assert [r["position"] for r in stream] == sorted(a[0] for a in at)
    assert all(size_of(r["text"]) == r["words"] for r in stream)


def test_schedules_invert(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("y"))
    for knots in curriculum.SCHEDULES.values():
        back = df.select("y", curriculum.demand(knots, curriculum.due(knots, F.col("y"))).alias("z")).collect()
        assert all(abs(r["y"] - r["z"]) < 1e-12 for r in back)


def test_curriculum_reruns_agree_and_nothing_breaks(spark):
    rows = [(i % 40, "a b c", "s") for i in range(80)]
    _, one = run_curriculum(spark, rows)
    _, two = run_curriculum(spark, rows[::-1])
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert run_curriculum(spark, [])[1] == []
    _, empty = run_curriculum(spark, [(1, None, None), (2, "", "a")])
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0)] * 2


def test_op13_counts_in_the_arranged_stream(spark, tmp_path, monkeypatch):
    rows = [(i, "w " * (i % 5), "abc"[i % 3] if i % 11 else None) for i in range(120)] + [(7, "x y", "a")] * 3 + [(200, None, "a"), (201, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    m = curriculum.mixed(df).select("doc_id", "size", "target", "taken", F.round(F.get(F.col("copies.position"), F.lit(0)), 3).alias("first_position"))
    columns = m.columns
    real, streams = curriculum.arranged, []
    monkeypatch.setattr(curriculum, "arranged", lambda *a, **k: streams.append(real(*a, **k)) or streams[0])
    got = curriculum.op13(spark, str(tmp_path)).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, m.collect()))
    assert len(streams) == 1 and streams[0].agg(F.sum("words")).first()[0] == got.agg(F.sum("taken")).first()[0]


def test_shards_are_counted_in_tasks_of_a_set_size(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(collocations, "TASK_WORDS", 100)
    many = spark.range(0, 1_000, 1, 5 * cores)
    for words, tasks in ((0, cores), (100 * (cores + 3) - 1, cores + 3), (1_000 * cores, 5 * cores)):
        got = collocations.gathered(many, words)
        assert got.rdd.getNumPartitions() == tasks and got.count() == 1_000
