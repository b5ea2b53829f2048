"""Brute force, round trips, held-out accuracy and edge cases of the operators without full SQL."""

import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, decontaminate, language, licenses, line_dedup, packing, quality, toxicity
from tidemark.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# --- nearest neighbours ---------------------------------------------------------------------------------------

def exact(rows, every, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_nearest_recall_and_scores(spark):
    got = ann.op1(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = exact(rows, 100)
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert have.keys() == want.keys() and all(len(v) == 10 for v in have.values())
    assert sum(len({i for i, _ in have[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    true = dict(rows)
    for q, found in have.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        for i, s in found:
            assert s == pytest.approx(np.linalg.norm(np.array(true[q], float) - np.array(true[i], float)), abs=1e-12)


def test_nearest_in_blocks_with_clusters():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(700, 16)), rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(300, 16))))
    rows = [(i, v) for i, v in enumerate(x)]
    want = exact(rows, 50)
    found = ann.search_block(x, np.arange(1000), x[::50], np.arange(0, 1000, 50))
    hit = sum((v in {i for i, _ in want[q]}) for q, v, _ in found)
    assert hit >= 0.9 * 10 * len(want)


def test_nearest_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.1]), (100, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("block", F.lit("x"))
    v = ann.clean(df)
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(v, v.where("id % 100 = 0")).collect())
    assert out == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]
    none = ann.clean(df.limit(0))
    assert ann.nearest(none, none).count() == 0


# --- classifiers ----------------------------------------------------------------------------------------------

def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("run,mark", [(quality.op2, "quality"), (toxicity.op10, "toxic")])
def test_held_out_accuracy(spark, docs, labels, run, mark):
    out = run(spark, SF)
    rows = out.join(labels, "doc_id").where("held_out").select("score", mark, "predicted").collect()
    assert auc([(r[0], r[1]) for r in rows]) > 0.85
    assert sum(r[1] == r[2] for r in rows) / len(rows) > 0.9
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").isEmpty()


@pytest.mark.parametrize("scored,mark,col", [(quality.scored, "quality", "quality_score_"), (toxicity.scored, "toxic", "toxic_score_")])
def test_classifier_edge_cases(spark, docs, labels, scored, mark, col):
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word " * 50_000)], "doc_id long, text string").withColumn("x", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("mark", F.lit(2))
    both = docs.select("doc_id", "text").withColumn("x", F.lit("")).withColumn("v", F.lit(1)).withColumn("mark", F.lit(0)).unionByName(odd)
    out = scored(both, labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)))
    assert out.count() == both.count() and out.where(f"{col} is null").isEmpty() and set(both.columns) < set(out.columns)
    assert scored(odd, labels.limit(0)).where(f"{col} is null").isEmpty()
    assert scored(odd.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark, docs, labels):
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x) for x in (labels, turned))
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])


# --- line dedup -----------------------------------------------------------------------------------------------

def lines_brute(rows, min_docs=3):
    trim = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(trim))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    low = lambda i: -1 if i is None else i
    keep = {k: max(v, key=low) for k, v in held.items() if len(v) >= min_docs}
    return sorted((low(i), "\n".join(x for x in (t or "").split("\n") if keep.get(key(x), i) == i)) for i, t in rows)


def test_lines_and_their_way_back(spark):
    line = "This line of text is shared by several"
    rows = [(1, f"a\n{line}\nb"), (2, f" \t{line.upper()}\x0b"), (3, f"{line}\n{line}"), (4, None), (5, ""), (None, line), (6, "ÉÀ" * 12), (7, "éà" * 12), (7, "éà" * 12), (8, "x\n\ny\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("shard", F.lit(0))
    kept = lambda out: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["kept_"]) for r in out.collect())
    assert kept(line_dedup.drop_lines(df)) == lines_brute(rows)
    few, rest = df.where("doc_id in (1, 2)"), df.where("doc_id not in (1, 2) or doc_id is null")
    refs = line_dedup.add(line_dedup.refs_of(rest), few)
    assert kept(line_dedup.drop_lines(df, refs)) == lines_brute(rows)
    back = line_dedup.delete(refs, few)
    assert kept(line_dedup.drop_lines(rest, back)) == lines_brute([r for r in rows if r[0] not in (1, 2)])
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_cuckoo_filter():
    h = np.unique(np.random.default_rng(5).integers(0, 2**63, 20_000, dtype=np.uint64))
    f = line_dedup.Cuckoo.built(h[:10_000])
    assert f.has(h[:10_000]).all() and f.has(h[10_000:]).mean() < 0.01
    assert all(f.delete(x) for x in h[:5_000]) and f.has(h[5_000:10_000]).all() and f.has(h[:5_000]).mean() < 0.01


def test_rows_meet_their_filters_by_shuffle(spark, docs, monkeypatch):
    """Beyond the broadcast size: several shards, the rows of each in several parts, some null ids."""
    want = sorted((r["doc_id"], r["n_dropped_"], r["kept_"]) for r in line_dedup.drop_lines(docs).collect())
    for name, value in (("FILTER_BYTES", 0), ("SHARD_KEYS", 7), ("PROBE_ROWS", 50)):
        monkeypatch.setattr(line_dedup, name, value)
    assert sorted((r["doc_id"], r["n_dropped_"], r["kept_"]) for r in line_dedup.drop_lines(docs).collect()) == want
    assert sum(n for _, n, _ in want) > 0
    line = "This line of text is shared by several"
    rows = [(1, line), (None, line), (2, line), (3, None)]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["kept_"]) for r in got) == lines_brute(rows)


def test_filters_follow_changes(spark):
    keys = [hashlib.md5(str(k).encode()).digest() for k in range(600)]
    df = lambda ks: spark.createDataFrame([(bytearray(k),) for k in ks], "key binary")
    f = line_dedup.apply_changes(line_dedup.filters(df(keys[:300]), 300), df(keys[300:]), df(keys[:300]), 1)
    left = {bytes(r["key"]) for r in line_dedup.perhaps(df(keys), f, 1).collect()}
    assert set(keys[300:]) <= left and len(left) < 330


# --- packing --------------------------------------------------------------------------------------------------

def slow_best_fit(pieces, lengths):
    """The same rule by looking at every bin."""
    left, bins = sum(pieces), []
    for p in pieces:
        open_ = [(b["room"], -b["stamp"], b) for b in bins if b["room"] >= p]
        if open_:
            b = min(open_, key=lambda x: x[:2])[2]
        else:
            size = min((c for c in lengths if c >= p), key=lambda c: (packing.cost(c) / min(c, left), c))
            b = {"room": size, "used": 0, "stamp": 0}
            bins.append(b)
        b["room"] -= p
        b["used"] += p
        left -= p
        b["stamp"] = max(x["stamp"] for x in bins) + 1
    return sorted(b["used"] for b in bins)


def test_packing_rule_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        pieces = sorted((int(x) for x in rng.integers(1, 65, 120)), reverse=True)
        b, at, size = packing.pack(pieces, (16, 32, 64))
        used = pd.Series(pieces).groupby(b).sum()
        assert sorted(used) == slow_best_fit(pieces, (16, 32, 64))
        assert all(size[k] == min(c for c in (16, 32, 64) if c >= u) for k, u in used.items())


def test_packing_loses_nothing(spark, docs):
    odd = spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-3, "w " * 20_000), (-3, "w " * 20_000)], "doc_id long, text string").withColumn("bin_id", F.lit(0)).withColumn("piece", F.lit(""))
    both = docs.select("doc_id", "text", F.lit(0).alias("bin_id"), F.lit("").alias("piece")).union(odd)
    p = packing.placements(both).toPandas()
    want = both.select(packing.length_of(F.col("text")).alias("n")).toPandas()["n"].sum()
    assert p["n_tokens"].sum() == want
    full = p[p.bin_id.notna()].sort_values(["bin_id", "offset"])
    assert (full.offset == full.groupby("bin_id").n_tokens.cumsum() - full.n_tokens).all()
    assert (full.groupby("bin_id").n_tokens.sum() == full.groupby("bin_id").bin_used.first()).all() and (full.bin_used <= full.bin_length).all()
    assert set(p.doc_id.dropna()) == {r["doc_id"] for r in both.select("doc_id").collect()} - {None}
    assert packing.placements(both.limit(0)).count() == 0
    assert packing.bins(packing.placements(both)).count() == full.bin_id.nunique()


# --- language -------------------------------------------------------------------------------------------------

def test_language_agrees_with_declarations(spark):
    out = language.op7(spark, SF).toPandas()
    said = out[out.declared.notna()]
    assert (said.lang == said.declared).mean() > 0.97 and (said.text_lang == said.declared).mean() > 0.95
    assert out.probability.between(0, 1 + 1e-9).all() and len(out) == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_language_evidence(spark, docs):
    page = lambda text, lang="": f"<html{lang}><body><p>{text}</p></body></html>"
    de = [(k, "http://www.eins.example.de/x", page(r["text"])) for k, r in enumerate(docs.where("lang = 'de'").select("text").limit(40).collect())]
    rows = [*de, (100, "http://www.eins.example.de/y", page("")), (101, None, None), (102, "no address", page("", " lang='de'")), (103, "http://www.eins.example.de/y", page(""))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("post", F.lit(1.0))
    got = {r["page_id"]: r["language_"] for r in language.identify(df, docs).collect()}
    assert len(got) == len(rows) and got[100]["lang"] == "de" and got[100]["probability"] > 0.8 and got[101]["lang"] is not None
    assert language.identify(df, docs.limit(0)).where("language_.lang is not null").isEmpty()
    assert language.identify(df.limit(0), docs).count() == 0


# --- licenses -------------------------------------------------------------------------------------------------

def test_license_scan(spark):
    t = licenses.TEMPLATES
    wrapped = "\n".join(" # " + x for x in t["MIT"].replace(" to ", " to\n").split("\n"))
    rows = [(1, "Intro\nLicensed under CC BY-NC 4.0.\nAnd more prose, licensed to none."), (2, wrapped), (3, "x " * 1000 + "\nAll rights reserved. Released under the MIT License."), (4, None), (5, ""),
            (6, "You need a license to drive, permission granted or not."), (7, "Licensed under CC BY 5.0."), (None, t["GPL-3.0-or-later"]), (8, t["GPL-2.0-or-later"].replace("hope", "wish"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("notices", F.lit(1))
    got = {r["doc_id"]: [n["license"] for n in r["notices_"]] for r in licenses.scan(df).collect()}
    assert got == {1: ["CC-BY-NC-4.0-notice"], 2: ["MIT"], 3: ["all-rights-reserved", "MIT-notice"], 4: [], 5: [], 6: [], 7: [], None: ["GPL-3.0-or-later"], 8: ["GPL-2.0-or-later"]}
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_scan_reads_over_line_breaks():
    """Every template wrapped after any of its words, with comment marks, after prose; and none of its words lost."""
    found = licenses.scanner()
    for name, text in licenses.TEMPLATES.items():
        assert licenses.CUES.search(text.lower()), name
        words = text.split(" ")
        for k in range(1, len(words)):
            for sep in ("\n", "  ", "\n # "):
                got = found("Some prose, all of it to this end.\n// " + " ".join(words[:k]) + sep + " ".join(words[k:]) + "\nMore prose.")
                assert [(n, line, missing, added) for n, line, _, missing, added in got] == [(name, 1, 0, 0)], (name, k, sep)
        assert [x[0] for x in found("\n".join(words) + "\n\n" + text)] == [name] * 2
    late = "word " * 50 + "hereby granted" + licenses.TEMPLATES["MIT"].removeprefix("Permission is hereby granted")
    assert [(x[0], x[3]) for x in found(late)] == [("MIT", 2)] and found("public domain, permission, licensed; nothing else") == []


def test_license_scan_tells_licenses_apart():
    t, found = licenses.TEMPLATES, licenses.scanner()
    names = lambda text: [x[0] for x in found(text)]
    gpl = t["GPL-3.0-or-later"]
    assert names(gpl.replace("GNU General", "GNU Affero General")) == ["AGPL-3.0-or-later"] and names(t["LGPL-3.0-or-later"]) == ["LGPL-3.0-or-later"]
    assert names(gpl.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0-or-later"] and names(t["LGPL-2.1-or-later"]) == ["LGPL-2.1-or-later"]
    for wrong in ("version 4", "version 3.1", "version 2.1"):
        assert names(gpl.replace("version 3", wrong)) == [], wrong
    assert names(t["LGPL-2.1-or-later"].replace("Lesser", "Other").replace("2.1", "9")) == []
    # other words may differ a little, and a full notice with a difference is not its short form
    assert names(gpl.replace("This program", "This library")) == ["GPL-3.0-or-later"] and names(gpl.replace("can redistribute", "may redistribute")) == ["GPL-3.0-or-later"]
    assert names(t["Apache-2.0"].replace("may not", "must not")) == ["Apache-2.0"] and names(t["Apache-2.0"].replace("Version 2.0", "Version 1.1")) == []
    assert names(t["CC-BY-SA-4.0-notice"] + " " + t["CC-BY-4.0"]) == ["CC-BY-SA-4.0-notice", "CC-BY-4.0"]


def test_license_query_finds_every_planted_line(spark, docs):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice", "All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "MIT-notice"}
    got = {r["doc_id"]: set(r["licenses"]) for r in licenses.op9(spark, SF).collect()}
    for r in docs.collect():
        assert {v for k, v in lines.items() if k in r["text"].split("\n")} <= got[r["doc_id"]]


# --- chat -----------------------------------------------------------------------------------------------------

LAYOUTS = [
    {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q <|end|>\n \\ </s>"}, {"role": "assistant", "content": "a [INST] \\n"}]},
    [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}],
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
    {"instruction": "q", "input": "x", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"},
    {"system": "s", "prompt": "q", "response": "a"}, {"id": 7, "prompt": "q", "response": "a", "extra": {"b": [1]}},
]
WANT = [
    [("system", "s"), ("user", "q <|end|>\n \\ </s>"), ("assistant", "a [INST] \\n")],
    *[[("user", "q"), ("assistant", "a")]] * 5, [("user", "q\n\nx"), ("assistant", "a")], *[[("user", "q"), ("assistant", "a")]] * 2, [("system", "s"), ("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a")],
]


def test_chat_layouts_and_round_trip(spark):
    rows = [(k, json.dumps(x)) for k, x in enumerate(LAYOUTS)] + [(50, None), (51, "{broken"), (52, "{}"), (53, '{"messages": []}')]
    df = spark.createDataFrame(rows, "id long, record string").withColumn("turns", F.lit("clash"))
    d = chat.render(chat.canonical(df)).withColumn("back_", chat.read_back(F.col("formatted_"))).withColumn("learnt_", chat.learnt(F.col("formatted_"), F.col("mask_")))
    got = {r["id"]: r for r in d.collect()}
    for k, want in enumerate(WANT):
        assert [tuple(t) for t in got[k]["turns_"]] == want == [tuple(t) for t in got[k]["back_"]], k
        assert got[k]["learnt_"] == "".join(t for r, t in want if r == "assistant")
    assert all(got[k]["layout_"] is None and got[k]["formatted_"] == "" for k in (50, 51, 52))
    assert chat.canonical(df.limit(0)).count() == 0


def test_chat_rows_edge_cases(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "é\n<|turn|>"), (1, 0, "user", "é\n<|turn|>"), (None, None, None, "x"), (2, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d = chat.render(chat.canonical(chat.records_of(df))).withColumn("back_", chat.read_back(F.col("formatted_")))
    got = {r["conv_id"]: [tuple(t) for t in r["back_"]] for r in d.collect()}
    assert got == {1: [("user", "é\n<|turn|>")] * 2 + [("assistant", "")], None: [("", "x")], 2: [("assistant", "long " * 100_000)]}


def test_chat_keeps_turns_and_conversations_of_any_size(spark, tmp_path):
    """A turn of more than 20,000,000 characters, and a conversation of more than 128 MiB under the null id."""
    one = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("long "), 4_200_000).alias("text"))
    many = spark.range(150).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), 1_000_000).alias("text"))
    one.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in chat.op8(spark, str(tmp_path)).collect()}
    assert got[1] == (1, 21_000_000, hashlib.sha256(b"long " * 4_200_000).hexdigest())
    sums = F.aggregate("turns_", F.lit(0), lambda a, t: a + F.char_length(t["text"]))
    assert [tuple(r) for r in chat.turns_of(many).select("conv_id", "layout_", F.size("turns_"), sums).collect()] == [(None, "messages", 150, 150_000_000)]


def test_chat_records_beyond_the_variant_fail(spark):
    """Long strings are read; what no variant can hold is an error, not broken JSON."""
    text = F.repeat(F.lit("x"), 21_000_000)
    long = spark.range(1).select(F.concat(F.lit('{"prompt": "q", "response": "'), text, F.lit('"}')).alias("record"))
    assert [tuple(r) for r in chat.canonical(long).select("layout_", F.char_length(F.col("turns_")[1]["text"])).collect()] == [("prompt_response", 21_000_000)]
    huge = spark.range(1).select(F.concat(F.lit('{"prompt": "q", "response": "'), F.repeat(F.lit("x"), 140_000_000), F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="beyond the size of a variant"):
        chat.canonical(huge).select("layout_", F.size("turns_")).collect()
    short = spark.createDataFrame([("{'prompt': 'q', 'response': 'a'}",), ("{broken",)], "record string")
    assert chat.canonical(short).where("layout_ is not null").isEmpty()


# --- decontamination ------------------------------------------------------------------------------------------

def test_decontamination_edge_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, ""), (5, "solo"), (6, item), (None, "ghost words here")], "item_id long, text string")
    rows = [(1, f"start {item.upper()}; end"), (1, f"start {item.upper()}; end"), (2, None), (3, ""), (4, "short ITEM, short item"), (None, "a solo act"), (5, "one two three four five six seven eight nine but ten"), (6, "the ghost words here now"), (1, "other text of the same id"), (7, "word " * 60_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("id", F.lit(3))
    got = sorted(((r["doc_id"] or 0, r["hit_"]["n_words"], r["hit_"]["n_hit"], ",".join(r["hit_"]["items"])) for r in decontaminate.mark(docs, items).collect()), key=str)
    assert got == sorted([(1, 14, 12, "1,6")] * 2 + [(2, 0, 0, ""), (3, 0, 0, ""), (4, 4, 4, "2"), (0, 3, 1, "5"), (5, 11, 0, ""), (6, 5, 3, ""), (1, 6, 0, ""), (7, 60012, 12, "1,6")], key=str)
    assert sorted((r["doc_id"] or 0) for r in decontaminate.decontaminate(docs, items).collect()) == [1, 2, 3, 5]
    assert decontaminate.mark(docs, items.limit(0)).where("hit_.n_hit > 0").isEmpty() and decontaminate.mark(docs.limit(0), items).count() == 0
