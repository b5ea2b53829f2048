"""License ranking against all blocks and templates; the page scan against its definition; long pages and conversations."""

import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language, licenses

SF = "/root/testdata/sf0.01"


# --- licenses -------------------------------------------------------------------------------------------------

def altered(rng, text):
    """The wording with a few words replaced, dropped or put between."""
    w = text.split()
    for _ in range(rng.randint(0, max(0, len(w) // 20 - 1))):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([["other"], [], [w[k], "more"]])
    return rng.choice(["\n", " ", "  ", "\n# "]).join(w)


def texts():
    rng = random.Random(11)
    prose = "the quick brown fox jumps over lazy dogs while this work is free to read and copy".split()
    out = [r for r in pd.read_parquet(f"{SF}/documents.parquet")["text"].tolist() if r and licenses.CUES.search(r.lower())][:120]
    for name in sorted(licenses.TEMPLATES):
        filler = lambda: " ".join(rng.choice(prose) for _ in range(rng.randint(0, 40)))
        out.append(f"{filler()}\n{altered(rng, licenses.TEMPLATES[name])}\n{filler()}")
        other = licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))]
        out.append(f"{licenses.TEMPLATES[name]} {other}")
    return out


def test_the_same_as_all_blocks_and_all_templates():
    """No opening word and no saving threshold: every word opens a block, every template is confirmed in the order of the ranking."""
    quick, whole = licenses.scanner(), licenses.scanner(least_saved=float("-inf"), every_word=True)
    found = 0
    for t in texts():
        a, b = quick(t), whole(t)
        assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b], t
        found += len(a)
    assert found > 100


def test_the_ranking_decides(monkeypatch):
    """Where two templates hold at one place, the one that saves more bytes is taken; with a compressor that tells nothing, the other."""
    import zstandard

    full = licenses.TEMPLATES["Apache-2.0"]
    assert [x[0] for x in licenses.scanner()(full)] == ["Apache-2.0"]
    assert [x[0] for x in licenses.scanner()(licenses.TEMPLATES["Apache-2.0-notice"] + " Something else follows here.")] == ["Apache-2.0-notice"]
    short_first = {"a-short": licenses.TEMPLATES["Apache-2.0-notice"], "b-full": full}
    monkeypatch.setattr(licenses, "TEMPLATES", short_first)
    assert [x[0] for x in licenses.scanner()(full)] == ["b-full"]

    class Blind:
        def __init__(self, **_):
            pass

        def compress(self, _):
            return b"0"

    monkeypatch.setattr(zstandard, "ZstdCompressor", Blind)
    assert [x[0] for x in licenses.scanner(least_saved=0)(full)] == ["a-short"]


# --- pages ----------------------------------------------------------------------------------------------------

def test_page_scan_equals_its_definition():
    rule = re.compile(r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(1)
    bits = ["<script>", "</script >", "<style a=b>", "</STYLE>", "<nav", "</nav>", "<!--", "-->", "<", ">", "a", " b ", "<p>", "</p>", "<scripty>", "-", "\n", "é"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for h in [*pages, *pd.read_parquet(f"{SF}/pages.parquet")["html"]]:
        assert language.visible(h) == rule.sub(" ", h or "")
    assert language.visible(None) == ""


@pytest.mark.parametrize("unit", ["<script ", "<!-- ", "<nav x>", "</script ", "<style></styl"])
def test_long_pages_of_unclosed_tags(unit):
    began = time.time()
    language.visible(unit * ((2 << 20) // len(unit)))
    assert time.time() - began < 3


def test_fused_posterior_equals_plain_python(spark):
    """The whole fusion, page by page: text posterior, declaration, and the chain of smoothed priors without the page itself."""
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    langs, _ = model = language.train(docs)
    posterior = language.posterior_of(model)()
    rows = []
    for r in pages.collect():
        host = (m.group(1).lower() if (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", r["url"] or "")) else "")
        tag = re.search(r"(?i)<html\b([^>]*)", r["html"] or "")
        said = re.search(r"(?i)\slang\s*=\s*[\"']?([A-Za-z]+)", tag.group(1)) if tag else None
        parts = host.split(".")
        rows.append((r["page_id"], np.array(posterior(r["html"] or "")), ["", parts[-1], ".".join(parts[-2:]), host], said.group(1).lower() if said else ""))
    sums, declared = {}, {}
    for _, post, keys, said in rows:
        for level, key in enumerate(keys):
            sums[level, key] = sums.get((level, key), 0) + post
        declared[said] = declared.get(said, 0) + post
    want = {}
    for page, post, keys, said in rows:
        prior = np.full(len(langs), 1 / len(langs))
        for level, key in enumerate(keys):
            rest = np.maximum(sums[level, key] - post, 0)
            prior = (rest + language.WEIGHT * prior) / (rest.sum() + language.WEIGHT)
        chance = (np.maximum(declared[said] - post, 0) + 1) / (sums[0, ""] + language.WEIGHT) if said else 1.0
        joint = post * prior * chance
        want[page] = (langs[int(joint.argmax())], joint.max() / joint.sum(), langs[int(post.argmax())], said or None, keys[3])
    got = {r["page_id"]: r for r in language.op7(spark, SF).collect()}
    assert got.keys() == want.keys()
    for page, (lang, sure, by_text, said, host) in want.items():
        g = got[page]
        assert (g["lang"], g["text_lang"], g["declared"], g["host"]) == (lang, by_text, said, host)
        assert g["probability"] == pytest.approx(sure, rel=1e-6)


def test_a_page_of_unclosed_html_tags(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.org", "<html " * 350_000), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    began = time.time()
    assert language.identify(pages, docs).count() == 3
    assert time.time() - began < 60


# --- conversations --------------------------------------------------------------------------------------------

def test_one_conversation_of_very_many_turns(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é </s> "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    d = chat.render(chat.turns_of(rows)).withColumn("l", chat.learnt("formatted_", "mask_"))
    got = d.select(F.size("mask_"), F.sha2(F.col("l").cast("binary"), 256)).first()
    want = "".join(f"é </s> {i}" for i in range(n) if i % 3)
    assert (got[0], got[1]) == (n - n // 3, hashlib.sha256(want.encode()).hexdigest())
    assert time.time() - began < 60
