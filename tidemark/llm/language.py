"""Language of web pages by fusing evidence: text, declared markup language, address suffix and host.

The text part is a naive Bayes model over hashed byte trigrams, trained on a bounded sample of ``documents`` with ``lang``.
Its posterior per page is summed in grouped aggregations: by host, by domain (last two labels) and by suffix (last label).
The prior of a page is that of its host, smoothed towards the domain, that towards the suffix, that towards all pages, with
``WEIGHT`` pseudo-pages each; a page's own posterior is taken out first, so it doesn't confirm itself. The declared language
counts by how often each declaration goes with each language over all pages, smoothed. The product decides.

Pages of any length are read in linear time. Ties go to the language that comes first in the alphabet. Null and empty pages have a flat text part and take their prior. Broken addresses have the host ''. Without training rows
every language is null. Repeated rows count each. All columns but ``html`` pass through ``identify``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, table, with_numbers, written

#: Most training texts; trigram cells; weight of a trigram (they overlap, so each counts for less); pseudo-pages.
SAMPLE_ROWS, CELLS, TEMPER, WEIGHT = 8_000, 1 << 15, 0.1, 10.0
#: Parts of a page that hold no prose, how they begin and how they end.
_BLOCK = re.compile(r"(?i)<(?:(script|style|nav)\b|!--)")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav")} | {"!--": re.compile("-->")}
#: Host tables are broadcast up to this many rows (about 100 bytes each).
BROADCAST_ROWS = 500_000


def visible(html: str | None) -> str:
    """The page without markup, comments and blocks that hold no prose; a blank stands for each. What isn't closed counts as a tag of
    its own, and what no ``>`` follows as text. Linear: an end that is searched in vain is not searched again."""
    html = html or ""
    out, at, never = [], 0, set()
    while (begin := html.find("<", at)) >= 0:
        end = -1
        if block := _BLOCK.match(html, begin):
            name = (block.group(1) or "!--").lower()
            close = None if name in never else _CLOSE[name].search(html, block.end())
            if close:
                end = close.end()
            else:
                never.add(name)
        if end < 0 and (end := html.find(">", begin) + 1) == 0:
            break
        out.append(html[at:begin])
        at = end
    out.append(html[at:])
    return " ".join(out)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    cell = ((b[:-2] * 961748927 + b[1:-1] * 982451653 + b[2:] * 472882027) >> np.uint32(12)) % CELLS
    return np.unique(cell, return_counts=True)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray] | None:
    """(languages, log-probabilities language x cell) of at most ``rows`` labelled texts."""
    sample = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "lang").limit(rows)
    texts = docs.select(F.col("doc_id").alias("t_id"), F.col("lang").alias("t_lang"), "text").join(F.broadcast(sample), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("lang") == F.col("t_lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                cell, n = trigram_counts(text)
                held.setdefault(lang, np.zeros(CELLS, np.int64))[cell] += n
        yield pd.DataFrame([(k, v.tobytes()) for k, v in held.items()], columns=["lang", "counts"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).tobytes()]})

    got = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in texts.select("lang", "text").mapInPandas(count, "lang string, counts binary").groupBy("lang").applyInPandas(total, "lang string, counts binary").collect()}
    if not got:
        return None
    langs = sorted(got)
    p = np.stack([got[k] for k in langs]) + 0.5
    return langs, np.log(p / p.sum(1, keepdims=True))


def posterior_of(model: tuple[list[str], np.ndarray]):
    """A maker of the function html -> text posterior by language."""

    def make():
        logs = model[1]

        def posterior(html: str) -> list[float]:
            cell, n = trigram_counts(visible(html))
            s = TEMPER * (logs[:, cell] * n).sum(1)
            s = np.exp(np.maximum(s - s.max(), -60.0))
            return (s / s.sum()).tolist()

        return posterior

    return make


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def evidence(pages: DataFrame, model) -> DataFrame:
    d = with_numbers(pages, "post_", posterior_of(model), "html")
    host = F.col("host_")
    # the first tag alone, so that a page full of unclosed ones is searched once
    attributes = F.regexp_extract("html", r"(?i)<html\b([^>]*)", 1)
    declared = F.nullif(F.lower(F.regexp_extract(attributes, r"(?i)\slang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))
    d = d.withColumn("host_", host_of(F.col("url"))).withColumn("domain_", F.substring_index(host, ".", -2)).withColumn("suffix_", F.substring_index(host, ".", -1))
    return d.withColumn("declared_", F.coalesce(declared, F.lit("")))


def identify(pages: DataFrame, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``pages`` without ``html``, with struct ``language_``: lang, probability, text_lang, declared, host."""
    model = train(docs, sample_rows)
    if model is None:
        none = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
        return pages.withColumn("language_", none)
    langs = model[0]
    m = len(langs)
    # what the decision needs, without the pages themselves
    e = written(evidence(pages, model).drop("html"))
    sums = lambda key: e.groupBy(key).agg(*(F.sum(F.col("post_")[k]).alias(f"s{k}") for k in range(m)))

    def level(key: str) -> DataFrame:
        return small(written(sums(key).select(F.col(key).alias(f"{key}k"), F.array(*(F.col(f"s{k}") for k in range(m))).alias(f"{key}n"))), BROADCAST_ROWS)

    every = e.agg(*(F.coalesce(F.sum(F.col("post_")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(m))).first()
    base = F.array(*(F.lit(float(every[k])) for k in range(m)))
    d = e
    for key in ("suffix_", "domain_", "host_", "declared_"):
        t = level(key)
        d = d.join(t, F.col(key) == F.col(f"{key}k"), "left").drop(f"{key}k")
    own = F.col("post_")

    def smooth(counts: Column, prior: Column) -> Column:
        rest = F.zip_with(counts, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.transform(rest, lambda x, i: (x + WEIGHT * prior[i]) / (total + WEIGHT))

    d = d.withColumn("prior_", smooth(base, F.array(*[F.lit(1.0 / m)] * m)))
    for key in ("suffix_n", "domain_n", "host_n"):
        d = d.withColumn("prior_", smooth(F.col(key), F.col("prior_")))
    # chance of this declaration given the language; no declaration says nothing
    said = F.transform(F.zip_with("declared_n", own, lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda x, i: F.when(F.col("declared_") == "", 1.0).otherwise((x + 1.0) / (base[i] + WEIGHT)))
    d = d.withColumn("said_", said)
    d = d.withColumn("joint_", F.transform("post_", lambda p, i: p * F.col("prior_")[i] * F.col("said_")[i]))
    total = F.aggregate("joint_", F.lit(0.0), lambda a, x: a + x)
    names = F.array(*map(F.lit, langs))
    best = lambda c: names[F.array_position(c, F.array_max(c)).cast("int") - 1]
    language = F.struct(best(F.col("joint_")).alias("lang"), (F.array_max("joint_") / total).alias("probability"), best(F.col("post_")).alias("text_lang"), F.nullif(F.col("declared_"), F.lit("")).alias("declared"), F.col("host_").alias("host"))
    return d.select(*(c for c in pages.columns if c != "html"), language.alias("language_"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Per page: its language, how sure that is, and what the parts said."""
    d = identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return d.select("page_id", "language_.lang", "language_.probability", "language_.text_lang", "language_.declared", "language_.host")
