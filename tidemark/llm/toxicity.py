"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt from all labelled rows outside the held-out fold: for each word and each word beginning of 4 to 8 characters the
toxic and clean documents that hold it are counted in one aggregation, and its strength is the lower Wilson bound of the
toxic share. The features of such a row use the lexicon of the other half of them, so the trees see strengths as they
come out on new texts. Three quarters of them grow the trees, one quarter fits the calibration.

Features are taken from the whole text only. Null and empty texts have no hits. Without labels of both kinds every score is
the share of toxic labels (0 without any). Repeated rows are scored each; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, labelled, table, with_numbers, written

#: Most lexicon entries (the strongest); documents that an entry needs.
LEXICON, MIN_DOCS = 5_000, 3
BEGINNINGS, NEAR, Z = (4, 5, 6, 7, 8), 5, 1.64
THRESHOLD = 0.7
#: Second persons of four languages, and the signs that stand for letters.
SECOND = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros".split())
SIGNS = str.maketrans("013457@$!|", "oieastasil")
NAMES = ["log_words", "strongest", "hit_rate", "strong_words", "hit_words", "hit_mass", "second_rate", "second_near_hit", "capitals", "exclamations", "punctuation", "repeated_marks", "obfuscated", "decoded_hits", "elongated"]
_WORD = re.compile(r"[^\W_]+")
# from the start of a run of letters and without going back: what is found is the same, in a tenth of the steps
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!|*._-]++[^\W\d_][\w@$!|*.-]*")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .-]){3,}[^\W\d_]\b")
_MARKS, _LONG, _PUNCT = re.compile(r"[!?.,]{2,}"), re.compile(r"([^\W\d_])\1\1"), re.compile(r"[^\w\s]")
#: What every find of ``_MIXED`` and of ``_SPACED`` holds; most texts hold neither.
_SIGN_LETTER, _APART = re.compile(r"[0-9@$!|*._-]+[^\W\d_]"), re.compile(r"[ .-][^\W\d_][ .-][^\W\d_][ .-]")
#: Which of the first 128 characters are punctuation.
_IS_PUNCT = np.array([bool(_PUNCT.match(chr(c))) for c in range(128)])
#: Words whose hits or entries a task keeps at once.
_KEPT = 500_000


class _Memo(dict):
    """``make`` of each word, kept for ``_KEPT`` words."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= _KEPT:
            self.clear()
        out = self[word] = self.make(word)
        return out


def entries(word: str) -> list[str]:
    """What the lexicon may hold for a word: the word, and its beginnings with a star."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def strength(toxic: int, clean: int) -> float:
    """Lower Wilson bound of the toxic share."""
    n = toxic + clean
    if not n or toxic < MIN_DOCS:
        return 0.0
    p = toxic / n
    return (p + Z * Z / 2 / n - Z * math.sqrt(p * (1 - p) / n + Z * Z / 4 / n / n)) / (1 + Z * Z / n)


def features_of(lexicon: dict[str, float]):
    """A maker of the function text -> values of ``NAMES``."""

    def make():
        memo = _Memo(lambda word: max(lexicon.get(e, 0.0) for e in entries(word)))
        hit = memo.__getitem__

        def features(text: str) -> list[float]:
            low = text.lower()
            words = _WORD.findall(low)
            n = max(1, len(words))
            hits = list(map(hit, words))
            best = max(hits, default=0.0)
            at = [k for k, s in enumerate(hits) if s >= 0.5] if best >= 0.5 else []
            second = [k for k, w in enumerate(words) if w in SECOND]
            near = 0
            if at and second:
                where = {k + d for k in second for d in range(-NEAR, NEAR + 1)}
                near = sum(k in where for k in at)
            mixed = _MIXED.findall(low) if _SIGN_LETTER.search(low) else []
            spaced = [m.group() for m in _SPACED.finditer(low)] if _APART.search(low) else []
            decoded = [re.sub(r"[\W\d_]", "", m.translate(SIGNS)) for m in mixed] + [re.sub(r"\W", "", m) for m in spaced]
            found = max((hit(w) for w in decoded if w), default=0.0)
            # characters beyond ASCII one by one, the others by their bytes
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            plain = code[code < 128]
            rest = "" if len(plain) == len(code) else "".join(map(chr, code[code >= 128]))
            caps = (int(((plain >= 65) & (plain <= 90)).sum()) + sum(map(str.isupper, rest))) / max(1, len(text))
            punctuation = int(_IS_PUNCT[plain].sum()) + len(_PUNCT.findall(rest))
            code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
            thrice = set(code[2:][(code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])].tolist())
            long = sum(1 for _ in _LONG.finditer(low)) if any(_LONG.match(chr(c) * 3) for c in thrice) else 0
            return [math.log1p(len(words)), best, len(at) / n, float(len({words[k] for k in at if hits[k] >= 0.8})), float(len({words[k] for k in at})), sum(hits[k] for k in at) / math.sqrt(n), len(second) / n, float(near), caps,
                    text.count("!") / n, punctuation / n, len(_MARKS.findall(text)) / n, len(mixed) / n, found, long / n]

        return features

    return make


#: The columns of ``term_counts``: toxic and clean documents of half 0, then of half 1.
COUNTS = ("clean_0", "toxic_0", "clean_1", "toxic_1")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, clean_0, toxic_0, clean_1, toxic_1): documents by term, a row each; summed within a task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries_of = _Memo(entries).__getitem__
        held: list[Counter] = [Counter() for _ in COUNTS]

        def rows_of() -> Iterator[pd.DataFrame]:
            for kind, c in enumerate(held):
                if c:  # an empty column has no type that Spark takes for a string
                    yield pd.DataFrame({"term": pd.Series(list(c), dtype=object), "kind": np.int32(kind), "n": np.fromiter(c.values(), np.int64, len(c))})
                c.clear()

        for pdf in batches:
            for text, half, mark in zip(pdf["text"], pdf["half"], pdf["mark"]):
                if mark in (0, 1):
                    held[2 * half + mark].update(set(chain.from_iterable(map(entries_of, set(_WORD.findall((text or "").lower()))))))
                    if sum(map(len, held)) > 300_000:
                        yield from rows_of()
        yield from rows_of()

    part = rows.mapInPandas(count, "term string, kind int, n long")
    return part.groupBy("term").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(COUNTS)))


def lexicons(counts: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """The lexicon of half 0, of half 1 and of both: the ``size`` strongest entries of each, which bounds what is collected."""
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    bound = (p + Z * Z / 2 / n - Z * F.sqrt(p * (1 - p) / n + Z * Z / 4 / n / n)) / (1 + Z * Z / n)
    out = []
    for toxic, clean in (("toxic_0", "clean_0"), ("toxic_1", "clean_1"), ("toxic_0 + toxic_1", "clean_0 + clean_1")):
        part = counts.withColumns({"toxic": F.expr(toxic), "clean": F.expr(clean)})
        best = part.where(F.col("toxic") >= MIN_DOCS).select("term", bound.alias("s")).where("s >= 0.3").orderBy(F.desc("s"), "term").limit(size)
        out.append({r["term"]: float(r["s"]) for r in best.collect()})
    return out


def fit(docs: DataFrame, labels: DataFrame):
    """(lexicon, trees, calibration), or the share of toxic labels where there is nothing to learn."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    own = labelled(labels, "toxic").select(F.col("doc_id").alias("s_id"), F.col("toxic").alias("mark"))
    # of one kind at any size: labels never pass the driver, texts are moved once and not sorted
    rows = docs.select("doc_id", "text").join(own.hint("shuffle_hash"), F.col("doc_id") == F.col("s_id"))
    rows = written(rows.select("text", "mark", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).alias("calibrate")))
    kinds = {r["mark"]: r["n"] for r in rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        return float(kinds.get(1, 0) > 0)
    # no lexicon holds a term with fewer toxic documents
    zero, one, both = lexicons(written(term_counts(rows).where(F.col("toxic_0") + F.col("toxic_1") >= MIN_DOCS)))
    x = [with_numbers(rows.where(F.col("half") == h), "x", features_of(other)) for h, other in ((0, one), (1, zero))]
    x = written(x[0].unionByName(x[1]).select("x", F.col("mark").cast("double").alias("mark"), "calibrate")).select("mark", "calibrate", array_to_vector("x").alias("v"))
    grow = x.where("not calibrate")
    if grow.select("mark").distinct().count() < 2:
        grow = x
    trees = GBTClassifier(featuresCol="v", labelCol="mark", maxIter=20, maxDepth=4, stepSize=0.3, seed=7).fit(grow)
    held = x.where("calibrate") if not x.where("calibrate and mark = 1").isEmpty() else x
    raw = trees.transform(held).select("mark", vector_to_array("probability")[1].alias("p"))
    return both, trees, IsotonicRegression(featuresCol="p", labelCol="mark", predictionCol="score").fit(raw)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``toxic_score_``, 0 to 1."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = fit(docs, labels)
    if isinstance(model, float):
        return docs.withColumn("toxic_score_", F.lit(model))
    lexicon, trees, calibration = model
    x = with_numbers(docs, "toxic_x_", features_of(lexicon)).withColumn("toxic_v_", array_to_vector("toxic_x_")).drop("toxic_x_")
    for setter, name in ((trees.setFeaturesCol, "toxic_v_"), (trees.setRawPredictionCol, "toxic_raw_"), (trees.setProbabilityCol, "toxic_prob_"), (trees.setPredictionCol, "toxic_is_"), (calibration.setFeaturesCol, "toxic_p_"), (calibration.setPredictionCol, "toxic_score_")):
        setter(name)
    x = trees.transform(x).withColumn("toxic_p_", vector_to_array("toxic_prob_")[1]).drop("toxic_v_", "toxic_raw_", "toxic_prob_", "toxic_is_")
    return calibration.transform(x).drop("toxic_p_").withColumn("toxic_score_", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("toxic_score_"))))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, columns unchanged."""
    return scored(docs, labels).where(F.col("toxic_score_") < threshold).drop("toxic_score_")


def op10(spark, sf_dir: str) -> DataFrame:
    """Per document: its fold, score and verdict."""
    d = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score_").alias("score"), (F.col("toxic_score_") >= THRESHOLD).cast("int").alias("predicted"))
