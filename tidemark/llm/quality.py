"""Quality by Bradley-Terry ranking: document scores are learnt from preference pairs.

All labelled rows outside the held-out fold give pairs (a document of label 1, one of label 0). The chance that the first wins is the
logistic function of the difference of their scores, and scores are linear in the features: so a logistic regression without
intercept on feature differences fits the model. The cut is the quantile of these rows' scores that leaves their
share of label 0 below it; a document's ``score`` is the logistic function of its distance from the cut.

Features are taken from the whole text only. Null and empty texts have the features of no words. Without labels of both
kinds every score is the share of label 1 (0.5 without any). Repeated rows are scored each; extra columns pass through.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, labelled, numbered, table, with_numbers, written

#: Opponents of each labelled row of the more frequent kind.
OPPONENTS = 4
NAMES = ["distinct_words", "repeats", "bigram_variety", "all_capitals", "first_capitals", "marks", "symbols", "bars", "digits", "sentence_ends", "commas", "line_variety",
         "mean_length", "long_words", "log_words", "no_words"]


def features_of():
    """The function text -> values of ``NAMES``; rates are per word, so long and short texts compare."""
    word, marks, symbols = re.compile(r"\S+"), re.compile(r"[!?]{2,}"), re.compile(r"[#$%&*@^~=_<>{}\\]")

    def features(text: str) -> list[float]:
        w = word.findall(text)
        n = len(w)
        if not n:
            return [0.0] * (len(NAMES) - 1) + [1.0]
        low = [x.lower() for x in w]
        pairs = list(zip(low, low[1:]))
        lines = [x for x in text.split("\n") if x]
        per = lambda k: min(2.0, k / n)
        # the variety of words falls with length by nature, so that of the first-to-last root is used
        return [math.log(len(set(low))) / math.log(n + 1) if n > 1 else 1.0, per(sum(a == b for a, b in pairs)), len(set(pairs)) / max(1, len(pairs)),
                per(sum(len(x) > 1 and x.isupper() for x in w)), per(sum(x[0].isupper() for x in w)), per(len(marks.findall(text))), per(len(symbols.findall(text))), per(text.count("|")),
                per(sum(map(text.count, "0123456789"))), per(sum(x[-1] in ".!?" for x in w)), per(text.count(",")), len(set(lines)) / max(1, len(lines)),
                min(2.0, sum(map(len, w)) / n / 10), per(sum(len(x) > 20 for x in w)), math.log(n) / 10, 0.0]

    return features


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[float], float] | float:
    """(weights, cut) from every labelled row, or the share of label 1 where there is nothing to compare."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    own = labelled(labels, "quality").select(F.col("doc_id").alias("s_id"), F.col("quality").alias("mark"))
    # features are taken where a text is read, so the join moves some numbers per row and no text; labels never pass the driver
    x = with_numbers(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), "x", features_of).select("doc_id", "x")
    rows = written(x.join(own.hint("merge"), F.col("doc_id") == F.col("s_id")).select("doc_id", "mark", "x"))
    kinds = {r["mark"]: r["n"] for r in rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = kinds.get(0, 0), kinds.get(1, 0)
    if not n0 or not n1:
        return n1 / (n0 + n1) if n0 + n1 else 0.5
    many, few = (1, 0) if n1 >= n0 else (0, 1)
    # each kind in the order of a hash; rows of label 0 come first
    r = numbered(rows, [F.col("mark"), F.xxhash64("doc_id"), F.col("x")], "i").withColumn("i", F.col("i") - F.when(F.col("mark") == 1, n0).otherwise(0))
    meets = r.where(F.col("mark") == many).select("x", "i", F.explode(F.transform(F.sequence(F.lit(0), F.lit(OPPONENTS - 1)), lambda k: (F.col("i") * OPPONENTS + k) % kinds[few])).alias("j"))
    pairs = meets.join(r.where(F.col("mark") == few).select(F.col("x").alias("y"), F.col("i").alias("j")), "j")
    sign = F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0)  # half of the pairs the other way round
    won = sign if many == 1 else -sign
    pairs = pairs.select(F.zip_with("x", "y", lambda a, b: sign * (a - b)).alias("d"), F.when(won > 0, 1.0).otherwise(0.0).alias("won"))
    model = LogisticRegression(fitIntercept=False, standardization=True, regParam=1e-3, maxIter=60, featuresCol="v", labelCol="won").fit(pairs.select(array_to_vector("d").alias("v"), "won"))
    weights = [float(w) for w in model.coefficients]
    return weights, _quantile(rows.select(_dot("x", weights).alias("s")), "s", n0 / (n0 + n1), n0 + n1)


def _quantile(rows: DataFrame, col: str, share: float, n: int) -> float:
    """The exact quantile of ``n`` numbers, between its two neighbours in proportion; the rows are sorted in ranges."""
    at = share * (n - 1)
    low = math.floor(at)
    near = {r["i"]: r[col] for r in numbered(rows, [F.col(col)], "i").where(F.col("i").isin(low, low + 1)).collect()}
    return float(near[low] + (at - low) * (near.get(low + 1, near[low]) - near[low]))


def _dot(col: str, weights: list[float]):
    out = F.lit(0.0)
    for k, w in enumerate(weights):
        out = out + F.col(col)[k] * F.lit(w)
    return out


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality_score_``, 0 to 1."""
    model = fit(docs, labels)
    if isinstance(model, float):
        return docs.withColumn("quality_score_", F.lit(model))
    weights, cut = model
    d = with_numbers(docs, "quality_x_", features_of)
    return d.withColumn("quality_score_", 1 / (1 + F.exp(-(_dot("quality_x_", weights) - cut)))).drop("quality_x_")


def op2(spark, sf_dir: str) -> DataFrame:
    """Per document: its fold, score and verdict."""
    d = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score_").alias("score"), (F.col("quality_score_") >= 0.5).cast("int").alias("predicted"))
