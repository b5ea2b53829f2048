"""Gold samples, label agreement, cluster quality, citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.clustering import mean_pairwise_jaccard
from tidemark.operators.ordering import rank_bounded, top_n_per_group


def stratified_gold_sample(df: DataFrame, strata: list[str], id_col: str, size: int = 200, seed: int = 42) -> DataFrame:
    """About ``size`` rows, shared among the strata by their weight, at least one from each.

    A seeded hash orders the rows, so the sample is the same on every run and cluster.
    """
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    quota = counts.withColumn("_take", F.greatest(F.lit(1), F.bround(F.col("_n") * size / total).cast("int"))).drop("_n")
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    # No stratum can claim more than `size` rows, which bounds the rows shipped per stratum and task.
    ranked = top_n_per_group(df.withColumn("_h", key), strata, ["_h", id_col], size, "_rn")
    picked = ranked.join(quota, strata).where(F.col("_rn") <= F.col("_take"))
    return picked.orderBy("_h", id_col).limit(size).drop("_h", "_rn", "_take")


def gold_entries(df: DataFrame, id_col: str = "post_id") -> DataFrame:
    """Sampled rows, numbered from 0, with the labels to evaluate and empty fields for people to fill."""
    null = lambda t: F.lit(None).cast(t)
    numbered = rank_bounded(df, [F.asc(id_col)], "_i")  # a sample, so of bounded size
    return numbered.select((F.col("_i") - 1).cast("bigint").alias("gold_id"),
        F.coalesce("fingerprint", F.md5("text")).alias("fingerprint"), "text", "title", "source", "url",
        F.col("brand_sentiment").alias("pipeline_sentiment"), F.col("type_tag").alias("pipeline_taxonomy_type"),
        F.col("topic").alias("pipeline_taxonomy_topic"), F.col("persona").alias("pipeline_persona"),
        F.lit(True).alias("pipeline_relevant"), F.col("signal_strength").alias("pipeline_signal_strength"),
        null("boolean").alias("human_relevant"), null("string").alias("human_sentiment"),
        null("string").alias("human_taxonomy_type"), null("string").alias("human_taxonomy_topic"),
        null("string").alias("human_persona"), F.lit("").alias("human_notes"), F.lit(False).alias("labeled"))


def gold_vs_pipeline(gold: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Labelled rows next to today's labels."""
    return gold.join(rows, key)


def accuracy(predicted: Column, actual: Column) -> Column:
    """Aggregate: share of equal labels over rows that have an actual one."""
    return F.coalesce(F.avg(F.when(actual.isNotNull(), predicted.eqNullSafe(actual).cast("int"))), F.lit(0.0))


def prf_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-9))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def precision_recall_f1(df: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    g = df.groupBy(*(keys or []))
    c = g.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    return c.select(*(keys or []), "tp", "fp", "fn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def per_class_prf(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One-vs-rest per class that occurs among the actual labels.

    Each row counts for its own actual and predicted class, so rows are not multiplied
    by the number of classes.
    """
    rows = df.where(F.col(actual).isNotNull()).select(F.col(predicted).alias("p"), F.col(actual).alias("a"))
    pairs = rows.groupBy("p", "a").agg(F.count(F.lit(1)).alias("n"))
    as_actual = pairs.groupBy(F.col("a").alias("class")).agg(
        F.sum(F.when(F.col("p") == F.col("a"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.coalesce(F.col("p") != F.col("a"), F.lit(True)), F.col("n")).otherwise(0)).alias("fn"))
    as_pred = pairs.where("p <> a").groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("fp"))
    c = as_actual.join(as_pred, "class", "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    return c.select("class", "tp", "fp", "fn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def cluster_size_stats(members: DataFrame, cluster: str) -> DataFrame:
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.median("n").alias("median_size"))


def cluster_purity(members: DataFrame, cluster: str, topic: str) -> DataFrame:
    """(cluster, n, purity): share of the most frequent topic."""
    counts = members.groupBy(cluster, topic).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(cluster).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("purity"))


def topic_purity(members: DataFrame, cluster: str, topic: str) -> DataFrame:
    p = cluster_purity(members, cluster, topic)
    return p.agg(F.avg("purity").alias("mean_purity"), F.min("purity").alias("min_purity"), F.count_if(F.col("purity") >= 0.8).alias("above_80"))


def token_coherence(members: DataFrame, cluster: str, text: Column) -> DataFrame:
    c = mean_pairwise_jaccard(members, cluster, text)
    return c.agg(F.avg("token_coherence").alias("mean_coherence"), F.min("token_coherence").alias("min_coherence"), F.max("token_coherence").alias("max_coherence"))


def citation_faithfulness(df: DataFrame, text: str, n_sources: Column, keep: list[str]) -> DataFrame:
    """How a written answer is grounded in its ``[S#]`` sources."""
    body = F.coalesce(F.col(text), F.lit(""))
    cites = F.regexp_extract_all(body, F.lit(r"\[S(\d+)\]"), F.lit(1))
    ids = F.array_distinct(F.transform(cites, lambda v: v.cast("bigint")))
    valid = F.filter(ids, lambda v: (v >= 1) & (v <= n_sources))
    sentences = F.filter(
        F.transform(F.split(body, r"[.!?]\s"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
        lambda s: (F.length(s) > 20) & ~s.startswith("#") & ~s.startswith("|") & ~s.startswith("-"))
    cited = F.filter(sentences, lambda s: s.rlike(r"\[S\d+\]"))
    out = df.select(*keep, F.size(cites).alias("total_citations"), F.size(valid).alias("unique_sources_cited"),
                    (F.size(ids) - F.size(valid)).alias("invalid_citations"),
                    F.size(sentences).alias("total_substantive_sentences"), F.size(cited).alias("cited_sentences"),
                    n_sources.alias("_n"))
    return out.select(
        *keep, "total_citations", "unique_sources_cited", "invalid_citations", "total_substantive_sentences", "cited_sentences",
        (F.col("cited_sentences") / F.greatest("total_substantive_sentences", F.lit(1))).alias("faithfulness_ratio"),
        (F.col("unique_sources_cited") / F.greatest("_n", F.lit(1))).alias("source_coverage"))
