"""Joins of the insight table with caches, feeds and cards; set operations on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.hashing import cache_key
from tidemark.functions.text import non_empty
from tidemark.operators.ordering import next_rows


def apply_cached_labels(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Cached labels override; competitor arrays are united.

    ``cache``: key, type, sentiment, topic, persona, urgency, executive_summary,
    competitors, products, grading_services.  One equi-join on the fingerprint; empty
    cached strings leave the row's value.  Of entries that share a key the largest, in
    order of its columns, counts, so rows never multiply.
    """
    c = cache.groupBy(key).agg(F.max(F.struct(*[F.col(x) for x in cache.columns if x != key])).alias("_c"))
    j = rows.join(c, key, "left")
    pick = lambda f, old: F.coalesce(non_empty(F.col(f"_c.{f}")), F.col(old))
    topic, kind = pick("topic", "topic"), pick("type", "type_tag")
    out = j.withColumns({
        "type_tag": kind, "topic": topic, "brand_sentiment": pick("sentiment", "brand_sentiment"), "persona": pick("persona", "persona"),
        "mentions_competitor": F.array_sort(F.array_union(F.coalesce("mentions_competitor", F.array().cast("array<string>")),
                                                          F.coalesce(F.col("_c.competitors"), F.array().cast("array<string>")))),
        "cached_products": F.col("_c.products"), "cached_grading_services": F.col("_c.grading_services"),
        "urgency": F.col("_c.urgency"), "executive_summary": F.col("_c.executive_summary"), "is_cached": F.col("_c").isNotNull(),
    })
    return out.withColumn("taxonomy", F.struct(F.col("type_tag").alias("type"), F.col("topic").alias("topic"), F.col("topic").alias("theme"))).drop("_c")


def with_cache_key(rows: DataFrame, text: str = "text", out: str = "cache_key") -> DataFrame:
    return rows.withColumn(out, cache_key(F.col(text)))


def pending_enrichment(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return rows.join(cache.select(key), key, "left_anti")


def cards_with_members(cards: DataFrame, stats: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Cards next to their cluster's counters; members stay a table of their own, keyed by the cluster."""
    return cards.join(stats, cluster, "left")


def attach_ideas(rows: DataFrame, ideas: DataFrame, text: str = "text") -> DataFrame:
    """``ideas(text, ideas)`` joined on the text's md5, so long texts do not travel as keys; of repeated texts the largest list counts."""
    i = ideas.groupBy(F.md5(F.col("text")).alias("_k")).agg(F.max("ideas").alias("_ideas"))
    j = rows.withColumn("_k", F.md5(F.coalesce(text, F.lit("")))).join(i, "_k", "left")
    return j.withColumn("ideas", F.coalesce("_ideas", F.array().cast("array<string>"))).drop("_k", "_ideas")


def novel_rows(new: DataFrame, existing: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """New rows whose url and title are both unseen.

    Rows without a url or title never match on that field.
    """
    urls = existing.where(F.length(url) > 0).select(F.col(url).alias("_u")).distinct()
    titles = existing.where(F.length(title) > 0).select(F.col(title).alias("_t")).distinct()
    out = new.join(urls, F.col(url) == F.col("_u"), "left_anti")
    return out.join(titles, F.col(title) == F.col("_t"), "left_anti")


def merge_append_novel(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(novel_rows(new, existing), allowMissingColumns=True)


def union_sources(tables: dict[str, DataFrame], label: str = "industry_source") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(name)) for name, df in tables.items()])


def new_labels(current: DataFrame, previous: DataFrame, label: str, n: str = "n", floor: int = 3) -> DataFrame:
    return current.join(previous.select(label), label, "left_anti").where(F.col(n) >= floor)


def temporal_edges(rows: DataFrame, pos: str, node: str, day: str, window_days: int = 14, ahead: int = 5) -> DataFrame:
    """(src, dst, weight): each row with the next five, when at most two weeks apart."""
    pairs = next_rows(rows.select(pos, F.col(node).alias("src"), F.col(day).alias("_d")), pos, ["src", "_d"], ahead)
    gap = F.abs(F.datediff("_d", "next__d"))
    return pairs.where(gap <= window_days).select("src", F.col("next_src").alias("dst"), (1 - gap / float(window_days)).alias("weight"))


def temporal_graph(rows: DataFrame, pos: str, node: str, day: str, tags: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with attributes, edges)."""
    return rows.select(F.col(node).alias("node"), F.col(day).alias("date"), F.col(tags).alias("tags"), "text"), temporal_edges(rows, pos, node, day)


def video_with_comments(videos: DataFrame, comments: DataFrame, pos: str = "pos", url: str = "url") -> DataFrame:
    """One row per url: the video, or a stand-in made from the first comment when it is missing.

    Comments are folded to a count and the first row per url (partial aggregation), so a
    video with millions of comments never becomes one array; the comments stay a table.
    """
    first = F.min_by(F.struct("title", "username", "post_date"), pos)
    folded = comments.groupBy(url).agg(F.count(F.lit(1)).alias("n_comments"), first.alias("_first"))
    v = videos.select(url, *[F.col(c).alias(f"_v_{c}") for c in ("title", "text", "username", "post_date")], F.lit(True).alias("_has"))
    j = v.join(folded, url, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_v_{c}"), F.col(f"_first.{c}")).alias(c)
    return j.select(url, pick("title"), F.coalesce("_v_text", F.format_string("%d quality comments on this video", "n_comments")).alias("text"),
                    pick("username"), pick("post_date"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"),
                    F.coalesce("_has", F.lit(False)).alias("has_video"))


# --- quotes and samples --------------------------------------------------------------------

def quote_select(members: DataFrame, cluster: str, keywords: Column | None = None, pos: str = "pos", score: str = "score",
                 snippet: Column | None = None, n: int = 3, min_len: int = 40) -> DataFrame:
    """Up to three quotes per cluster: on-topic complaints, then on-topic rows, else broadly topical rows.

    Expects ``is_keyword_topical`` and ``is_topical``.  Uniqueness by fingerprint and by the
    whole text - each one top-1 per (cluster, key); quotes that only begin alike stay.
    """
    from tidemark.operators.ordering import top_n_per_group

    bad = F.col("brand_sentiment").isin("Complaint", "Negative")
    tier = F.when(F.col("is_keyword_topical") & bad, 0).when(F.col("is_keyword_topical"), 1).when(F.col("is_topical"), 2)
    snip = snippet if snippet is not None else F.substring("text", 1, 220)
    rows = members.withColumns({"_tier": tier, "snippet": snip}).where(F.col("_tier").isNotNull() & (F.length("text") >= min_len))
    # The broad tier only counts where a cluster has no keyword row at all.
    has_kw = members.where("is_keyword_topical").select(cluster).distinct().withColumn("_kw", F.lit(True))
    rows = rows.join(has_kw, cluster, "left").where((F.col("_tier") < 2) | F.col("_kw").isNull())
    order = [F.asc("_tier"), F.desc(score), F.asc(pos)]
    for key in (F.coalesce("fingerprint", F.md5("text")), F.md5(F.lower(F.trim("text")))):
        rows = top_n_per_group(rows, [F.col(cluster), key], order, 1)
    return top_n_per_group(rows, cluster, order, n, "rank").drop("_tier", "_kw")


def best_samples(members: DataFrame, cluster: str, pos: str = "pos", score: str = "score", n: int = 8) -> DataFrame:
    """Up to eight representative rows: actionable topical (n - 2), other topical (to n - 1), then any actionable."""
    from tidemark.operators.ordering import top_n_per_group

    bad = F.col("brand_sentiment").isin("Complaint", "Negative")
    act = F.col("is_topical") & (bad | (F.col("type_tag") == "Feature Request"))
    kind = F.when(act, 0).when(F.col("is_topical"), 1).when(bad, 2)
    by_score = [F.desc(score), F.asc(pos)]
    ranked = top_n_per_group(members.withColumn("_k", kind).where("_k is not null"), [cluster, "_k"], by_score, n, "_i")
    # At most 3 n rows per cluster from here on.
    n0 = ranked.where("_k = 0").groupBy(cluster).agg(F.least(F.count(F.lit(1)), F.lit(n - 2)).alias("_n0"))
    ranked = ranked.join(n0, cluster, "left").withColumn("_n0", F.coalesce("_n0", F.lit(0)))
    main = ranked.where(((F.col("_k") == 0) & (F.col("_i") <= n - 2)) | ((F.col("_k") == 1) & (F.col("_i") <= F.greatest(F.lit(0), n - F.col("_n0") - 1))))
    spare = ranked.join(main.select(pos), pos, "left_anti").where(bad)
    both = main.withColumn("_s", F.lit(0)).unionByName(spare.withColumn("_s", F.lit(1)).withColumn("_k", F.lit(2)))
    return top_n_per_group(both, cluster, [F.asc("_s"), F.asc("_k"), *by_score], n, "rank").drop("_k", "_i", "_n0", "_s")
