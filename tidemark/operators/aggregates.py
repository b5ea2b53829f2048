"""Roll-ups, pivots and card summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.rules import Pack, all_labels, contains_any
from tidemark.functions.dates import monday
from tidemark.operators.ordering import top_n_per_group

COMPLAINT = ("Complaint", "Negative")
PRAISE = ("Praise", "Positive")


def percent_of_total(counts: DataFrame, n: str = "n", out: str = "pct") -> DataFrame:
    """Share of the whole in percent; the total is a scalar subquery over the same counts."""
    whole = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(out, F.col(n) * 100.0 / whole)


def source_distribution(df: DataFrame, source: str = "source") -> DataFrame:
    return percent_of_total(df.groupBy(F.coalesce(source, F.lit("Unknown")).alias(source)).agg(F.count(F.lit(1)).alias("n")))


def run_meta(df: DataFrame, source: str = "source") -> DataFrame:
    """One row: total, number of sources and the distribution as a map (one entry per source)."""
    counts = df.groupBy(F.coalesce(source, F.lit("Unknown")).alias(source)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_sources"),
                      F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("source_distribution"))


def label_distribution(df: DataFrame, label: str, limit: int = 25) -> DataFrame:
    """The most frequent labels, for display."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label)).limit(limit)


def run_snapshot(df: DataFrame, signals: dict[str, str], entities: dict[str, str], topic: str = "topic",
                 sentiment: str = "brand_sentiment", strength: str = "signal_strength") -> DataFrame:
    """Long table (metric_group, metric, value): totals, signal flags, entities, all topics.

    ``signals`` maps metric to boolean column, ``entities`` metric to topic value.  All
    counters come from one scan; topics from a second aggregation.
    """
    aggs = {("total", "total_insights"): F.count(F.lit(1)),
            ("sentiment", "total_negative"): F.count_if(F.col(sentiment) == "Negative"),
            ("sentiment", "total_positive"): F.count_if(F.col(sentiment) == "Positive"),
            ("churn", "churn"): F.count_if(F.col("is_churn_signal")), ("praise", "praise"): F.count_if(F.col("is_praise_signal")),
            ("strength", "avg_strength"): F.avg(strength)}
    aggs |= {("signal", name): F.count_if(F.col(c)) for name, c in signals.items()}
    aggs |= {("entity", name): F.count_if(F.col(topic) == v) for name, v in entities.items()}
    one = df.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(aggs.values())])
    rows = F.array(*[F.struct(F.lit(g).alias("metric_group"), F.lit(m).alias("metric"), F.col(f"_{i}").alias("value"))
                     for i, (g, m) in enumerate(aggs)])
    long = one.select(F.inline(rows))
    topics = df.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).select(F.lit("topic").alias("metric_group"), F.col(topic).alias("metric"),
                                                              F.col("n").cast("double").alias("value"))
    return long.unionByName(topics)


def cluster_stats(df: DataFrame, cluster: str, text: Column, sentiment: str = "brand_sentiment", type_tag: str = "type_tag",
                  payment: str = "has_payment", unpaid: str = "has_unpaid", high_value: str = "has_high_value", score: str = "score") -> DataFrame:
    neg, pos = F.col(sentiment).isin(*COMPLAINT), F.col(sentiment).isin(*PRAISE)
    asks = (F.col(type_tag) == "Feature Request") | contains_any(F.lower(text), ["feature", "wish", "should"])
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), F.count_if(neg).alias("complaints"), F.count_if(asks).alias("feature_requests"),
        F.count_if(neg).alias("negative"), F.count_if(pos).alias("positive"), F.count_if(F.col(payment)).alias("payments_flags"),
        F.count_if(F.col(unpaid)).alias("unpaid_flags"), F.count_if(F.col(high_value)).alias("high_value_flags"),
        F.avg(F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("avg_score"))


def kpi_banner(df: DataFrame, as_of: Column, type_tag: str = "type_tag", sentiment: str = "brand_sentiment", day: str = "post_date") -> DataFrame:
    bad = (F.col(type_tag) == "Complaint") | (F.col(sentiment) == "Negative")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("complaints"),
                  (F.count_if(bad) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("complaint_pct"),
                  F.count_if(F.col(day) >= F.date_sub(as_of, 3)).alias("recent_3d"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def pulse_with_recent(df: DataFrame, as_of: Column, type_tag: str = "type_tag", sentiment: str = "brand_sentiment",
                      day: str = "post_date", days: int = 14) -> DataFrame:
    recent = F.coalesce(F.col(day) >= F.date_sub(as_of, days), F.lit(False))
    tests = {"negative": F.col(sentiment).isin(*COMPLAINT), "positive": F.col(sentiment).isin(*PRAISE),
             "complaints": F.col(type_tag) == "Complaint", "churn": F.col(type_tag) == "Churn Signal",
             "requests": F.col(type_tag) == "Feature Request"}
    return df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()], *[F.count_if(t & recent).alias(f"recent_{n}") for n, t in tests.items()])


SENTIMENTS = ("Complaint", "Negative", "Neutral", "Positive", "Praise")


def sentiment_pivot(df: DataFrame, key: str, sentiment: str = "brand_sentiment", values=("Negative", "Neutral", "Positive")) -> DataFrame:
    """Counts per fixed sentiment value: listed values avoid the extra job a free pivot needs."""
    return df.groupBy(key).agg(*[F.count_if(F.col(sentiment) == v).alias(v.lower()) for v in values], F.count(F.lit(1)).alias("total"))


def brand_sentiment_pivot(df: DataFrame, brand: str, min_total: int = 3, top: int = 15) -> DataFrame:
    p = sentiment_pivot(df, brand).withColumn("complaint_pct", F.col("negative") * 100.0 / F.col("total"))
    return p.where((F.col(brand) != "Other") & (F.col("total") >= min_total)).orderBy(F.desc("complaint_pct"), F.asc(brand)).limit(top)


def persona_journey_pivot(df: DataFrame, stages: list[str], persona: str = "persona", journey: str = "journey_stage",
                          priority: str | None = None) -> DataFrame:
    """Persona by stage: counts, or mean priority with 0 for empty cells."""
    g = df.groupBy(persona).pivot(journey, stages)
    out = g.agg(F.avg(priority)) if priority else g.agg(F.count(F.lit(1)))
    return out.na.fill(0)


def live_or_brand(df: DataFrame, choice: str, topics: str = "topic_focus", brand: str = "target_brand", live=("Live Shopping", "Case Break / Repack")) -> DataFrame:
    """The heatmap's selector: everything, live-commerce rows, or one brand."""
    if choice == "All Insights":
        return df
    if choice == "Live Commerce Only":
        return df.where(F.arrays_overlap(F.col(topics), F.array(*[F.lit(v) for v in live])))
    return df.where(F.lower(brand) == choice.lower())


def daily_series(df: DataFrame, day: str, value: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.avg(value).alias("mean_value")] if value else [])
    return df.groupBy(F.col(day).cast("date").alias("day")).agg(*aggs)


def daily_top_series(df: DataFrame, day: str, label: str, top: int = 6) -> DataFrame:
    """(day, label, n) for the most frequent labels; the label list has ``top`` rows by construction."""
    counts = df.groupBy(F.col(day).cast("date").alias("day"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("label").agg(F.sum("n").alias("_t")).orderBy(F.desc("_t"), F.asc("label")).limit(top)
    return counts.join(F.broadcast(best.select("label")), "label", "left_semi")


def weekly_series(df: DataFrame, day: str, label: str, last_days: int = 60) -> DataFrame:
    """(week, label, n) over the last days before the newest row; weeks start on Monday."""
    newest = df.agg(F.max(F.col(day).cast("date"))).scalar()
    recent = df.where(F.col(day).cast("date") >= F.date_sub(newest, last_days))
    return recent.groupBy(monday(F.col(day)).alias("week"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def health_band(pct: Column, red: float, yellow: float, inclusive: bool = False) -> Column:
    if inclusive:
        return F.when(pct >= red, "red").when(pct >= yellow, "yellow").otherwise("green")
    return F.when(pct > red, "red").when(pct > yellow, "yellow").otherwise("green")


def partner_health(df: DataFrame, text: Column, pack: Pack, sentiment: str = "brand_sentiment") -> DataFrame:
    rows = df.select(F.col(sentiment).alias("_s"), F.explode(all_labels(text, pack)).alias("partner"))
    c = rows.groupBy("partner").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") == "Negative").alias("negative"))
    return c.withColumn("health", health_band(F.bround(F.col("negative") * 100.0 / F.col("n")), 40, 15))


def requests_by_topic(df: DataFrame, topic: str = "topic", score: str = "score", top: int = 8) -> DataFrame:
    named = df.where(F.col(topic).isNotNull() & ~F.col(topic).isin("General", "Unknown", ""))
    return (named.groupBy(topic).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("engagement"))
            .orderBy(F.desc("engagement"), F.asc(topic)).limit(top))


def request_examples(df: DataFrame, topic: str = "topic", score: str = "score", pos: str = "pos", top: int = 8, per_topic: int = 4) -> DataFrame:
    """The best requests of the leading topics."""
    topics = requests_by_topic(df, topic, score, top).select(topic)
    return top_n_per_group(df.join(F.broadcast(topics), topic, "left_semi"), topic, [F.desc(score), F.asc(pos)], per_topic, "rank")


def bucket_metrics(df: DataFrame, key: str, bucket: str, buckets: list[str], actionable: list[str]) -> DataFrame:
    """Rows per key and bucket as columns, with the sum over the actionable buckets."""
    out = df.groupBy(key).agg(*[F.count_if(F.col(bucket) == b).alias(b) for b in buckets])
    expr = F.lit(0)
    for b in actionable:
        expr = expr + F.col(b)
    return out.withColumn("actionable", expr)


def entity_stats(df: DataFrame, sentiment: str = "brand_sentiment", source: str = "source") -> DataFrame:
    neg, pos = F.count_if(F.col(sentiment) == "Negative"), F.count_if(F.col(sentiment) == "Positive")
    return df.agg(F.count(F.lit(1)).alias("total"), neg.alias("negative"), pos.alias("positive"),
                  (F.count(F.lit(1)) - neg - pos).alias("neutral"), F.count_distinct(F.coalesce(source, F.lit("Unknown"))).alias("sources"))


def issue_breakdown(df: DataFrame, bucket: str, score: str = "score") -> DataFrame:
    """(bucket, n, engagement, band, is_hottest)."""
    c = df.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("engagement"))
    # One row per bucket of the pack: the maximum comes from a scalar subquery over that small table.
    hottest = c.agg(F.max_by(bucket, F.struct("n", F.col("engagement")))).scalar()
    return c.withColumn("band", health_band(F.col("n"), 15, 5, True)).withColumn("is_hottest", F.col(bucket) == hottest)


def review_health(df: DataFrame, source: str = "source", sentiment: str = "brand_sentiment") -> DataFrame:
    c = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(sentiment) == "Negative").alias("negative"))
    pct = F.bround(F.col("negative") * 100.0 / F.col("n"))
    return c.withColumn("negative_pct", pct.cast("int")).withColumn("health", health_band(pct, 40, 15))


def product_cues(df: DataFrame, text: Column, confusion: list[str], likes: list[str], dislikes: list[str], sentiment: str = "brand_sentiment") -> DataFrame:
    neg, pos, n = F.count_if(F.col(sentiment) == "Negative"), F.count_if(F.col(sentiment) == "Positive"), F.count(F.lit(1))
    return df.agg(n.alias("total"), neg.alias("negative"), pos.alias("positive"), F.greatest(F.lit(0), n - neg - pos).alias("neutral"),
                  F.count_if(contains_any(text, confusion)).alias("confusion"), F.count_if(contains_any(text, likes)).alias("likes"),
                  F.count_if(contains_any(text, dislikes)).alias("dislikes"))


def keyword_frequency(df: DataFrame, text: Column, keywords: list[str], threshold: int = 5) -> DataFrame:
    """Rows containing each keyword: one scan with a counter per keyword, then one row per keyword."""
    one = df.agg(*[F.count_if(text.contains(k)).alias(f"_{i}") for i, k in enumerate(keywords)])
    rows = F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"_{i}").alias("n")) for i, k in enumerate(keywords)])
    return one.select(F.inline(rows)).where(F.col("n") >= threshold)


def top_words(df: DataFrame, text: Column, stop: list[str], n: int = 5, min_len: int = 3) -> DataFrame:
    """Most common purely alphabetic words; partial counts before the shuffle."""
    words = df.select(F.explode(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")).alias("word"))
    kept = words.where((F.length("word") > min_len) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(*stop))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("word")).limit(n)


def most_common(df: DataFrame, label: str, where: Column | None = None) -> Column:
    """Scalar subquery: the most frequent value, ties to the first in order."""
    rows = df.where(where) if where is not None else df
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return c.agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label)))).scalar()


def digest(df: DataFrame, text: Column, keywords: list[str], topic: str = "topic", brand: str = "target_brand",
           sentiment: str = "brand_sentiment", priority: str = "pm_priority_score") -> DataFrame:
    """One row: leading complaint topic, leading keyword, leading brand, mean priority."""
    kw = keyword_frequency(df, text, keywords, 1)
    order = F.array_position(F.array(*[F.lit(k) for k in keywords]), F.col("keyword"))
    top_kw = kw.agg(F.min_by("keyword", F.struct(-F.col("n"), order))).scalar()
    return df.agg(F.avg(priority).alias("mean_priority")).select(
        F.coalesce(most_common(df, topic, F.col(sentiment).isin(*COMPLAINT)), F.lit("N/A")).alias("top_complaint"),
        F.coalesce(top_kw, F.lit("N/A")).alias("rising_keyword"),
        F.coalesce(most_common(df, brand), F.lit("Unknown")).alias("top_brand"), "mean_priority")


def brand_comparator(df: DataFrame, a: str, b: str, brand: str = "target_brand") -> DataFrame:
    return sentiment_pivot(df.where(F.col(brand).isin(a, b)), brand)


def journey_sentiment(df: DataFrame, journey: str = "journey_stage", sentiment: str = "brand_sentiment") -> DataFrame:
    return df.groupBy(F.coalesce(journey, F.lit("Unknown")).alias("journey_stage"),
                      F.coalesce(sentiment, F.lit("Neutral")).alias("brand_sentiment")).agg(F.count(F.lit(1)).alias("n"))


def triangulation(df: DataFrame, topic: str = "topic", source: str = "source", limit: int = 8) -> DataFrame:
    """Topics backed by at least two sources."""
    c = df.where(F.col(topic).isNotNull() & ~F.col(topic).isin("General", "")).groupBy(topic, source).agg(F.count(F.lit(1)).alias("_n"))
    out = c.groupBy(topic).agg(F.count(F.lit(1)).alias("n_sources"), F.sum("_n").alias("total"),
                               F.array_sort(F.collect_set(source)).alias("sources"))
    return out.where(F.col("n_sources") >= 2).orderBy(F.desc("total"), F.asc(topic)).limit(limit)


def cluster_card(df: DataFrame, cluster: str, pos: str = "pos", sets: dict[str, str] | None = None, arrays: dict[str, str] | None = None,
                 score: str = "score", readiness: str = "cluster_ready_score", firsts: dict[str, str] | None = None, ideas: str | None = None) -> DataFrame:
    """Distinct label sets, score range, mean readiness, the first row's brand and type and the five leading ideas per cluster.

    ``sets`` and ``arrays`` map output to label column; label vocabularies come from
    rule packs, so each set stays small however many rows a cluster has.  ``ideas`` names
    an array of ideas per row, listed as ``top_ideas``.
    """
    aggs = [F.count(F.lit(1)).alias("insight_count"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
            F.avg(F.coalesce(F.col(readiness), F.lit(0.0))).alias("avg_cluster_ready")]
    aggs += [F.min_by(c, pos).alias(o) for o, c in (firsts or {}).items()]
    aggs += [F.array_sort(F.collect_set(c)).alias(o) for o, c in (sets or {}).items()]
    out = df.groupBy(cluster).agg(*aggs)
    for o, c in (arrays or {}).items():
        flat = df.select(cluster, F.explode(c).alias("_v")).groupBy(cluster).agg(F.array_sort(F.collect_set("_v")).alias(o))
        out = out.join(flat, cluster, "left").withColumn(o, F.coalesce(o, F.array().cast("array<string>")))
    if ideas:
        best = top_ideas(df, cluster, ideas, pos).groupBy(cluster).agg(ranked_list("idea").alias("top_ideas"))
        out = out.join(best, cluster, "left").withColumn("top_ideas", F.coalesce("top_ideas", F.array().cast("array<string>")))
    return out


def ranked_list(value: str, rank: str = "rank") -> Column:
    """The values of a few ranked rows as an array, best first."""
    return F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda r: r[value])


def top_ideas(df: DataFrame, cluster: str, ideas: str, pos: str = "pos", n: int = 5) -> DataFrame:
    """(cluster, idea, n, rank): ideas of more than ten characters, most frequent first, earliest on ties."""
    flat = df.select(cluster, F.col(pos).alias("_p"), F.posexplode(ideas).alias("_i", "_x")).withColumn("idea", F.trim("_x"))
    ok = flat.where((F.length("idea") > 10) & ~F.lower("_x").startswith("customer"))
    c = ok.groupBy(cluster, "idea").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_p", "_i")).alias("_f"))
    return top_n_per_group(c, cluster, [F.desc("n"), F.asc("_f")], n, "rank").drop("_f")


def distinct_actions(df: DataFrame, ideas: str, pos: str = "pos", n: int = 8, cluster: str | None = None) -> DataFrame:
    """Case-folded distinct ideas in order of first appearance."""
    keys = [cluster] if cluster else []
    flat = df.select(*keys, F.col(pos).alias("_p"), F.posexplode(ideas).alias("_i", "_x")).withColumn("idea", F.trim("_x"))
    first = (flat.where(F.col("idea") != "").groupBy(*keys, F.lower("idea").alias("_k"))
             .agg(F.min(F.struct("_p", "_i", "idea")).alias("_f")).select(*keys, "_f", F.col("_f.idea").alias("idea")))
    if keys:
        return top_n_per_group(first, keys, ["_f"], n, "rank").select(*keys, "rank", "idea")
    return first.orderBy("_f").limit(n).select("idea")


def heuristic_clusters(df: DataFrame, topic: Column, subtag: str = "topic", sentiment: str = "brand_sentiment", brand: str = "target_brand",
                       score: str = "score", limit: int = 12) -> DataFrame:
    """Groups by (first topic, sub-topic), the largest twelve, with the dominant or mixed sentiment."""
    g = df.groupBy(topic.alias("theme"), F.col(subtag).alias("subtag")).agg(
        F.count(F.lit(1)).alias("insight_count"),
        F.when(F.min(sentiment) == F.max(sentiment), F.min(sentiment)).otherwise("Mixed").alias("sentiment"),
        F.when(F.min(brand) == F.max(brand), F.min(brand)).otherwise("Multiple").alias("brand"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"))
    return g.orderBy(F.desc("insight_count"), F.asc("theme"), F.asc("subtag")).limit(limit)


def release_counts(df: DataFrame, category: str = "category", brand: str = "brand") -> DataFrame:
    return df.agg(F.count_if(F.col(category) == "release").alias("releases"), F.count_if(F.col(category) == "checklist").alias("checklists"),
                  F.count_distinct(F.coalesce(brand, F.lit("Other"))).alias("brands"))


def release_list(df: DataFrame, sport: str | None = None, brand: str | None = None, search: str | None = None, pos: str = "pos", limit: int = 50) -> DataFrame:
    if sport:
        df = df.where(F.col("sport") == sport)
    if brand:
        df = df.where(F.col("brand") == brand)
    if search:
        df = df.where(F.lower(F.concat_ws(" ", "title", "sport")).contains(search.lower()))
    return df.orderBy(F.desc("post_date"), F.asc(pos)).limit(limit)


def top_names(df: DataFrame, name: str, n: int = 8) -> DataFrame:
    return label_distribution(df, name, n)


def headline_feed(df: DataFrame, source: str = "source", day: str = "post_date", pos: str = "pos", n: int = 3) -> DataFrame:
    """Newest headlines per source."""
    head = F.substring(F.coalesce(F.when(F.length("title") > 0, F.col("title")), F.col("text")), 1, 120)
    return top_n_per_group(df.withColumn("headline", head), source, [F.desc(day), F.asc(pos)], n, "rank")


def distinct_handles(df: DataFrame, username: str = "username") -> DataFrame:
    return df.where(F.col(username).isNotNull() & ~F.lower(username).isin("unknown", "")).select(username).distinct()
