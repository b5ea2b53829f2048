"""End-to-end compositions.

The weekly run writes one table, the insights, and derives everything else from it, so
the two branches (snapshot and themes) read Parquet instead of repeating the labelling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.rules import Pack, any_hit, contains_any, fenced, first_label
from tidemark.functions.text import keyword_snippet
from tidemark.operators import aggregates as agg, clustering, dedup, enrich, evaluation, filters, joins, retrieval, trends
from tidemark.operators.dedup import dedup_prefix
from tidemark.operators.search_index import SearchIndex
from tidemark.session import cut_lineage
from tidemark.sources import sinks

Packs = dict[str, Pack]

# Snapshot counters and the flag columns behind them.
SIGNAL_FLAGS = {"payment": "has_payment", "upi": "has_unpaid", "psa_turnaround": "has_grading", "authentication": "has_authenticity", "price_guide": "has_price_guide",
                "vault": "has_vault", "shipping": "has_shipping", "refund": "has_refund", "fees": "has_fees"}
# What a card lists for rows that carry no such label.
CARD_DEFAULTS = {"target_brand": "Unknown", "effort": "Unknown", "opportunity_tag": "General Insight"}
NO_QUOTES = "- _No representative quotes available for this theme._"
ENTITY_TOPICS = {"Goldin": "Goldin", "TCGPlayer": "TCGPlayer", "Heritage Auctions": "Heritage Auctions", "Competitors": "Competitor Intel"}


@dataclass
class WeeklyTables:
    insights: DataFrame
    snapshot: DataFrame
    deltas: DataFrame | None
    meta: DataFrame
    cards: DataFrame
    counts: DataFrame


def weekly_run(spark: SparkSession, posts: DataFrame, p: Packs, as_of: Column, out: str, previous: DataFrame | None = None,
               comment_source: str = "YouTube (comment)", normalize: bool = True) -> WeeklyTables:
    """Relevance routing, enrichment, de-duplication of equal texts, snapshot, deltas, themes.

    ``previous`` is the snapshot table of the run before.  Everything is written below ``out``.
    """
    relevant = filters.route_relevant(posts, p, comment_source)
    labelled = enrich.enrich_posts(relevant, p, as_of, normalize)
    dedup_prefix(labelled, fold=False, keep="first").write.mode("errorifexists").parquet(f"{out}/insights")
    insights = spark.read.parquet(f"{out}/insights")

    agg.run_snapshot(insights, SIGNAL_FLAGS, ENTITY_TOPICS).write.mode("errorifexists").parquet(f"{out}/snapshot")
    snapshot = spark.read.parquet(f"{out}/snapshot")
    deltas = None
    if previous is not None:
        trends.run_deltas(snapshot, previous).write.mode("errorifexists").parquet(f"{out}/deltas")
        deltas = trends.severity_order(spark.read.parquet(f"{out}/deltas"), confidence="delta", tie="metric")

    members = clustering.cluster_workstreams(_members(spark, insights, p, out))
    cards = theme_cards(members, p=p)
    counts = posts.agg(F.count(F.lit(1)).alias("total_posts_loaded")).select(
        "total_posts_loaded", relevant.agg(F.count(F.lit(1))).scalar().alias("total_relevant"), insights.agg(F.count(F.lit(1))).scalar().alias("total_insights"))
    agg.run_meta(insights).write.mode("errorifexists").parquet(f"{out}/meta")
    sinks.cluster_sink(members.select("workstream", "post_id"), cards, counts, f"{out}/clusters", "workstream")
    return WeeklyTables(insights, snapshot, deltas, spark.read.parquet(f"{out}/meta"), spark.read.parquet(f"{out}/clusters/cards"), counts)


def _members(spark: SparkSession, insights: DataFrame, p: Packs, out: str) -> DataFrame:
    labelled = enrich.workstream_of(insights.withColumn("mentions_competitor", enrich.mentions(F.lower("text"), p)["mentions_competitor"]), p)
    card_labels(labelled, p).write.mode("errorifexists").parquet(f"{out}/workstreams")
    return spark.read.parquet(f"{out}/workstreams")


def card_labels(df: DataFrame, p: Packs) -> DataFrame:
    """What cards need of their rows beyond the insight labels: brand, opportunity, effort, readiness, topical marks.

    Labels a row already has stay.  Frustration and impact are those of the light path; effort follows from
    the row's ideas, where it has any.
    """
    base = df.withColumn("_lo", F.lower("text"))
    lo = F.col("_lo")
    frustration = F.when(F.col("brand_sentiment").isin(*agg.COMPLAINT) | any_hit(lo, p["friction_phrases"]), 3).otherwise(1)
    made = {"target_brand": enrich.brand_of(lo, p), "opportunity_tag": first_label(lo, p["opportunities"], "General Insight"),
            "cluster_ready_score": enrich.cluster_ready(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), frustration, F.lit(2)),
            "has_competitor": F.size("mentions_competitor") > 0}
    if "ideas" in df.columns:
        made["effort"] = F.when(F.size("ideas") > 0, enrich.effort_of(F.col("ideas"), p)).otherwise(CARD_DEFAULTS["effort"])
    return enrich.topical_for(base.withColumns(fenced({c: v for c, v in made.items() if c not in df.columns})), p).drop("_lo")


def theme_cards(members: DataFrame, cluster: str = "workstream", p: Packs | None = None) -> DataFrame:
    """One card per theme: name, counters, label sets, brand and type, readiness, ideas, coherence, id and quotes.

    A theme is named by its cluster, so names are unique.  ``p`` has the keywords that quotes are cut around.
    """
    base = members.withColumns({c: F.lit(v) for c, v in CARD_DEFAULTS.items() if c not in members.columns})
    card = agg.cluster_card(base, cluster, sets={"personas": "persona", "sentiments": "brand_sentiment", "effort_levels": "effort", "opportunity_tags": "opportunity_tag"},
                            arrays={"topic_focus_tags": "topic_focus", "mentions_competitor": "mentions_competitor"},
                            firsts={"brand": "target_brand", "type": "type_tag"}, ideas="ideas" if "ideas" in members.columns else None)
    if "ideas" not in members.columns:
        card = card.withColumn("top_ideas", F.array().cast("array<string>"))
    card = card.withColumns({"theme": F.col(cluster), "title": F.col(cluster), "brand": F.coalesce("brand", F.lit("Unknown")), "type": F.coalesce("type", F.lit("Insight"))})
    stats = agg.cluster_stats(members, cluster, F.concat_ws("", "text", "title")).drop("size")
    coherence = clustering.coherence_fast(members, cluster, F.col("text")).select(cluster, "coherence")
    ids = clustering.cluster_ids(members, cluster, "fingerprint")
    whole = card.join(stats, cluster).join(coherence, cluster).join(ids, cluster).join(theme_quotes(members, cluster, p), cluster, "left")
    return whole.withColumn("quotes", F.coalesce("quotes", F.array(F.lit(NO_QUOTES))))


def theme_quotes(members: DataFrame, cluster: str = "workstream", p: Packs | None = None) -> DataFrame:
    """(cluster, quotes): snippets of up to three quotes, around the first keyword of the theme."""
    best = joins.quote_select(members.select(cluster, "pos", "score", "title", "text", "brand_sentiment", "fingerprint", "is_topical", "is_keyword_topical"), cluster)
    # At most three rows per theme from here on.
    title, body = F.trim(F.coalesce("title", F.lit(""))), F.trim("text")
    whole = F.when(title != "", F.btrim(F.concat(title, F.lit(". "), body), F.lit(". "))).otherwise(body)
    words = F.array().cast("array<string>")
    for r in reversed(p["workstream_topical"].rules if p else ()):
        words = F.when(F.col(cluster) == r.label, F.array(*[F.lit(w) for w in r.word]).cast("array<string>")).otherwise(words)
    cut = best.select(cluster, "rank", F.concat(F.lit("- _"), keyword_snippet(whole, words), F.lit("_")).alias("quote"))
    return cut.groupBy(cluster).agg(agg.ranked_list("quote").alias("quotes"))


def light_run(posts: DataFrame, p: Packs, as_of: Column) -> DataFrame:
    """Prefix de-duplication first, then the labels that need no remote call.

    ``posts`` carries model_sentiment and model_confidence (see ``with_lexicon_sentiment``).
    """
    return enrich.light_enrich(dedup_prefix(posts, fold=True, keep="first"), p)


def with_lexicon_sentiment(posts: DataFrame, p: Packs) -> DataFrame:
    """Stand-in for a sentiment model: word counts mapped to Complaint, Praise, Neutral."""
    base = posts.withColumn("_lo", F.lower(F.coalesce("text", F.lit(""))))
    s = enrich.lexicon_sentiment(F.col("_lo"), p)
    return base.withColumn("model_sentiment", F.when(s == "Negative", "Complaint").when(s == "Positive", "Praise").otherwise("Neutral")) \
               .withColumn("model_confidence", F.lit(50.0)).drop("_lo")


def full_run(posts: DataFrame, p: Packs, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(insights, alerts, absences): near-duplicate removal ahead of the labels, then trend detection."""
    unique = dedup.deduplicate(posts)
    insights = enrich.light_enrich(with_lexicon_sentiment(unique, p), p)
    # One row per topic and period: written once, every alert rule reads it.
    periods = cut_lineage(trends.period_counts(insights, "topic", "post_date", F.col("brand_sentiment").isin("Negative", "Complaint")))
    return insights, trends.detect_trends(periods), trends.silent_topics(periods)


@dataclass
class AnswerContext:
    sources: DataFrame
    corroborated: DataFrame
    alerts: DataFrame
    absences: DataFrame


def ask(question: str, insights: DataFrame, p: Packs, as_of: Column, vectors: DataFrame | None = None) -> AnswerContext:
    """Everything a written answer needs: ranked sources, cross-source topics, matching alerts.

    Broad questions take the stratified sample instead of retrieval.  The wording itself is
    left to whatever model the caller uses.
    """
    lo = question.lower()
    broad = [t for r in p["question_intents"].rules if r.label == "broad" for t in r.substr]
    if any(t in lo for t in broad):
        sources = retrieval.stratified_topics(insights, pos="post_id", personas=["Power Seller", "Collector", "Investor", "New Seller", "Casual Buyer"])
        sources = sources.withColumnRenamed("post_id", "doc_id")
    else:
        q = insights.sparkSession.createDataFrame([(0, question)], "query_id long, query string")
        sources = retrieval.hybrid_search(insights, q, vectors, p, as_of)
    periods = cut_lineage(trends.period_counts(insights, "topic", "post_date", F.col("brand_sentiment").isin("Negative", "Complaint")))
    words = lo.split()
    return AnswerContext(sources, agg.triangulation(sources), trends.relevant_alerts(trends.detect_trends(periods), words),
                         trends.relevant_absences(trends.silent_topics(periods), words))


def ask_many(questions: DataFrame, insights: DataFrame, p: Packs, as_of: Column, vectors: DataFrame | None = None,
             index: "SearchIndex | None" = None) -> AnswerContext:
    """``ask`` for a table of questions (query_id, query): every part carries the question it belongs to.

    Broad questions share one stratified sample; the others go through one hybrid search, from a stored index if one is given.
    """
    broad = contains_any(F.lower("query"), [t for r in p["question_intents"].rules if r.label == "broad" for t in r.substr])
    sample = retrieval.stratified_topics(insights, pos="post_id", personas=["Power Seller", "Collector", "Investor", "New Seller", "Casual Buyer"])
    # The sample is limited to forty rows.
    shared = questions.where(broad).select("query_id").withColumn("_one", F.lit(1)).join(F.broadcast(sample.withColumn("_one", F.lit(1))), "_one")
    found = retrieval.hybrid_search(insights, questions.where(~broad), vectors, p, as_of, index=index)
    wanted = ["query_id", "doc_id", "source", "topic", "rank"]
    sources = cut_lineage(found.select(wanted).unionByName(shared.withColumnRenamed("post_id", "doc_id").select(wanted)))
    periods = cut_lineage(trends.period_counts(insights, "topic", "post_date", F.col("brand_sentiment").isin("Negative", "Complaint")))
    backed = sources.groupBy("query_id", "topic").agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n")).where("n_sources > 1")
    return AnswerContext(sources, backed, trends.alerts_for(trends.detect_trends(periods), questions), trends.absences_for(trends.silent_topics(periods), questions))


def cluster_quality(members: DataFrame, cluster: str, topic: str = "topic") -> DataFrame:
    """One row: size distribution, purity and token coherence."""
    size = evaluation.cluster_size_stats(members, cluster)
    purity, tokens = evaluation.topic_purity(members, cluster, topic), evaluation.token_coherence(members, cluster, F.concat_ws(" ", "text", "title"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    # Three tables of one row each.
    return one(size).join(one(purity), "_one").join(one(tokens), "_one").drop("_one")


def cached_enrichment(insights: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with cached labels applied, rows still to label)."""
    keyed = joins.with_cache_key(insights)
    return joins.apply_cached_labels(keyed, cache), joins.pending_enrichment(keyed, cache)
