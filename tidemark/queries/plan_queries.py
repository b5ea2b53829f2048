"""Compositions as checked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import weekly
from tidemark.queries.base import INSIGHTS, P, POSTS, as_of, insights, posts, query
from tidemark.queries.search_queries import _HYBRID_SQL, _search_docs
from tidemark.queries.text_queries import ROUTE_SQL
from tidemark.session import cut_lineage, scratch_path


@query("weekly_run", f"WITH {POSTS}, {ROUTE_SQL} SELECT (SELECT count(*) FROM posts) AS total_posts_loaded, count(*) AS total_relevant, count(DISTINCT text) FILTER (WHERE length(title || ' ' || text) >= 30) AS total_insights FROM routed WHERE route IS NOT NULL")
def _weekly(spark, sf):
    return weekly.weekly_run(spark, posts(spark, sf), P, as_of(), scratch_path(spark, "weekly"), comment_source="src0", normalize=False).counts


@query("theme_cards")
def _cards(spark, sf):
    t = weekly.weekly_run(spark, posts(spark, sf), P, as_of(), scratch_path(spark, "weekly"), comment_source="src0", normalize=False)
    sets = ("personas", "sentiments", "effort_levels", "opportunity_tags", "topic_focus_tags", "mentions_competitor")
    counters = ("feature_requests", "negative", "positive", "payments_flags", "unpaid_flags", "high_value_flags", "min_score", "max_score")
    return t.cards.select("workstream", "insight_count", "complaints", "cluster_id", *[F.round(c, 6).alias(c) for c in ("coherence", "avg_cluster_ready", "avg_score")],
                          "theme", "title", "brand", "type", *[F.array_join(c, ",").alias(c) for c in sets], *counters,
                          *[F.array_join(c, "\n").alias(c) for c in ("quotes", "top_ideas")])


@query("full_run")
def _full(spark, sf):
    """Near-duplicate removal, light labels and trend alerts in one go."""
    _, alerts, _ = weekly.full_run(posts(spark, sf), P, as_of())
    return alerts.select("alert_type", "topic", "severity", F.round("current_value", 6).alias("current_value"))


_QUESTION = "what do people with things say about testing"
_ONE = _HYBRID_SQL.replace("qs AS (SELECT item_id AS query_id, text AS query, lower(text) AS qlo FROM benchmark)", f"qs AS (SELECT 0 AS query_id, '{_QUESTION}' AS query, '{_QUESTION}' AS qlo)").replace("rs <= 3)", "rs <= 15)")


@query("answer_context", _ONE.replace("SELECT query_id, doc_id, rank, round(s, 6) AS retrieval_score FROM fr", "SELECT doc_id, source, rank FROM fr"))
def _ask(spark, sf):
    docs = cut_lineage(_search_docs(spark, sf).select("post_id", "text", "title", "source", "topic", "persona", "signal_strength", "score", "post_date", "mentions_competitor", "brand_sentiment"))
    ctx = weekly.ask(_QUESTION, docs, P, as_of())
    return ctx.sources.select("doc_id", "source", "rank")


@query("cluster_quality", f"""WITH {INSIGHTS}, c AS (SELECT persona, topic, count(*) AS c FROM insights GROUP BY 1, 2), p AS (SELECT persona, sum(c) AS n, max(c) / sum(c)::DOUBLE AS p FROM c GROUP BY 1)
SELECT CAST(min(n) AS BIGINT) AS min_size, CAST(max(n) AS BIGINT) AS max_size, round(avg(p), 6) AS mean_purity, count(*) FILTER (WHERE p >= 0.8) AS above_80 FROM p""")
def _quality(spark, sf):
    q = weekly.cluster_quality(cut_lineage(insights(spark, sf).select("persona", "topic", "text", "title", "pos")), "persona")
    return q.select("min_size", "max_size", F.round("mean_purity", 6).alias("mean_purity"), "above_80")
