"""Row predicates.  Each takes columns and the packs it needs and returns a boolean column.

``text`` is the raw text, ``lo`` the lower-cased text the packs are matched on (compute
it once in its own projection).  Cheap tests stand first: AND and OR stop early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.rules import Pack, any_hit, contains_any, fence, sum_hits, terms_of
from tidemark.functions.text import clean_text, split_multi_value
from tidemark.operators.ordering import keep_first_by_key

Packs = dict[str, Pack]


def vertical_lines(text: Column, first: int | None = None) -> Column:
    """Single-character lines of the whole text, or among its ``first`` lines where the caller asks for a prefix."""
    lines = F.split(text, "\n") if first is None else F.slice(F.split(text, "\n"), 1, first)
    return F.size(F.filter(lines, lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) == 1))


def is_relevant(text: Column, lo: Column, subreddit: Column, p: Packs) -> Column:
    """The full relevance gate for open sources."""
    sub = F.lower(F.coalesce(subreddit, F.lit("")))
    reject = (
        sub.isin(*terms_of(p["noise_subreddits"]))
        | any_hit(lo, p["sales_phrases"]) | any_hit(lo, p["bot_phrases"])
        | any_hit(lo, p["listing_phrases"]) | any_hit(lo, p["off_category"])
        | (vertical_lines(text) >= 5) | (sum_hits(lo, p["noise_phrases"]) >= 2)
    )
    pain = any_hit(lo, p["pain"])
    platform = any_hit(lo, p["platform_terms"]) | any_hit(lo, p["vault_terms"])
    accept = (
        (sub.isin(*terms_of(p["platform_subreddits"])) & pain)
        | any_hit(lo, p["partner_terms"])
        | (any_hit(lo, p["ecosystem_terms"]) & (pain | platform))
        | (pain & platform)
    )
    return ~reject & accept


def is_relevant_curated(lo: Column, p: Packs) -> Column:
    """Lighter gate for sources that are on topic by definition."""
    return (F.length(lo) >= 30) & ~any_hit(lo, p["curated_bot"]) & ~any_hit(lo, p["curated_sales"]) & ~any_hit(lo, p["curated_off_category"])


def is_competitor_intel(lo: Column, p: Packs) -> Column:
    """Names a tracked entity and talks about the domain or a platform."""
    return (F.length(lo) >= 40) & any_hit(lo, p["intel_entities"]) & (any_hit(lo, p["domain_regex"]) | any_hit(lo, p["platform_context"]))


def is_quality_comment(text: Column, lo: Column, likes: Column, p: Packs) -> Column:
    likes, hits = F.coalesce(likes, F.lit(0)), sum_hits(lo, p["comment_keywords"])
    good = ((likes >= 5) & (hits >= 1)) | ((hits >= 2) & (F.length(text) >= 80)) | (likes >= 15)
    return (F.length(text) >= 50) & ~any_hit(lo, p["comment_promo"]) & good


def route_relevant(df: DataFrame, p: Packs, comment_source: str, text: str = "text", title: str = "title", source: str = "source",
                   subreddit: str = "subreddit", likes: str = "like_count") -> DataFrame:
    """Kept rows with the ``route`` that accepted them.

    Order: quality comment, curated source, competitor intel, full gate; a failed
    curated test falls through to the next.
    """
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    base = df.withColumn("_both", both).withColumn("_lo", F.lower("_both")).withColumn("_tl", F.lower(F.coalesce(text, F.lit(""))))
    src = F.col(source)
    route = (
        F.when((src == comment_source) & is_quality_comment(F.coalesce(text, F.lit("")), F.col("_tl"), F.col(likes), p), "quality_comment")
        .when(src.isin(*terms_of(p["curated_sources"])) & is_relevant_curated(F.col("_lo"), p), "curated")
        .when(is_competitor_intel(F.col("_lo"), p), "competitor_intel")
        .when(is_relevant(F.col("_both"), F.col("_lo"), F.col(subreddit), p), "relevant")
    )
    # Fenced: the route is computed once, not again inside the filter.
    return base.withColumn("route", fence(route)).where(F.col("route").isNotNull()).drop("_both", "_lo", "_tl")


def screen_reason(text: Column, p: Packs, min_len: int = 40) -> Column:
    """too_short, noise_phrase, keyword_match or no_keyword, on the cleaned text."""
    cleaned = clean_text(text)
    lo = F.lower(cleaned)
    return (F.when(F.length(cleaned) < min_len, "too_short").when(any_hit(lo, p["screen_noise"]), "noise_phrase")
            .when(any_hit(lo, p["screen_keywords"]), "keyword_match").otherwise("no_keyword"))


def high_signal_or_score(lo: Column, score: Column, p: Packs, min_score: int = 2) -> Column:
    return (F.coalesce(score, F.lit(0)) >= min_score) | any_hit(lo, p["signal_keywords"])


def domain_relevant(lo: Column, source: Column, p: Packs) -> Column:
    """Trusted source: off-topic only with a strong term; otherwise a domain term and nothing off topic."""
    trusted = contains_any(F.lower(F.coalesce(source, F.lit(""))), terms_of(p["trusted_sources"]))
    off = any_hit(lo, p["off_topic"])
    return F.when(trusted, ~off | any_hit(lo, p["strong_terms"])).otherwise(any_hit(lo, p["domain_terms"]) & ~off)


def domain_gate(lo: Column, money: Column, p: Packs) -> Column:
    """Hard exclude, strong include, money risk include, weak include only in platform context."""
    weak = any_hit(lo, p["weak_hints"]) & ~any_hit(lo, p["false_compounds"]) & any_hit(lo, p["gate_context"])
    return ~any_hit(lo, p["gate_exclude"]) & (any_hit(lo, p["strong_hints"]) | F.coalesce(money, F.lit(False)) | weak)


def simple_gate(lo: Column, money: Column, p: Packs) -> Column:
    return any_hit(lo, p["simple_hints"]) | F.coalesce(money, F.lit(False))


def param_filters(df: DataFrame, brand: str | None = None, persona: str | None = None, topic: str | None = None, since: str | None = None,
                  min_score: float | None = None, max_items: int | None = None, day: Column | None = None, pos: str = "pos") -> DataFrame:
    """Optional filters; each becomes its own pushed-down condition."""
    if brand:
        df = df.where(F.lower("target_brand") == brand.lower())
    if persona:
        df = df.where(F.lower("persona") == persona.lower())
    if topic:
        df = df.where(F.array_contains("topic_focus", topic))
    if since:
        df = df.where((day if day is not None else F.col("post_date")) >= F.lit(since).cast("date"))
    if min_score is not None:
        df = df.where(F.coalesce(F.col("score").cast("double"), F.lit(0.0)) >= min_score)
    return df.orderBy(pos).limit(max_items) if max_items else df


def multiselect(df: DataFrame, selections: dict[str, list[str]]) -> DataFrame:
    """For each field any selected value passes; nothing or "All" selected passes everything."""
    kinds = dict(df.dtypes)
    for fld, chosen in selections.items():
        if not chosen or "All" in chosen:
            continue
        arr = kinds.get(fld, "").startswith("array")
        values = F.transform(F.col(fld), lambda v: F.trim(v)) if arr else split_multi_value(F.col(fld))
        df = df.where(F.arrays_overlap(values, F.array(*[F.lit(c) for c in chosen])))
    return df


def search_filter(df: DataFrame, query: str = "", tags: list[str] | None = None, brands: list[str] | None = None, sentiments: list[str] | None = None,
                  sort: str = "score", pos: str = "pos", limit: int = 100) -> DataFrame:
    if query:
        df = df.where(F.lower("text").contains(query.lower()))
    for fld, values in (("topic", tags), ("target_brand", brands), ("brand_sentiment", sentiments)):
        if values:
            df = df.where(F.col(fld).isin(*values))
    return df.orderBy(F.desc(sort) if sort == "score" else F.asc(sort), F.asc(pos)).limit(limit)


# The time ranges offered.
TIME_RANGES = {"Last 7 Days": 7, "Last 30 Days": 30, "Last 3 Months": 90, "Last 6 Months": 180, "Last 9 Months": 270}


def time_range(df: DataFrame, name: str, as_of: Column, day: str = "post_date") -> DataFrame:
    if name not in TIME_RANGES:
        return df
    return df.where(F.coalesce(F.col(day), F.lit("2000-01-01").cast("date")) >= F.date_sub(as_of, TIME_RANGES[name]))


def is_promotional(lo: Column, p: Packs) -> Column:
    return any_hit(lo, p["promotional"])


def is_feed_spam(source: Column, title: Column, lo: Column, p: Packs) -> Column:
    """Numbered stream titles and break ads on video, checklist items in news."""
    video = (source == "YouTube") & (F.lower(F.trim(title)).rlike(r"^!\d+\b") | (lo.contains("break w/") & any_hit(lo, p["break_ads"])))
    news = source.isin("News", "Cllct") & lo.contains("checklist") & any_hit(lo, p["checklist_phrases"])
    return F.coalesce(video | news, F.lit(False))


def issue_actionable(lo: Column, subreddit: Column, type_tag: Column, sentiment: Column, p: Packs) -> Column:
    """A complaint, bug or negative row about the platform that no exclusion covers."""
    sub = F.lower(F.coalesce(subreddit, F.lit("")))
    bad = type_tag.isin("Complaint", "Bug Report") | (sentiment == "Negative")
    about = any_hit(lo, p["issue_platforms"]) | sub.isin(*terms_of(p["issue_subs"])) | any_hit(lo, p["issue_features"])
    return bad & ~sub.isin(*terms_of(p["issue_exclude_subs"])) & about & ~any_hit(lo, p["issue_exclude"]) & ~any_hit(lo, p["issue_positive"])


def strict_product_signal(lo: Column, p: Packs) -> Column:
    return ~any_hit(lo, p["product_exclude"]) & (any_hit(lo, p["product_exact"]) | (any_hit(lo, p["product_context"]) & any_hit(lo, p["product_terms"])))


def context_gate(df: DataFrame, p: Packs, required: Pack, entity: str = "competitor", lo: Column | None = None) -> DataFrame:
    """Needs a context term, no excluded pattern and one of the entity's own keywords.

    An entity without keywords in the pack passes that part.
    """
    text = lo if lo is not None else F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))))
    base = df.withColumn("_lo", text)
    own = F.lit(True)
    for rule in required.rules:
        own = F.when(F.col(entity) == rule.label, contains_any(F.col("_lo"), [t.lower() for t in rule.substr])).otherwise(own)
    return base.where(any_hit(F.col("_lo"), p["context_terms"]) & ~any_hit(F.col("_lo"), p["context_exclude"]) & own).drop("_lo")


def is_request(lo: Column, type_tag: Column, p: Packs) -> Column:
    return (type_tag == "Feature Request") | any_hit(lo, p["request_hints"])


def viral_posts(df: DataFrame, feed: DataFrame, p: Packs, sources: dict[str, int], exclude_sub_sources: list[str], text: str = "text",
                title: str = "title", pos: str = "pos") -> DataFrame:
    """High-scoring, on-topic rows of social sources whose url the feed does not have.

    ``sources`` maps a source to its minimum score.
    """
    lo = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(title, F.lit(""))))
    enough = F.lit(False)
    for s, floor in sources.items():
        enough = enough | ((F.col("source") == s) & (F.col("score") >= floor))
    sub_ok = ~F.col("source").isin(*exclude_sub_sources) | ~F.lower(F.coalesce("subreddit", F.lit(""))).isin(*terms_of(p["industry_exclude_subs"]))
    kept = df.where(enough & sub_ok).withColumn("_lo", lo)
    kept = kept.where(~any_hit(F.col("_lo"), p["industry_exclude"]) & any_hit(F.col("_lo"), p["industry_terms"])).drop("_lo")
    urls = feed.where(F.length("url") > 0).select("url").distinct()
    return keep_first_by_key(kept.where(F.length("url") > 0).join(urls, "url", "left_anti"), "url", pos)


def min_length(df: DataFrame, n: int = 30, text: str = "text") -> DataFrame:
    return df.where(F.length(F.trim(F.coalesce(text, F.lit("")))) >= n)


def min_score(df: DataFrame, floor: float = 3.0, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= floor)
