"""Enrichment labels and scores (group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import aggregates, enrich, retrieval
from tidemark.queries.base import (AS_OF, INSIGHTS, LOW, P, POSTS, as_of, insights, lowered, posts, q, query, sql_any, sql_best, sql_first, sql_flags,
                                   sql_labels, sql_pack, sql_sum, sql_words, table)
from tidemark.session import cut_lineage

FLAGS = list(dict.fromkeys(r.label for r in P["signal_flags"].rules))


@query("signal_flags", f"WITH {LOW} SELECT post_id, {sql_flags('signal_flags')} FROM low")
def _flags(spark, sf):
    return lowered(spark, sf).select("post_id", *[c.alias(n) for n, c in rules.flag_columns(F.col("lo"), P["signal_flags"]).items()])


@query("enrich_posts", f"""WITH {INSIGHTS} SELECT post_id, topic, type_tag, brand_sentiment, persona, clarity, is_urgent, round(signal_strength, 6) AS signal_strength, is_churn_signal, has_payment,
topic IN ('Things') AS is_subsidiary, CASE WHEN topic IN ('Things', 'Rivals') THEN topic ELSE '' END AS entity_name, md5(lower(text)) AS fp, length(text) AS kept FROM insights""")
def _enrich(spark, sf):
    d = enrich.enrich_posts(posts(spark, sf), P, as_of(), normalize=False)
    return d.select("post_id", "topic", "type_tag", "brand_sentiment", "persona", "clarity", "is_urgent", F.round("signal_strength", 6).alias("signal_strength"), "is_churn_signal", "has_payment",
                    F.col("is_subsidiary_signal").alias("is_subsidiary"), "entity_name", F.col("fingerprint").alias("fp"), F.length("text").cast("bigint").alias("kept"))


@query("topic_array", f"""WITH {INSIGHTS} SELECT post_id, array_to_string(CASE WHEN len(t) = 0 THEN ['General'] ELSE t END || CASE WHEN is_churn_signal THEN ['Competitive Churn'] ELSE [] END, ',') AS topics
FROM (SELECT *, {sql_labels('flag_topics')} AS t FROM insights)""")
def _topics(spark, sf):
    return enrich.enrich_posts(posts(spark, sf), P, as_of(), normalize=False).select("post_id", F.array_join("topic_focus", ",").alias("topics"))


@query("primary_subtag", f"WITH {INSIGHTS} SELECT topic, count(*) AS n FROM insights GROUP BY 1")
def _subtag(spark, sf):
    return insights(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("insight_type", f"WITH {INSIGHTS} SELECT type_tag, brand_sentiment, count(*) AS n FROM insights GROUP BY 1, 2")
def _type(spark, sf):
    return insights(spark, sf).groupBy("type_tag", "brand_sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("clarity_flag", "SELECT doc_id, CASE WHEN length(t) < 40 OR contains(t, '???') OR contains(t, 'idk') OR contains(t, 'confused') THEN 'Needs Clarification' ELSE 'Clear' END AS clarity FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents)")
def _clarity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", enrich.clarity_flag(F.col("text")).alias("clarity"))


_HIGH = f"({sql_pack('high_value_amount')} OR {sql_pack('high_value_words')})"


@query("payment_types", f"""WITH {LOW}, t AS (SELECT *, {sql_labels('payment_types')} AS ty FROM low) SELECT post_id, array_to_string(ty, ',') AS types, len(ty) > 0 AS has_payment, list_contains(ty, 'unpaid_item') AS has_unpaid, {_HIGH} AS has_high_value FROM t""")
def _payment(spark, sf):
    c = enrich.payment_types(F.col("text"), F.col("lo"), P)
    return lowered(spark, sf).select("post_id", F.array_join(c["payment_issue_types"], ",").alias("types"), *[c[k].alias(k) for k in ("has_payment", "has_unpaid", "has_high_value")])


@query("liquidity_types", f"WITH {LOW} SELECT post_id, array_to_string({sql_labels('liquidity_types')}, ',') AS types, array_to_string({sql_labels('liquidity_platforms')}, ',') AS platforms FROM low")
def _liquidity(spark, sf):
    c = enrich.liquidity_types(F.col("lo"), P)
    return lowered(spark, sf).select("post_id", F.array_join(c["liquidity_signal_types"], ",").alias("types"), F.array_join(c["liquidity_platforms"], ",").alias("platforms"))


_SEVL = [r for r in P["severity"].rules if r.substr]


@query("severity", f"""WITH {LOW} SELECT post_id, CASE {' '.join(f"WHEN {sql_any('lo', r.substr)} THEN {r.label}" for r in _SEVL)} ELSE 30 END AS score,
CASE {' '.join(f"WHEN {sql_any('lo', r.substr)} THEN '{dict(r.attrs)['reason']}'" for r in _SEVL)} ELSE 'neutral' END AS reason FROM low""")
def _severity(spark, sf):
    return lowered(spark, sf).select("post_id", enrich.severity(F.col("lo"), P).alias("s")).select("post_id", "s.score", "s.reason")


@query("mentions", f"WITH {LOW} SELECT post_id, {', '.join(f'array_to_string(list_sort({sql_labels(k)}), {q(chr(44))}) AS {a}' for k, a in (('competitors', 'competitors'), ('partners', 'partners'), ('market_terms', 'market')))} FROM low")
def _mentions(spark, sf):
    c = enrich.mentions(F.col("lo"), P)
    return lowered(spark, sf).select("post_id", F.array_join(c["mentions_competitor"], ",").alias("competitors"), F.array_join(c["mentions_partner"], ",").alias("partners"), F.array_join(c["mentions_market"], ",").alias("market"))


@query("topic_focus", f"""WITH {LOW}, t AS (SELECT *, {sql_labels('topic_focus')} AS tg FROM low), u AS (SELECT post_id, tg || CASE WHEN {sql_any('lo', P['topic_focus_guarded'].rules[0].substr)} AND NOT list_contains(tg, 'Price Guide') THEN ['Fees/Pricing'] ELSE [] END AS tg FROM t)
SELECT post_id, array_to_string(list_sort(list_distinct(tg)), ',') AS tags FROM u""")
def _focus(spark, sf):
    return lowered(spark, sf).select("post_id", F.array_join(enrich.topic_focus(F.col("lo"), P), ",").alias("tags"))


@query("action_effort", f"WITH {LOW} SELECT post_id, {sql_first('action_types', 'Unclear')} AS action, {sql_first('effort_words', 'High')} AS effort FROM low")
def _action(spark, sf):
    lo = F.col("lo")
    return lowered(spark, sf).select("post_id", rules.first_label(lo, P["action_types"], "Unclear").alias("action"), enrich.effort_of(F.array(lo), P).alias("effort"))


@query("combined_score", f"""WITH {LOW}, s AS (SELECT post_id, {sql_sum('heuristic_weights', weighted=True)} AS h, score % 100 AS sem, score % 5 AS f, score % 4 AS i FROM low)
SELECT post_id, round(0.5 * sem + 0.3 * h + f + i, 6)::DOUBLE AS combined, round(0.3 * h + f + i + sem * 0.3, 6)::DOUBLE AS light, round((score0 + f * 5 + i * 5) / 3.0::DOUBLE, 6) AS ready FROM (SELECT *, sem AS score0 FROM s)""")
def _combined(spark, sf):
    d = lowered(spark, sf).withColumn("h", enrich.heuristic_score(F.col("lo"), P))
    sem, f, i = F.col("score") % 100, F.col("score") % 5, F.col("score") % 4
    return d.select("post_id", F.round(enrich.combined_score(sem, F.col("h"), f, i), 6).alias("combined"), F.round(enrich.light_score(F.col("h"), f, i, sem), 6).alias("light"), F.round(enrich.cluster_ready(sem, f, i), 6).alias("ready"))


@query("semantic_max_similarity", "SELECT v.vec_id, round(max(list_dot_product(v.embedding::DOUBLE[], e.embedding::DOUBLE[])) * 100, 5) AS semantic FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id % 50 = 7) e GROUP BY 1")
def _semantic(spark, sf):
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    ex = e.where("vec_id % 50 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return retrieval.max_similarity(v, ex).select(F.col("doc_id").alias("vec_id"), F.round("semantic", 5).alias("semantic"))


@query("priority_minmax", f"WITH {INSIGHTS} SELECT post_id, round(100 * (pm_priority_score - min(pm_priority_score) OVER ()) / (max(pm_priority_score) OVER () - min(pm_priority_score) OVER () + 1e-5), 5) AS percentile FROM insights")
def _minmax(spark, sf):
    return enrich.priority_minmax(insights(spark, sf), "pm_priority_score", "p").select("post_id", F.round("p", 5).alias("percentile"))


@query("promote_flags", f"""WITH {LOW}, a AS (SELECT *, {sql_labels('payment_types')} AS pt, {sql_labels('liquidity_types')} AS lt, {_HIGH} AS hv, CASE WHEN post_id % 3 = 0 THEN NULL WHEN post_id % 3 = 1 THEN 'General Insight' ELSE 'Trust Erosion' END AS o0,
CASE WHEN post_id % 2 = 0 THEN 'General' ELSE 'Seller' END AS p0, CASE WHEN post_id % 5 = 0 THEN 'Neutral' ELSE 'Praise' END AS s0 FROM low),
b AS (SELECT *, CASE WHEN o0 IS NULL AND len(list_filter(pt, lambda x: x <> 'unpaid_item')) > 0 THEN 'Conversion Blocker' ELSE o0 END AS o1 FROM a),
c AS (SELECT *, CASE WHEN list_contains(pt, 'unpaid_item') AND (o1 IS NULL OR o1 = 'General Insight') THEN 'Policy Risk' ELSE o1 END AS o2 FROM b)
SELECT post_id, CASE WHEN len(lt) > 0 AND (o2 IS NULL OR o2 = 'General Insight') THEN 'Liquidity Signal' ELSE o2 END AS opportunity, CASE WHEN len(pt) > 0 AND s0 = 'Neutral' THEN 'Complaint' ELSE s0 END AS sentiment,
CASE WHEN hv AND p0 = 'General' THEN 'High-End User' ELSE p0 END AS persona, array_to_string(list_filter(['Base', CASE WHEN len(pt) > 0 THEN 'Payments' END, CASE WHEN list_contains(pt, 'unpaid_item') THEN 'UPI' END, CASE WHEN len(lt) > 0 THEN 'Instant Offers / Liquidity' END], lambda x: x IS NOT NULL), ',') AS topics FROM c""")
def _promote(spark, sf):
    i, lo = F.col("post_id"), F.col("lo")
    d = lowered(spark, sf).withColumns({
        **enrich.payment_types(F.col("text"), lo, P), **enrich.liquidity_types(lo, P), "topic_focus": F.array(F.lit("Base")), "subtags": F.array().cast("array<string>"),
        "opportunity_tag": F.when(i % 3 == 1, "General Insight").when(i % 3 == 2, "Trust Erosion"), "persona": F.when(i % 2 == 0, "General").otherwise("Seller"),
        "brand_sentiment": F.when(i % 5 == 0, "Neutral").otherwise("Praise")})
    return enrich.promote_flags(d).select("post_id", F.col("opportunity_tag").alias("opportunity"), F.col("brand_sentiment").alias("sentiment"), "persona", F.array_join("topic_focus", ",").alias("topics"))


_WORDS = P["subtag_words"].rules
_WORD_SQL = "list_filter([" + ", ".join(f"CASE WHEN {sql_words(r.word)} THEN {q(r.label)} END" for r in _WORDS) + "], lambda x: x IS NOT NULL)"


@query("subtag_labels", f"""WITH {LOW}, w AS (SELECT *, {_WORD_SQL} AS w FROM low), k AS (SELECT post_id, {sql_pack('friction_phrases')} AS fr, w, CASE WHEN {sql_pack('valuation_phrases')} THEN ['Valuation Question'] || list_filter(w, lambda x: x <> 'Grading Complaint') ELSE w END AS l FROM w)
SELECT post_id, array_to_string(CASE WHEN len(l) = 0 THEN ['General'] ELSE l END, ',') AS labels, array_to_string(CASE WHEN fr AND NOT list_contains(w, 'Vault Friction') THEN ['Vault Friction'] || list_filter(CASE WHEN len(w) = 0 THEN ['General'] ELSE w END, lambda x: x <> 'Refund Issue') WHEN len(w) = 0 THEN ['General'] ELSE w END, ',') AS light FROM k""")
def _subtags(spark, sf):
    lo = F.col("lo")
    return lowered(spark, sf).select("post_id", F.array_join(enrich.subtag_labels(lo, P), ",").alias("labels"), F.array_join(enrich.subtags_light(lo, rules.any_hit(lo, P["friction_phrases"]), P), ",").alias("light"))


@query("brand_lexical", f"WITH {LOW} SELECT post_id, {sql_first('brands', 'Unknown')} AS brand FROM low")
def _brand(spark, sf):
    return lowered(spark, sf).select("post_id", enrich.brand_lexical(F.col("lo"), P).alias("brand"))


def _fuzzy_sql() -> str:
    lists = []
    for i, r in enumerate(P["brands"].rules):
        for t in r.substr:
            lists.append(f"{{'r': 1 - levenshtein(x, {q(t)}) / greatest(length(x), {len(t)})::DOUBLE, 'p': {-i}, 'b': {q(r.label)}}}")
    best = f"list_aggregate([{', '.join(lists)}], 'max')"
    words = "SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS x FROM documents"
    return f"SELECT doc_id, brand, count(*) AS n FROM (SELECT doc_id, CASE WHEN ({best}).r >= 0.6 THEN ({best}).b END AS brand FROM ({words})) WHERE brand IS NOT NULL GROUP BY 1, 2"


@query("brand_fuzzy", _fuzzy_sql())
def _fuzzy(spark, sf):
    """Brands that the words of each text come close to."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    d = table(spark, sf, "documents").select("doc_id", F.explode(words).alias("x"))
    return d.select("doc_id", enrich.brand_fuzzy(F.col("x"), P, 0.6).alias("brand")).where("brand is not null").groupBy("doc_id", "brand").agg(F.count(F.lit(1)).alias("n"))


def _brand_rule_sql() -> str:
    pat = lambda name: " OR ".join(f"regexp_matches(lo, replace({q(t)}, '{{brand}}', b))" for r in P[name].rules for t in r.substr)
    return f"""WITH {LOW}, x AS (SELECT post_id, lo, CASE post_id % 3 WHEN 0 THEN 'thing' WHEN 1 THEN 'thble' ELSE 'que' END AS b FROM low)
SELECT post_id, CASE WHEN contains(lo, b) AND {sql_pack('praise_words')} THEN 'Praise' WHEN contains(lo, b) AND {sql_pack('complaint_brand_words')} THEN 'Complaint' WHEN {pat('praise_patterns')} THEN 'Praise' WHEN {pat('complaint_patterns')} THEN 'Complaint' ELSE 'Neutral' END AS mood FROM x"""


@query("brand_sentiment_rules", _brand_rule_sql())
def _brand_rules(spark, sf):
    i = F.col("post_id") % 3
    d = lowered(spark, sf).withColumn("b", F.when(i == 0, "Thing").when(i == 1, "thble").otherwise("que"))
    return d.select("post_id", enrich.brand_sentiment_rules(F.col("lo"), F.col("b"), P).alias("mood"))


_IN = lambda name: ", ".join(q(t) for r in P[name].rules for t in r.substr)


@query("light_enrich", f"""WITH {LOW}, e AS (SELECT *, {_WORD_SQL} AS w, {sql_pack('friction_phrases')} AS fr, {sql_sum('heuristic_weights', weighted=True)} AS h, {sql_labels('payment_types')} AS pt,
CASE post_id % 3 WHEN 0 THEN 'Complaint' WHEN 1 THEN 'Praise' ELSE 'Neutral' END AS ms, post_id % 40 AS mc FROM low WHERE length(trim(text)) >= 30 AND CASE WHEN {sql_any('source', [t for r in P['trusted_sources'].rules for t in r.substr])}
THEN NOT {sql_pack('off_topic', "lower(text || ' ' || title)")} OR {sql_pack('strong_terms', "lower(text || ' ' || title)")} ELSE {sql_pack('domain_terms', "lower(text || ' ' || title)")} AND NOT {sql_pack('off_topic', "lower(text || ' ' || title)")} END),
f AS (SELECT *, CASE WHEN ms = 'Complaint' OR fr THEN 3 ELSE 1 END AS fru FROM e)
SELECT post_id, round(0.3 * h + fru + 2 + mc * 0.3, 6)::DOUBLE AS score, CASE WHEN fr THEN 'Complaint' ELSE ms END AS sentiment, {sql_first('light_personas', 'General')} AS persona, {sql_first('brands', 'Unknown')} AS brand,
CASE WHEN fr THEN 'Complaint' WHEN {sql_pack('light_churn')} THEN 'Churn Signal' WHEN {sql_pack('light_requests')} THEN 'Feature Request' WHEN ms = 'Complaint' THEN 'Complaint' ELSE 'Discussion' END AS type_tag, len(pt) > 0 AS has_payment
FROM f WHERE 0.3 * h + fru + 2 + mc * 0.3 >= 3""")
def _light(spark, sf):
    i = F.col("post_id")
    d = posts(spark, sf).withColumns({"model_sentiment": F.when(i % 3 == 0, "Complaint").when(i % 3 == 1, "Praise").otherwise("Neutral"), "model_confidence": (i % 40).cast("double")})
    out = enrich.light_enrich(d, P)
    return out.select("post_id", F.round("score", 6).alias("score"), F.col("brand_sentiment").alias("sentiment"), "persona", F.col("target_brand").alias("brand"), "type_tag", "has_payment")


def _query_enrich_sql() -> str:
    s = {k: sql_sum(f"adhoc_{k}") for k in ("negative", "positive", "churn", "feature", "bug", "specific")}
    words = ["best", "thing", "with"]
    hits = lambda c: " + ".join(f"CAST(contains({c}, {q(w)}) AS INTEGER)" for w in words)
    return f"""WITH {POSTS}, a AS (SELECT *, lower(text || ' ' || title) AS lo, lower(title) AS tl FROM posts),
b AS (SELECT *, {s['negative']} + {s['churn']} AS neg, {s['positive']} AS p, {s['churn']} AS ch, {s['feature']} AS ft, {s['bug']} AS bg, {s['specific']} AS sp, length(lo) AS n FROM a)
SELECT post_id, CASE WHEN neg > p + 1 THEN 'Negative' WHEN p > neg + 1 THEN 'Positive' WHEN neg > p THEN 'Mixed-Negative' WHEN p > neg THEN 'Mixed-Positive' ELSE 'Neutral' END AS mood,
CASE WHEN ft >= 2 OR (ft = 1 AND neg = 0) THEN 'Feature Request' WHEN bg >= 2 THEN 'Bug Report' WHEN ch >= 1 THEN 'Churn Signal' WHEN neg >= 2 THEN 'Complaint' WHEN p >= 2 THEN 'Praise' WHEN {sql_pack('adhoc_news')} THEN 'Industry News' WHEN contains(text, '?') AND n < 300 THEN 'Question' ELSE 'Discussion' END AS kind,
{sql_best('adhoc_topics', 'General')} AS topic, {sql_best('adhoc_personas', 'Unknown')} AS persona, {sql_best('adhoc_journey', 'Unknown')} AS journey,
greatest(10, least(100, CAST(round_even(least(30.0, log2((score + num_comments + like_count + 1)::DOUBLE) * 5) + least(25, sp * 5) + least(25, (neg + ch + bg) * 6) + least(20.0, n / 200.0 * 4), 0) AS INTEGER))) AS strength,
CAST(round_even(CASE WHEN contains(lo, 'best thing with') THEN 40 ELSE 0 END + least(30, ({hits('lo')}) * 10) + least(20, ({hits('tl')}) * 8) + greatest(0.0, 10 - date_diff('day', post_date, DATE '{AS_OF}') / 30.0::DOUBLE), 0) AS INTEGER) AS relevance FROM b"""


@query("query_enrich", _query_enrich_sql())
def _query_enrich(spark, sf):
    d = enrich.query_enrich(posts(spark, sf), "Best thing with", P, as_of())
    return d.select("post_id", F.col("brand_sentiment").alias("mood"), F.col("type_tag").alias("kind"), "topic", "persona", F.col("journey_stage").alias("journey"), F.col("signal_strength").alias("strength"), F.col("relevance_score").alias("relevance"))


WORKSTREAM = f"""ws0 AS (SELECT *, list_transform(CASE WHEN len(t0) = 0 THEN ['General'] ELSE t0 END || CASE WHEN is_churn_signal THEN ['Competitive Churn'] ELSE [] END, lambda x: lower(x)) AS tp, lower(title || ' ' || text) AS wl
FROM (SELECT *, {sql_labels('flag_topics')} AS t0 FROM insights)), ws1 AS (SELECT *, {sql_flags('workstream_flags', 'wl')} FROM ws0), ws AS (SELECT *, coalesce({sql_first('workstreams', None, 'wl')}, {sql_first('workstream_topics', None, 'lower(topic)')}, 'General Platform Feedback') AS workstream FROM ws1)"""


def with_workstream(spark, sf):
    """The labelled insight table as the weekly run keeps it: written once, read by every card step.

    Planning the card steps on top of the whole labelling plan takes far longer than reading the table.
    """
    return cut_lineage(enrich.workstream_of(insights(spark, sf), P).drop("taxonomy", "title_", "url", "username", "logged_at"))


@query("workstream_of", f"WITH {INSIGHTS}, {WORKSTREAM} SELECT post_id, workstream FROM ws")
def _workstream(spark, sf):
    return enrich.workstream_of(insights(spark, sf), P).select("post_id", "workstream")


def _topical_sql() -> str:
    full, kw = [], []
    for r in P["workstream_topical"].rules:
        k = sql_words(r.word, "wl")
        ctx = sql_any("wl", r.all_of[0]) if r.all_of else "TRUE"
        other = " OR ".join([f for f in r.flags] + ([f"list_has_any(tp, [{', '.join(q(t) for t in r.topics)}])"] if r.topics else [])) or "FALSE"
        full.append(f"WHEN workstream = {q(r.label)} THEN CASE WHEN {k} THEN {ctx} ELSE ({other}) END")
        kw.append(f"WHEN workstream = {q(r.label)} THEN {k}")
    # Later rules of the shipped pack still apply to workstreams the sample does not name.
    return f"topical AS (SELECT *, CASE {' '.join(full)} ELSE TRUE END AS is_topical, CASE {' '.join(kw)} ELSE TRUE END AS is_keyword_topical FROM ws)"


TOPICAL = _topical_sql()


@query("topical_for", f"WITH {INSIGHTS}, {WORKSTREAM}, {TOPICAL} SELECT post_id, is_topical, is_keyword_topical FROM topical")
def _topical(spark, sf):
    return enrich.topical_for(with_workstream(spark, sf), P).select("post_id", "is_topical", "is_keyword_topical")


@query("entity_of", f"""WITH {INSIGHTS} SELECT post_id, coalesce({sql_first('entities', None, 'tlo')}, CASE WHEN topic IN ('Payments', 'Fees') THEN 'Money' WHEN topic IN ('Trust') THEN 'Safety' END, {sql_first('entity_fallback', None, 'tlo')}, 'General') AS entity, target_brand FROM insights""")
def _entity(spark, sf):
    return insights(spark, sf).select("post_id", enrich.entity_of(F.lower("text"), F.col("topic"), P).alias("entity"), "target_brand")


BUCKET = (f"CASE WHEN {sql_pack('change_policy')} OR (score >= 10 AND {sql_pack('change_business')}) THEN 'changes' WHEN {sql_pack('competitor_complaints')} THEN 'complaints' "
          f"WHEN {sql_pack('competitor_praise')} THEN 'praise' WHEN {sql_pack('competitor_comparison')} THEN 'comparison' WHEN score >= 5 THEN 'discussion' END")


@query("competitor_bucket", f"""WITH {LOW} SELECT post_id, {BUCKET} AS bucket, {sql_first('change_sections', 'other')} AS section, coalesce({sql_first('subsidiary_buckets', None)}, CASE WHEN score >= 5 THEN 'discussion' END) AS sub_bucket FROM low""")
def _bucket(spark, sf):
    lo, s = F.col("lo"), F.col("score")
    return lowered(spark, sf).select("post_id", enrich.competitor_bucket(lo, s, P).alias("bucket"), enrich.change_section(lo, P).alias("section"), enrich.subsidiary_bucket(lo, s, P).alias("sub_bucket"))


ISSUE = "CASE " + " ".join(f"WHEN {sql_any('tlo', r.substr)} THEN {q(r.label)}" for r in P["issue_categories"].rules) + " END"


@query("issue_bucket", f"WITH {LOW} SELECT post_id, {ISSUE.replace('tlo', 'lo')} AS category, {ISSUE.replace('tlo', 'lo')} || ' PM' AS owner FROM low")
def _issue(spark, sf):
    return lowered(spark, sf).select("post_id", enrich.issue_bucket(F.col("lo"), P).alias("b")).select("post_id", "b.category", "b.owner")


@query("churn_destinations", f"WITH {INSIGHTS} SELECT d AS destination, count(*) AS n FROM (SELECT unnest({sql_labels('churn_destinations', 'tlo')}) AS d FROM insights WHERE type_tag = 'Churn Signal') GROUP BY 1")
def _destinations(spark, sf):
    return enrich.churn_destinations(insights(spark, sf), F.lower("text"), P).groupBy("destination").agg(F.count(F.lit(1)).alias("n"))


@query("release_fields", f"WITH {POSTS} SELECT post_id, {sql_first('release_kinds', 'other', chr(108) + chr(50))} AS category, {sql_first('release_brands', 'Other', 'tl')} AS brand, {sql_first('release_sports', 'Trading Cards', 'tl')} AS sport FROM (SELECT *, lower(title) AS tl, lower(title || ' ' || text) AS l2 FROM posts)")
def _release(spark, sf):
    return enrich.release_fields(posts(spark, sf), P).select("post_id", "category", "brand", "sport")


@query("actionability", f"""WITH {INSIGHTS}, a AS (SELECT post_id, CASE WHEN is_urgent THEN 3 ELSE 0 END + CASE WHEN has_payment OR has_refund THEN 2 ELSE 0 END + CASE WHEN has_vault OR has_authenticity THEN 2 ELSE 0 END + CASE WHEN brand_sentiment = 'Negative' AND type_tag = 'Complaint' THEN 2 ELSE 0 END
+ CASE WHEN type_tag = 'Feature Request' THEN 1 ELSE 0 END + CASE WHEN has_high_value THEN 1 ELSE 0 END + CASE WHEN length(text) > 200 THEN 1 ELSE 0 END + CASE WHEN {sql_pack('leaving_words', 'tlo')} THEN 3 ELSE 0 END AS n FROM insights)
SELECT post_id, CASE WHEN n >= 5 THEN 'High' WHEN n >= 3 THEN 'Medium' ELSE 'Low' END AS level FROM a""")
def _action_level(spark, sf):
    c = F.col
    d = insights(spark, sf)
    return d.select("post_id", enrich.actionability(c("text"), F.lower("text"), P, c("is_urgent"), c("has_payment"), c("has_refund"), c("has_vault"), c("has_authenticity"), c("brand_sentiment"), c("type_tag"), c("has_high_value")).alias("level"))


@query("context_badges", f"""WITH {INSIGHTS}, c AS (SELECT *, {sql_labels('context_competitors', 'tlo')} AS cc FROM insights)
SELECT post_id, coalesce(CASE WHEN len(cc) > 0 THEN 'Mentions competitor (' || array_to_string(list_transform(cc, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ', ') || ') — potential competitive risk or win-back signal.' END, {sql_first('context_reasons', None, 'tlo')},
CASE WHEN brand_sentiment = 'Negative' AND topic IN ('Seller Experience', 'Buyer Experience') THEN topic || ' friction — negative experiences drive users to competing platforms.' END, '') AS reason,
array_to_string(list_filter([CASE WHEN has_payment THEN 'Payment' END, CASE WHEN has_shipping THEN 'Shipping' END, CASE WHEN has_vault THEN 'Vault' END, CASE WHEN is_urgent THEN 'Urgent' END], lambda x: x IS NOT NULL), ',') AS badges,
CASE WHEN has_vault THEN 'Vault' WHEN has_grading THEN 'Grading' WHEN has_shipping THEN 'Shipping' WHEN has_payment THEN 'Payments' ELSE 'General' END AS flag_category FROM c""")
def _context(spark, sf):
    return insights(spark, sf).select(
        "post_id", enrich.context_reason(F.lower("text"), F.col("brand_sentiment"), F.col("topic"), P).alias("reason"),
        F.array_join(enrich.signal_badges({"Payment": "has_payment", "Shipping": "has_shipping", "Vault": "has_vault", "Urgent": "is_urgent"}), ",").alias("badges"),
        enrich.flag_category({"Vault": "has_vault", "Grading": "has_grading", "Shipping": "has_shipping", "Payments": "has_payment"}).alias("flag_category"))


_INTENTS = P["question_intents"].rules


@query("question_flags", f"SELECT item_id, {', '.join(f'{sql_any(chr(108) + chr(111), r.substr)} AS q_{r.label}' for r in _INTENTS)} FROM (SELECT item_id, lower(text) AS lo FROM benchmark)")
def _question(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", *[c.alias(n) for n, c in enrich.question_flags(F.lower("text"), P).items()])


# Answers with planted citations: one marker per third word boundary of the turn.
def answers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.regexp_replace("text", r"\. ", F.lit(" [S3]. ")).alias("t0")).withColumn("response", F.regexp_replace("t0", r"\n", F.lit(' *"quoted"* [S12]\n'))).drop("t0")


ANSWERS = "answers AS (SELECT conv_id, turn, replace(replace(text, '. ', ' [S3]. '), chr(10), ' *\"quoted\"* [S12]' || chr(10)) AS response FROM conversations WHERE role = 'assistant')"
_CITES = "CAST((length(response) - length(replace(response, '[S', ''))) / 2 AS INTEGER)"


@query("response_quality", f"""WITH {ANSWERS}, a AS (SELECT *, length(response) AS n, {_CITES} AS c FROM answers)
SELECT conv_id, turn, round((CASE WHEN n BETWEEN 2000 AND 6000 THEN 20 WHEN n BETWEEN 1000 AND 1999 OR n BETWEEN 6001 AND 8000 THEN 10 ELSE 0 END + {' + '.join(f"CASE WHEN {sql_any('response', r.substr)} THEN {int(r.weight)} ELSE 0 END" for r in P['response_headings'].rules)}
+ CASE WHEN c BETWEEN 8 AND 20 THEN 20 WHEN c BETWEEN 4 AND 7 THEN 10 ELSE 0 END + CASE WHEN len(regexp_extract_all(response, '\\*"[^"]*"\\*\\s*\\[S\\d+\\]')) >= 3 THEN 5 ELSE 0 END + CASE WHEN NOT {sql_pack('refusal_phrases', 'response')} THEN 5 ELSE 0 END) / 100.0::DOUBLE, 6) AS quality FROM a""")
def _response(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", F.round(enrich.response_quality(F.col("response"), P), 6).alias("quality"))


@query("feedback_patterns")
def _feedback(spark, sf):
    a = answers(spark, sf).withColumn("pos", F.col("conv_id") * 100 + F.col("turn"))
    return enrich.feedback_patterns(a.where("conv_id % 2 = 0"), a.where("conv_id % 2 = 1"), P)


@query("health_band", "SELECT event_id, CASE WHEN value > 40 THEN 'red' WHEN value > 15 THEN 'yellow' ELSE 'green' END AS band, CASE WHEN value >= 50 THEN 'red' WHEN value >= 25 THEN 'yellow' ELSE 'green' END AS band2 FROM events")
def _health(spark, sf):
    return table(spark, sf, "events").select("event_id", aggregates.health_band(F.col("value"), 40, 15).alias("band"), aggregates.health_band(F.col("value"), 50, 25, True).alias("band2"))
