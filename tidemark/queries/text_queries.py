"""Scalar functions and the rule compiler (groups B and C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, hashing, rules, text
from tidemark.operators import enrich, filters
from tidemark.queries.base import (AS_OF, INSIGHTS, LOW, P, POSTS, as_of, insights, lowered, posts, q, query, sql_any, sql_best, sql_first, sql_labels, sql_labels_of, _CLOSE, _OPEN,
                                   sql_pack, sql_regex, sql_sum, table)

STOP = lambda words: "[" + ", ".join(q(w) for w in words) + "]"


def _tok_sql(col: str, pattern: str, stop, min_len: int) -> str:
    return f"list_filter(regexp_extract_all(lower({col}), {q(pattern)}), lambda x: length(x) > {min_len} AND NOT list_contains({STOP(stop)}, x))"


TOK_BM25 = _tok_sql("text", "[a-z0-9]+(?:'[a-z]+)?", text.STOP_RETRIEVAL, 1)
TOK_DEDUP = _tok_sql("text", "[a-z0-9]+", text.STOP_DEDUP, 2)
TOK_INFO = _tok_sql("text", "[a-z0-9]+", text.STOP_COHERENCE, 0)


@query("clean_text", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'http[s]?://\\S+', '', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned
FROM documents""")
def _clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("normalize_text")
def _normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


def _decode(col: str) -> str:
    for name, char in text.ENTITIES:
        col = f"replace({col}, {q(name)}, {q(char)})"
    return col


@query("strip_html", f"""SELECT page_id, trim(regexp_replace({_decode("regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS body
FROM pages""")
def _strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query("tokens_bm25", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOK_BM25} AS t FROM documents)")
def _tok_bm25(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.tokens_retrieval(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("tokens_dedup", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOK_DEDUP} AS t FROM documents)")
def _tok_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.tokens_dedup(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("tokens_informative", f"SELECT doc_id, CAST(len(list_distinct({TOK_INFO})) AS BIGINT) AS n FROM documents")
def _tok_info(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.tokens_informative(F.col("text"))).cast("bigint").alias("n"))


_SHINGLES = f"""SELECT doc_id, CASE WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END AS g
FROM (SELECT doc_id, array_to_string({TOK_DEDUP}, ' ') AS s FROM documents)"""


@query("char_shingles", f"SELECT doc_id, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(g, '|')) AS digest FROM ({_SHINGLES})")
def _shingles(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.tokens_dedup(F.col("text")).alias("t")).select("doc_id", text.char_shingles(F.col("t")).alias("g"))
    return d.select("doc_id", F.size("g").cast("bigint").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))


SIMHASH_SQL = f"""sh0 AS (SELECT doc_id, unnest(g) AS s FROM ({_SHINGLES})),
shc AS (SELECT doc_id, s, count(*) AS c FROM sh0 GROUP BY 1, 2),
shk AS (SELECT s, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM (SELECT DISTINCT s FROM shc)),
shv AS (SELECT doc_id, {', '.join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN c ELSE -c END) AS b{i}" for i in range(64))} FROM shc JOIN shk USING (s) GROUP BY 1),
shu AS (SELECT doc_id, {' + '.join(f"(CASE WHEN b{i} > 0 THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))} AS u FROM shv),
sim AS (SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS simhash, u AS uhash FROM shu)"""


@query("simhash64", f"WITH {SIMHASH_SQL} SELECT doc_id, simhash FROM sim")
def _simhash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.simhash64(F.col("text")).alias("simhash"))


@query("hamming64", "SELECT event_id, bit_count(xor(event_id * 2654435761, user_id * 40503)) AS distance FROM events")
def _hamming(spark, sf):
    return table(spark, sf, "events").select("event_id", hashing.hamming64(F.col("event_id") * 2654435761, F.col("user_id") * 40503).alias("distance"))


# Every layout of a day, and garbage, built from the event time.
@query("parse_date_multi", """SELECT event_id, CASE WHEN event_id % 7 = 5 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events""")
def _parse(spark, sf):
    e = table(spark, sf, "events")
    forms = [F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "MMM d, yyyy"), F.date_format("ts", "M/d/yyyy"),
             F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("soon"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS+02:00")]
    raw = forms[-1]
    for i, f in enumerate(forms[:-1]):
        raw = F.when(F.col("event_id") % 7 == i, f).otherwise(raw)
    return e.select("event_id", dates.parse_date_multi(raw).alias("day"))


@query("parse_feed_date", f"SELECT event_id, CASE WHEN event_id % 3 = 2 THEN DATE '{AS_OF}' ELSE CAST(ts AS DATE) END AS day FROM events")
def _feed_date(spark, sf):
    e = table(spark, sf, "events")
    raw = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
           .when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("today or so"))
    return e.select("event_id", dates.parse_feed_date(raw, as_of()).alias("day"))


@query("effective_date", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN CAST(ts AS DATE) WHEN event_id % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events")
def _effective(spark, sf):
    e, m = table(spark, sf, "events"), F.col("event_id") % 4
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select("event_id", dates.effective_date(F.when(m == 1, day).when(m == 2, "garbage"), F.when(m == 2, day), F.when(m == 3, F.date_format("ts", "M/d/yyyy"))).alias("day"))


@query("fingerprint", """SELECT doc_id, md5(lower(text)) AS fp, md5(text) AS cache_key, md5(trim(text)) AS trimmed FROM documents""")
def _fingerprint(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", hashing.fingerprint(t).alias("fp"), hashing.cache_key(t).alias("cache_key"), hashing.trimmed_md5(t).alias("trimmed"))


@query("taxonomy_of", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'tag' ELSE 'Unclassified' END AS type,
CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'General' END AS topic, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'General' END AS theme FROM events""")
def _taxonomy(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    none = F.lit(None).cast("string")
    t = enrich.taxonomy_of([F.when(i % 3 == 0, F.col("event_type")), F.when(i % 3 == 1, "tag")], [none, F.when(i % 2 == 0, F.col("event_type")).otherwise("  ")], [none])
    return e.select("event_id", t.alias("t")).select("event_id", "t.type", "t.topic", "t.theme")


@query("canonicalize_insight", f"""WITH {INSIGHTS} SELECT post_id, type_tag, topic AS subtag, topic AS theme, CASE WHEN has_payment THEN 'Yes' ELSE 'No' END AS has_payment_str,
'Unknown' AS carrier, {sql_pack('promotional', "lower(title || ' ' || text)")} AS is_promotional, CAST(post_date AS VARCHAR) AS day, 'Unknown' AS effort FROM insights""")
def _canonical(spark, sf):
    d = enrich.canonicalize_insight(insights(spark, sf).drop("logged_at"), P)
    return d.select("post_id", "type_tag", "subtag", "theme", "has_payment_str", "carrier", "is_promotional", F.col("last_seen").alias("day"), "effort")


@query("split_multi_value", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Unknown' WHEN event_id % 4 = 1 THEN event_type ELSE event_type || '|' || user_id END AS parts FROM events""")
def _split(spark, sf):
    e, m = table(spark, sf, "events"), F.col("event_id") % 4
    raw = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.concat(F.lit(" "), "event_type")).otherwise(F.concat("event_type", F.lit(" , "), F.col("user_id").cast("string"), F.lit(", ")))
    return e.select("event_id", F.array_join(text.split_multi_value(raw), "|").alias("parts"))


_KW = ["license", "thing", "the"]


def _snippet_sql() -> str:
    pos = "CASE " + " ".join(f"WHEN instr(lower(t), {q(k)}) > 0 THEN instr(lower(t), {q(k)})" for k in _KW) + " ELSE 0 END"
    return f"""WITH a AS (SELECT doc_id, trim(text) AS t FROM documents), b AS (SELECT *, {pos} AS p FROM a),
c AS (SELECT *, greatest(p - 1 - 90, 0) AS s, least(length(t), p - 1 + 130) AS e FROM b)
SELECT doc_id, CASE WHEN p = 0 THEN substr(t, 1, 220) ELSE substr(CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(t, s + 1, e - s)) || CASE WHEN e < length(t) THEN '…' ELSE '' END, 1, 220) END AS snippet FROM c"""


@query("keyword_snippet", _snippet_sql())
def _snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.keyword_snippet(F.col("text"), _KW).alias("snippet"))


@query("truncate_words", """WITH a AS (SELECT doc_id, replace(trim(text), chr(10), ' ') AS t, trim(text) AS raw FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(substr(t, 1, 217), ' [^ ]*$', '') || '...' END AS words,
CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 197) || '...' END AS chars,
upper(substr(raw, 1, 1)) || lower(substr(raw, 2, 59)) || CASE WHEN length(raw) > 60 THEN '...' ELSE '' END AS title FROM a""")
def _truncate(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.truncate_words(t).alias("words"), text.truncate_chars(t).alias("chars"), text.short_title(t).alias("title"))


@query("url_entity", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 's' || page_id WHEN 2 THEN 'e' || page_id END AS video,
CASE WHEN page_id % 5 = 3 THEN 'u' || page_id ELSE 'unknown' END AS handle FROM pages""")
def _urls(spark, sf):
    p, i = table(spark, sf, "pages"), F.col("page_id").cast("string")
    m = F.col("page_id") % 5
    url = (F.when(m == 0, F.concat(F.lit("https://www.youtube.com/watch?x=1&v=v"), i)).when(m == 1, F.concat(F.lit("https://youtu.be/s"), i))
           .when(m == 2, F.concat(F.lit("https://www.youtube.com/embed/e"), i, F.lit("?a=1"))).when(m == 3, F.concat(F.lit("https://x.com/u"), i, F.lit("/status/1"))).otherwise(F.col("url")))
    return p.select("page_id", text.video_id(url).alias("video"), text.url_handle(url).alias("handle"))


@query("normalize_feed_title", """SELECT doc_id, regexp_replace(lower(trim(substr(text, 1, 40))), '\\s+', ' ', 'g') AS title FROM documents""")
def _feed_title(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    head = F.substring("text", 1, 40)
    raw = F.when(i % 3 == 0, F.concat(F.lit("!12 "), F.trim(head))).when(i % 3 == 1, F.concat(F.lit("3x "), F.trim(head))).otherwise(head)
    return d.select("doc_id", text.feed_title(raw, F.col("text")).alias("title"))


@query("lead_sentence", """WITH a AS (SELECT doc_id, text, list_filter(list_transform(string_split(replace(text, chr(10), '. '), '.'), lambda s: trim(s)), lambda s: length(s) > 15) AS l FROM documents),
b AS (SELECT doc_id, coalesce(l[1], substr(text, 1, 150)) AS core FROM a)
SELECT doc_id, CASE WHEN length(core) > 120 THEN regexp_replace(substr(core, 1, 117), ' [^ ]*$', '') || '...' ELSE core END AS lead FROM b""")
def _lead(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.lead_sentence(F.col("text")).alias("lead"))


def _decay_sql() -> str:
    default = " ".join("WHEN " + " OR ".join([f"source IN ({', '.join(q(w) for w in r.word)})"] * bool(r.word) + [f"starts_with(source, {q(s)})" for s in r.substr]) + f" THEN {r.weight}"
                       for r in P["source_defaults"].rules)
    boosts = " + ".join(f"CASE WHEN {sql_any('lo', r.substr)} THEN {r.weight} ELSE 0 END" for r in P["news_boosts"].rules)
    return (f"WITH {LOW}, aged AS (SELECT *, greatest(date_diff('day', post_date, DATE '{AS_OF}'), 0) AS age FROM low) SELECT post_id, age AS age_days, "
            f"round((CASE WHEN score <= 0 THEN (CASE {default} ELSE 30.0 END) ELSE score::DOUBLE END + {boosts}) / (1 + age / 30.0::DOUBLE), 6) AS decayed FROM aged")


@query("time_decay_score", _decay_sql())
def _decay(spark, sf):
    d = lowered(spark, sf)
    s = enrich.time_decay_score(F.col("score"), F.col("source"), F.col("lo"), F.col("post_date"), as_of(), P)
    return d.select("post_id", dates.age_days(F.col("post_date"), as_of()).cast("bigint").alias("age_days"), F.round(s, 6).alias("decayed"))


@query("freshness_label", """WITH a AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(date_trunc('second', ts)) AS BIGINT) AS s0 FROM events), b AS (SELECT event_id, greatest(s0, 0) AS s FROM a)
SELECT event_id, CASE WHEN s < 3600 THEN greatest(1, CAST(round_even(s / 60.0, 0) AS INTEGER)) || 'm ago' WHEN s < 86400 THEN CAST(round_even(s / 3600.0, 0) AS INTEGER) || 'h ago' ELSE CAST(round_even(s / 86400.0, 0) AS INTEGER) || 'd ago' END AS label FROM b""")
def _fresh(spark, sf):
    e = table(spark, sf, "events")
    age = F.unix_timestamp(F.lit("2024-01-30 12:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "ts"))
    return e.select("event_id", text.freshness_label(age).alias("label"))


# --- rule modes ---------------------------------------------------------------------------------

@query("any_hit", f"WITH {LOW} SELECT post_id, {sql_pack('pain')} AS pain, {sql_pack('complaint_words')} AS complaint, {sql_pack('vault_terms')} AS pair FROM low")
def _any(spark, sf):
    lo = F.col("lo")
    return lowered(spark, sf).select("post_id", *[rules.any_hit(lo, P[k]).alias(a) for k, a in (("pain", "pain"), ("complaint_words", "complaint"), ("vault_terms", "pair"))])


@query("sum_hits", f"WITH {LOW} SELECT post_id, {sql_sum('negative_words')} AS n, CAST({sql_sum('heuristic_weights', weighted=True)} AS DOUBLE) AS weight FROM low")
def _sum(spark, sf):
    lo = F.col("lo")
    return lowered(spark, sf).select("post_id", rules.sum_hits(lo, P["negative_words"]).alias("n"), rules.sum_hits(lo, P["heuristic_weights"], weighted=True).alias("weight"))


@query("first_label", f"WITH {LOW} SELECT post_id, {sql_first('opportunities', 'General Insight')} AS opportunity, {sql_first('brand_cascade', 'Other')} AS brand FROM low")
def _first(spark, sf):
    lo = F.col("lo")
    return lowered(spark, sf).select("post_id", rules.first_label(lo, P["opportunities"], "General Insight").alias("opportunity"), rules.first_label(lo, P["brand_cascade"], "Other").alias("brand"))


@query("all_labels", f"WITH {LOW} SELECT post_id, array_to_string({sql_labels('topic_focus')}, ',') AS topics, array_to_string(list_sort({sql_labels('competitors')}), ',') AS competitors FROM low")
def _all(spark, sf):
    lo = F.col("lo")
    return lowered(spark, sf).select("post_id", F.array_join(rules.all_labels(lo, P["topic_focus"]), ",").alias("topics"), F.array_join(rules.all_labels(lo, P["competitors"], sort=True), ",").alias("competitors"))


@query("best_label", f"WITH {LOW} SELECT post_id, {sql_best('adhoc_topics', 'General')} AS topic, {sql_best('adhoc_personas', 'Unknown')} AS persona FROM low")
def _best(spark, sf):
    lo = F.col("lo")
    return lowered(spark, sf).select("post_id", rules.best_label(lo, P["adhoc_topics"], "General").alias("topic"), rules.best_label(lo, P["adhoc_personas"], "Unknown").alias("persona"))


@query("explode_hits", "SELECT d.doc_id, t.term, 1 AS hit FROM documents d JOIN (SELECT unnest(['thing','thble','best','great','license','roi','ach']) AS term) t ON contains(lower(d.text), t.term)")
def _explode(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return rules.explode_hits(d, "text", ["thing", "thble", "best", "great", "license", "roi", "ach"]).select("doc_id", "term", F.lit(1).alias("hit"))


@query("lexicon_join", """WITH lex AS (SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark))
SELECT l.page_id, count(*) AS n FROM (SELECT page_id, lower(url) AS u FROM pages) l JOIN lex ON contains(l.u, lex.term) GROUP BY 1""")
def _lexicon(spark, sf):
    """A lexicon that grows with the data: the words of the benchmark table, matched inside page addresses."""
    words = table(spark, sf, "benchmark").select(F.explode(text.raw_tokens(F.col("text"), "a-z")).alias("term")).distinct()
    return rules.explode_hits(table(spark, sf, "pages").select("page_id", "url"), "url", words).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


_M = rules.load_packs("marketplace")
_FLOW = _M["signal_flags"].rules[0]


@query("default_flags", f"""WITH {LOW} SELECT post_id, ({sql_regex(_FLOW.regex[0])} OR {sql_regex(_FLOW.regex[1])}) AND NOT {sql_any('lo', _FLOW.none_of)} AS has_payment,
{sql_regex(_M['pain'].rules[0].regex[0])} AS pain FROM low""")
def _default_flags(spark, sf):
    """The shipped vocabulary on the test prose."""
    m = rules.load_packs("marketplace")
    flags = rules.flag_columns(F.col("lo"), m["signal_flags"])
    return lowered(spark, sf).select("post_id", flags["has_payment"].alias("has_payment"), rules.any_hit(F.col("lo"), m["pain"]).alias("pain"))


# --- the shipped vocabulary ------------------------------------------------------------------------

#: Packs whose rules look at the text alone, in groups: each is a query of its own.
_SHIPPED = {k: p for k, p in sorted(_M.items()) if p.rules and not any(r.flags or r.topics or r.all_flags or r.none_flags for r in p.rules)}
_TERMS = sorted({t for p in _SHIPPED.values() for r in p.rules for group in (r.substr, r.word, *r.all_of) for t in group})
_LANES = 200
#: Every term stands in one of the lanes, so every term is met by some row.
_LANE = [" | ".join(_TERMS[k::_LANES]) for k in range(_LANES)]
_SPOKEN = f"spoken AS (SELECT event_id, lower(event_type || ' ' || coalesce(props, '') || ' ' || [{', '.join(q(t) for t in _LANE)}][CAST(event_id % {_LANES} AS INTEGER) + 1]) AS lo FROM events)"


def _spoken(spark, sf):
    """Events that say the terms of the shipped packs, a few each."""
    lane = F.element_at(F.array(*map(F.lit, _LANE)), (F.col("event_id") % _LANES).cast("int") + 1)
    return table(spark, sf, "events").select("event_id", F.lower(F.concat_ws(" ", "event_type", "props", lane)).alias("lo"))


def _shipped(group: int, names: list[str]) -> None:
    labels = ", ".join(f"array_to_string({sql_labels_of(_SHIPPED[n])}, ',') AS {n}" for n in names)
    # the rows are ASCII, so plain word boundaries say it, also next to terms that end in a blank
    labels = labels.replace(_OPEN, r"\b").replace(_CLOSE, r"\b")

    @query(f"shipped_packs_{group}", f"WITH {_SPOKEN} SELECT event_id, {labels} FROM spoken")
    def _run(spark, sf):
        return _spoken(spark, sf).select("event_id", *(F.array_join(rules.all_labels(F.col("lo"), _SHIPPED[n]), ",").alias(n) for n in names))


for _i in range(0, len(_SHIPPED), 16):
    _shipped(_i // 16, list(_SHIPPED)[_i : _i + 16])


# --- row filters -----------------------------------------------------------------------------------

_VERT = "len(list_filter(string_split(text, chr(10)), lambda s: length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) = 1)) >= 5"
_IN = lambda name: ", ".join(q(t) for r in P[name].rules for t in r.substr)


def _relevant_sql(text_col: str = "text") -> str:
    rej = " OR ".join([f"subreddit IN ({_IN('noise_subreddits')})", *[sql_pack(k) for k in ("sales_phrases", "bot_phrases", "listing_phrases", "off_category")],
                       _VERT.replace("text", text_col), f"{sql_sum('noise_phrases')} >= 2"])
    pain, plat = sql_pack("pain"), f"({sql_pack('platform_terms')} OR {sql_pack('vault_terms')})"
    acc = f"(subreddit IN ({_IN('platform_subreddits')}) AND {pain}) OR {sql_pack('partner_terms')} OR ({sql_pack('ecosystem_terms')} AND ({pain} OR {plat})) OR ({pain} AND {plat})"
    return f"(NOT ({rej}) AND ({acc}))"


@query("is_relevant", f"WITH {LOW} SELECT post_id FROM low WHERE {_relevant_sql()}")
def _relevant(spark, sf):
    return lowered(spark, sf).where(filters.is_relevant(F.col("text"), F.col("lo"), F.col("subreddit"), P)).select("post_id")


_CURATED = f"(length(lo) >= 30 AND NOT {sql_pack('curated_bot')} AND NOT {sql_pack('curated_sales')} AND NOT {sql_pack('curated_off_category')})"
_INTEL = f"(length(lo) >= 40 AND {sql_pack('intel_entities')} AND ({sql_pack('domain_regex')} OR {sql_pack('platform_context')}))"


@query("is_relevant_curated", f"WITH {LOW} SELECT post_id FROM low WHERE {_CURATED}")
def _curated(spark, sf):
    return lowered(spark, sf).where(filters.is_relevant_curated(F.col("lo"), P)).select("post_id")


@query("is_competitor_intel", f"WITH {LOW} SELECT post_id FROM low WHERE {_INTEL}")
def _intel(spark, sf):
    return lowered(spark, sf).where(filters.is_competitor_intel(F.col("lo"), P)).select("post_id")


_QUALITY = (f"(length(text) >= 50 AND NOT {sql_pack('comment_promo', 'tlo')} AND ((like_count >= 5 AND {sql_sum('comment_keywords', 'tlo')} >= 1) OR "
            f"({sql_sum('comment_keywords', 'tlo')} >= 2 AND length(text) >= 80) OR like_count >= 15))")


@query("is_quality_comment", f"WITH {POSTS}, t AS (SELECT *, lower(text) AS tlo FROM posts) SELECT post_id FROM t WHERE {_QUALITY}")
def _quality(spark, sf):
    return lowered(spark, sf).where(filters.is_quality_comment(F.col("text"), F.col("lo"), F.col("like_count"), P)).select("post_id")


ROUTE_SQL = f"""routed AS (SELECT *, CASE WHEN source = 'src0' AND {_QUALITY} THEN 'quality_comment' WHEN source IN ({_IN('curated_sources')}) AND {_CURATED} THEN 'curated'
WHEN {_INTEL} THEN 'competitor_intel' WHEN {_relevant_sql('full_text')} THEN 'relevant' END AS route
FROM (SELECT *, title || ' ' || text AS full_text, lower(title || ' ' || text) AS lo, lower(text) AS tlo FROM posts))"""


@query("route_relevant", f"WITH {POSTS}, {ROUTE_SQL} SELECT post_id, route FROM routed WHERE route IS NOT NULL")
def _route(spark, sf):
    return filters.route_relevant(posts(spark, sf), P, "src0").select("post_id", "route")


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(text, 'http[s]?://\\S+', '', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("screen_with_reason", f"""WITH c AS (SELECT doc_id, {_CLEAN} AS cl FROM documents), d AS (SELECT doc_id, cl, lower(cl) AS lo FROM c)
SELECT doc_id, CASE WHEN length(cl) < 40 THEN 'too_short' WHEN {sql_pack('screen_noise')} THEN 'noise_phrase' WHEN {sql_pack('screen_keywords')} THEN 'keyword_match' ELSE 'no_keyword' END AS reason FROM d""")
def _screen(spark, sf):
    return table(spark, sf, "documents").select("doc_id", filters.screen_reason(F.col("text"), P).alias("reason"))


@query("high_signal_or_score", f"WITH {LOW} SELECT post_id FROM low WHERE score >= 200 OR {sql_pack('signal_keywords')}")
def _high(spark, sf):
    return lowered(spark, sf).where(filters.high_signal_or_score(F.col("lo"), F.col("score"), P, 200)).select("post_id")


_DOMAIN = f"CASE WHEN {sql_any('source', [t for r in P['trusted_sources'].rules for t in r.substr])} THEN NOT {sql_pack('off_topic')} OR {sql_pack('strong_terms')} ELSE {sql_pack('domain_terms')} AND NOT {sql_pack('off_topic')} END"


@query("domain_relevant", f"WITH {LOW} SELECT post_id FROM low WHERE {_DOMAIN}")
def _domain(spark, sf):
    return lowered(spark, sf).where(filters.domain_relevant(F.col("lo"), F.col("source"), P)).select("post_id")


@query("domain_gate", f"""WITH {LOW} SELECT post_id, NOT {sql_pack('gate_exclude')} AND ({sql_pack('strong_hints')} OR (score > 200) OR ({sql_pack('weak_hints')} AND NOT {sql_pack('false_compounds')} AND {sql_pack('gate_context')})) AS keep,
{sql_pack('simple_hints')} OR (score > 200) AS keep_simple FROM low""")
def _gate(spark, sf):
    lo, money = F.col("lo"), F.col("score") > 200
    return lowered(spark, sf).select("post_id", filters.domain_gate(lo, money, P).alias("keep"), filters.simple_gate(lo, money, P).alias("keep_simple"))


@query("param_filters", f"""WITH {INSIGHTS} SELECT post_id FROM insights WHERE lower(target_brand) = 'alpha' AND lower(persona) = 'power seller' AND post_date >= DATE '2024-01-10' AND score >= 20 ORDER BY pos LIMIT 100""")
def _params(spark, sf):
    return filters.param_filters(insights(spark, sf), brand="ALPHA", persona="Power Seller", since="2024-01-10", min_score=20, max_items=100).select("post_id")


@query("multiselect_filter", f"WITH {INSIGHTS} SELECT post_id FROM insights WHERE topic IN ('Things', 'Fees') AND brand_sentiment = 'Negative'")
def _multi(spark, sf):
    return filters.multiselect(insights(spark, sf), {"topic": ["Things", "Fees"], "brand_sentiment": ["Negative"], "persona": ["All"], "clarity": []}).select("post_id")


@query("search_filter", f"WITH {INSIGHTS} SELECT post_id, score FROM insights WHERE contains(tlo, 'thing') AND topic IN ('Things', 'Trust', 'Payments') AND brand_sentiment = 'Positive' ORDER BY score DESC, pos LIMIT 100")
def _search(spark, sf):
    return filters.search_filter(insights(spark, sf), "Thing", tags=["Things", "Trust", "Payments"], sentiments=["Positive"]).select("post_id", "score")


@query("time_range_filter", f"WITH {POSTS} SELECT post_id FROM posts WHERE post_date >= DATE '{AS_OF}' - INTERVAL 30 DAY")
def _range(spark, sf):
    return filters.time_range(posts(spark, sf), "Last 30 Days", as_of()).select("post_id")


@query("is_promotional", f"WITH {LOW} SELECT post_id FROM low WHERE {sql_pack('promotional')}")
def _promo(spark, sf):
    return lowered(spark, sf).where(filters.is_promotional(F.col("lo"), P)).select("post_id")


@query("is_feed_spam", f"""WITH {LOW}, f AS (SELECT *, CASE WHEN post_id % 2 = 0 THEN 'YouTube' ELSE 'News' END AS src, CASE WHEN post_id % 6 = 0 THEN '!7 show' ELSE title END AS ttl, lo || CASE WHEN post_id % 4 IN (1, 2) THEN ' break w/ checklist' ELSE '' END AS l2 FROM low)
SELECT post_id FROM f WHERE (src = 'YouTube' AND (regexp_matches(lower(trim(ttl)), '^!\\d+\\b') OR (contains(l2, 'break w/') AND {sql_pack('break_ads', 'l2')}))) OR (src = 'News' AND contains(l2, 'checklist') AND {sql_pack('checklist_phrases', 'l2')})""")
def _spam(spark, sf):
    i = F.col("post_id")
    d = lowered(spark, sf).withColumns({"src": F.when(i % 2 == 0, "YouTube").otherwise("News"), "ttl": F.when(i % 6 == 0, "!7 show").otherwise(F.col("title")),
                                        "l2": F.concat("lo", F.when((i % 4).isin(1, 2), " break w/ checklist").otherwise(""))})
    return d.where(filters.is_feed_spam(F.col("src"), F.col("ttl"), F.col("l2"), P)).select("post_id")


ACTIONABLE = (f"((type_tag IN ('Complaint', 'Bug Report') OR brand_sentiment = 'Negative') AND subreddit NOT IN ({_IN('issue_exclude_subs')}) AND NOT {sql_pack('issue_exclude', 'tlo')} AND NOT {sql_pack('issue_positive', 'tlo')} "
              f"AND ({sql_pack('issue_platforms', 'tlo')} OR subreddit IN ({_IN('issue_subs')}) OR {sql_pack('issue_features', 'tlo')}))")


@query("issue_actionable", f"WITH {INSIGHTS} SELECT post_id FROM insights WHERE {ACTIONABLE}")
def _actionable(spark, sf):
    d = insights(spark, sf).withColumn("lo", F.lower("text"))
    return d.where(filters.issue_actionable(F.col("lo"), F.col("subreddit"), F.col("type_tag"), F.col("brand_sentiment"), P)).select("post_id")


PRODUCT = f"(NOT {sql_pack('product_exclude')} AND ({sql_pack('product_exact')} OR ({sql_pack('product_context')} AND {sql_pack('product_terms')})))"


@query("strict_product_signal", f"WITH {LOW} SELECT post_id FROM low WHERE {PRODUCT}")
def _product(spark, sf):
    return lowered(spark, sf).where(filters.strict_product_signal(F.col("lo"), P)).select("post_id")


@query("context_gate", f"WITH {LOW} SELECT post_id FROM low WHERE {sql_pack('context_terms')} AND NOT {sql_pack('context_exclude')} AND CASE source WHEN 'src1' THEN contains(lo, 'thing') OR contains(lo, 'que ') WHEN 'src2' THEN contains(lo, 'thnd') ELSE TRUE END")
def _context(spark, sf):
    need = rules.Pack.of("need", [{"label": "src1", "substr": ["Thing", "que "]}, {"label": "src2", "substr": ["thnd"]}])
    return filters.context_gate(posts(spark, sf), P, need, entity="source", lo=F.lower("text")).select("post_id")


@query("request_posts", f"WITH {INSIGHTS} SELECT post_id FROM insights WHERE type_tag = 'Feature Request' OR {sql_pack('request_hints', 'tlo')}")
def _requests(spark, sf):
    return insights(spark, sf).where(filters.is_request(F.lower("text"), F.col("type_tag"), P)).select("post_id")


@query("viral_posts", f"""WITH {LOW}, feed AS (SELECT DISTINCT url FROM posts WHERE source = 'src9'),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn FROM (SELECT * FROM low WHERE ((source = 'src3' AND score >= 100) OR (source IN ('src4', 'src5') AND score >= 20))
 AND (source <> 'src3' OR subreddit NOT IN ({_IN('industry_exclude_subs')})) AND NOT {sql_pack('industry_exclude')} AND {sql_pack('industry_terms')} AND url NOT IN (SELECT url FROM feed)))
SELECT post_id, url FROM k WHERE rn = 1""")
def _viral(spark, sf):
    p = posts(spark, sf)
    return filters.viral_posts(p, p.where("source = 'src9'"), P, {"src3": 100, "src4": 20, "src5": 20}, ["src3"], title="subreddit").select("post_id", "url")


@query("min_length_score", f"WITH {POSTS} SELECT post_id FROM posts WHERE length(trim(text)) >= 300 AND score >= 3")
def _min(spark, sf):
    return filters.min_score(filters.min_length(posts(spark, sf), 300), 3).select("post_id")
