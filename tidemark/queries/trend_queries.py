"""Trends, run-over-run changes, evaluation, streaming and sources (groups K, L, ST and A)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidemark.functions.rules import Pack, all_labels
from tidemark.operators import aggregates as agg, evaluation as ev, trends as tr
from tidemark.queries.base import AS_OF, INSIGHTS, P, POSTS, as_of, insights, posts, q, query, sql_any, sql_labels, table
from tidemark.queries.label_queries import ANSWERS, answers
from tidemark.queries.table_queries import ENTITIES, SIGNALS, SNAPSHOT
from tidemark.session import scratch_path
from tidemark.sources import readers, sinks
from tidemark.streaming import incremental as st, keyed
from tidemark.streaming.upsert import BucketTable, into

R6 = lambda c: F.round(c, 6)
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def dated(spark, sf):
    return dated_rows(table(spark, sf, "events"))


def dated_rows(e):
    """Events as dated rows: a fine topic whose volume moves over time, negative when large."""
    k = F.get_json_object("props", "$.k").cast("int")
    late = F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz")
    newest = F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")
    topic = (F.when(newest & (k % 11 == 3), "New").when(~late & (k % 11 == 4), "Gone").when(late & (k % 5 == 0), "Rising")
             .when(F.col("event_type") == "view", "General").otherwise(F.concat(F.lit("t"), (k % 13).cast("string"))))
    return e.select("event_id", F.col("ts").cast("date").alias("day"), topic.alias("topic"), ((F.col("event_type") == "error") | (late & (k % 3 == 0))).alias("negative"), "ts", "value", "event_type")


DATED = f"""dt AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN ts >= TIMESTAMP '2024-01-29' AND k % 11 = 3 THEN 'New' WHEN NOT late AND k % 11 = 4 THEN 'Gone' WHEN late AND k % 5 = 0 THEN 'Rising' WHEN event_type = 'view' THEN 'General' ELSE 't' || (k % 13) END AS topic,
event_type = 'error' OR (late AND k % 3 = 0) AS negative FROM (SELECT *, {_K} AS k, ts >= TIMESTAMP '2024-01-22' AS late FROM events))"""
PERIODS = f"{DATED}, pc AS (SELECT topic, CAST(floor(date_diff('day', (SELECT min(day) FROM dt), day) / 7.0) AS INTEGER) AS p, count(*) AS n, count(*) FILTER (WHERE negative) AS neg FROM dt GROUP BY 1, 2)"
# The oracle builds the full topic x period spine the reference semantics describe.
STATS = f"""{PERIODS}, mx AS (SELECT max(p) AS last FROM pc), fs AS (SELECT topic, min(p) AS f FROM pc, mx WHERE p < last GROUP BY 1),
sp AS (SELECT fs.topic, g.p, coalesce(pc.n, 0) AS n, coalesce(pc.neg, 0) AS neg FROM fs, mx, (SELECT unnest(range(0, 20)) AS p) g LEFT JOIN pc ON pc.topic = fs.topic AND pc.p = g.p WHERE g.p >= fs.f AND g.p < mx.last),
hs AS (SELECT topic, count(*) AS history, avg(n) AS mean_n, CASE WHEN min(n) = max(n) THEN 0 ELSE stddev_pop(n) END AS std_n, avg(CASE WHEN n > 0 THEN neg / n::DOUBLE ELSE 0 END) AS base_neg, count(*) FILTER (WHERE n > 0) AS seen, sum(n) / any_value(last)::DOUBLE AS mean_all FROM sp, mx GROUP BY 1),
ct AS (SELECT topic, n, neg FROM pc, mx WHERE p = last), al AS (SELECT coalesce(hs.topic, ct.topic) AS topic, coalesce(history, 0) AS history, mean_n, std_n, base_neg, coalesce(seen, 0) AS seen, mean_all, coalesce(n, 0) AS n, coalesce(neg, 0) AS neg FROM hs FULL JOIN ct ON ct.topic = hs.topic),
z AS (SELECT *, CASE WHEN history = 0 THEN NULL WHEN std_n > 0 THEN (n - mean_n) / std_n WHEN n = mean_n THEN 0 WHEN n > mean_n THEN 5 ELSE -5 END AS z FROM al)"""


def periods(spark, sf):
    return tr.period_counts(dated(spark, sf), "topic", "day", F.col("negative"))


@query("bucket_periods", f"WITH {PERIODS} SELECT topic, p AS period_idx, n, neg, strftime(CAST((SELECT min(day) FROM dt) + CAST(p * 7 AS INTEGER) AS DATE), '%Y-%m-%d') || '_' || strftime(CAST((SELECT min(day) FROM dt) + CAST(p * 7 + 6 AS INTEGER) AS DATE), '%Y-%m-%d') AS period FROM pc")
def _bucket(spark, sf):
    return tr.bucket_periods(dated(spark, sf), "topic", "day", F.col("negative"))


@query("period_spine", "SELECT CAST(i AS INTEGER) AS period_idx, CAST(a + CAST(i * 7 AS INTEGER) AS DATE) AS start_day, CAST(a + CAST(i * 7 + 6 AS INTEGER) AS DATE) AS end_day FROM (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), (SELECT unnest(range(0, 100)) AS i) WHERE a + CAST(i * 7 AS INTEGER) <= b")
def _spine(spark, sf):
    return tr.period_spine(dated(spark, sf), "day")


@query("topic_baseline", f"WITH {STATS} SELECT topic, history, seen AS periods_seen, n AS current_n, round(mean_n, 6) AS mean_n, round(std_n, 6) AS std_n, round(base_neg, 6) AS baseline_neg, round(z, 5) AS z FROM z")
def _baseline(spark, sf):
    return tr.topic_baseline(periods(spark, sf)).select("topic", "history", "periods_seen", "current_n", R6(F.col("mean_n")).alias("mean_n"), R6(F.col("std_n")).alias("std_n"), R6(F.col("baseline_neg")).alias("baseline_neg"), F.round("z", 5).alias("z"))


_SKIP = "topic NOT IN ('General', 'Unknown', '')"
_VOLUME = f"""SELECT 'volume_spike' AS alert_type, topic, CASE WHEN z >= 3 THEN 'high' ELSE 'medium' END AS severity, n::DOUBLE AS current_value, mean_n AS baseline_value, least(1, 1 - 1 / (1 + abs(z))) AS confidence FROM z WHERE {_SKIP} AND history >= 2 AND z >= 2 AND n > 0
UNION ALL SELECT 'declining', topic, 'medium', n, mean_n, least(1, 1 - 1 / (1 + abs(z))) FROM z WHERE {_SKIP} AND history >= 2 AND z <= -2 AND mean_n > 2"""
_SHIFT = f"""SELECT 'sentiment_shift' AS alert_type, topic, CASE WHEN abs(neg / n::DOUBLE - base_neg) >= 0.25 THEN 'high' ELSE 'medium' END AS severity, neg / n::DOUBLE AS current_value, base_neg AS baseline_value, CASE WHEN n >= 5 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM z WHERE {_SKIP} AND history >= 2 AND n >= 3 AND abs(neg / n::DOUBLE - base_neg) >= 0.15"""
_EMERGE = f"""SELECT 'emerging' AS alert_type, topic, 'medium' AS severity, n::DOUBLE AS current_value, 0::DOUBLE AS baseline_value, CASE WHEN n >= 5 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM z WHERE {_SKIP} AND n >= 3 AND seen = 0"""
_ALERT = lambda inner: f"WITH {STATS} SELECT alert_type, topic, severity, round(current_value, 6) AS current_value, round(baseline_value, 6) AS baseline_value, round(confidence, 6) AS confidence FROM ({inner})"


def _alert_cols(df):
    return df.select("alert_type", "topic", "severity", *[R6(F.col(c)).alias(c) for c in ("current_value", "baseline_value", "confidence")])


def _stats(spark, sf):
    return tr.topic_baseline(periods(spark, sf)).where(~F.col("topic").isin(*tr.SKIP_TOPICS))


@query("volume_spike", _ALERT(_VOLUME))
def _spike(spark, sf):
    return _alert_cols(tr.volume_alerts(_stats(spark, sf)))


@query("sentiment_shift", _ALERT(_SHIFT))
def _shift(spark, sf):
    return _alert_cols(tr.sentiment_alerts(_stats(spark, sf)))


@query("emerging_topics", _ALERT(_EMERGE))
def _emerging(spark, sf):
    return _alert_cols(tr.emerging_alerts(_stats(spark, sf)))


@query("detect_trends", _ALERT(f"{_VOLUME} UNION ALL {_SHIFT} UNION ALL {_EMERGE}"))
def _trends(spark, sf):
    return _alert_cols(tr.severity_order(tr.detect_trends(periods(spark, sf))))


@query("silent_topics", f"WITH {STATS} SELECT topic, round(mean_all, 6) AS baseline_avg, seen AS periods_with_signal, (SELECT last FROM mx) AS total_baseline_periods FROM z WHERE {_SKIP} AND mean_all >= 3 AND n = 0")
def _silent(spark, sf):
    return tr.silent_topics(periods(spark, sf)).select("topic", R6(F.col("baseline_avg")).alias("baseline_avg"), "periods_with_signal", "total_baseline_periods")


@query("spike_ratio", f"WITH {DATED}, c AS (SELECT topic, count(*) FILTER (WHERE day >= DATE '2024-01-23') AS recent, count(*) FILTER (WHERE day < DATE '2024-01-23') AS prior FROM dt GROUP BY 1) SELECT topic, recent, prior, round(recent / (prior + 1)::DOUBLE, 6) AS ratio FROM c WHERE recent > 0 AND prior > 0 AND recent / (prior + 1)::DOUBLE > 0.4")
def _ratio(spark, sf):
    return tr.spike_ratio(dated(spark, sf), "topic", "day", F.lit("2024-01-30").cast("date"), 7, 0.4).withColumn("ratio", R6(F.col("ratio")))


_ROLL = """dy AS (SELECT user_id % 9 AS brand, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY 1, 2),
rl AS (SELECT brand, day, CASE WHEN count(*) OVER w = 3 THEN avg(p) OVER w END AS praise_3, CASE WHEN count(*) OVER w = 3 THEN avg(c) OVER w END AS complaint_3 FROM dy WINDOW w AS (PARTITION BY brand ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


def _brands(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 9).alias("brand"), F.col("ts").cast("date").alias("day"), "event_type")


@query("rolling_mean_3", f"WITH {_ROLL} SELECT brand, day, round(praise_3, 6) AS praise_3, round(complaint_3, 6) AS complaint_3 FROM rl")
def _rolling(spark, sf):
    r = tr.rolling_sentiment(_brands(spark, sf), "brand", "day", "event_type", "purchase", "error")
    return r.select("brand", "day", R6(F.col("praise_3")).alias("praise_3"), R6(F.col("complaint_3")).alias("complaint_3"))


@query("sentiment_flip", f"WITH {_ROLL}, l AS (SELECT brand, arg_max(praise_3, day) AS p, arg_max(complaint_3, day) AS c FROM rl GROUP BY 1) SELECT brand, round(p, 6) AS praise_3, round(c, 6) AS complaint_3 FROM l WHERE p < c")
def _flip(spark, sf):
    f = tr.sentiment_flips(_brands(spark, sf), "brand", "day", "event_type", "purchase", "error")
    return f.select("brand", R6(F.col("praise_3")).alias("praise_3"), R6(F.col("complaint_3")).alias("complaint_3"))


_TWO = (f"{INSIGHTS}, cu AS (SELECT * FROM ({SNAPSHOT.replace('FROM base', 'FROM insights')})), pr AS (SELECT * FROM ({SNAPSHOT.replace('FROM base', 'FROM old')}) WHERE metric_group <> 'topic' OR metric <> 'Things')").replace(
    ", cu AS", ", old AS (SELECT * FROM insights WHERE pos % 3 <> 0), cu AS", 1)
_CMP = "cmp AS (SELECT coalesce(cu.metric_group, pr.metric_group) AS metric_group, coalesce(cu.metric, pr.metric) AS metric, cu.value AS cur, pr.value AS prev, coalesce(cu.value, 0) - coalesce(pr.value, 0) AS delta FROM cu FULL JOIN pr ON cu.metric_group = pr.metric_group AND cu.metric = pr.metric)"


def _snapshots(spark, sf):
    i = insights(spark, sf)
    cur, old = agg.run_snapshot(i, SIGNALS, ENTITIES), agg.run_snapshot(i.where("pos % 3 <> 0"), SIGNALS, ENTITIES)
    return cur, old.where("metric_group <> 'topic' or metric <> 'Things'")


@query("snapshot_compare", f"WITH {_TWO}, {_CMP} SELECT metric_group, metric, round(cur, 6) AS current, round(prev, 6) AS prev, round(delta, 6) AS delta FROM cmp")
def _compare(spark, sf):
    c = tr.snapshot_compare(*_snapshots(spark, sf))
    return c.select("metric_group", "metric", *[R6(F.col(x)).alias(x) for x in ("current", "prev", "delta")])


@query("run_deltas", f"""WITH {_TWO}, {_CMP}, p AS (SELECT *, CAST(round_even(delta * 100.0 / nullif(prev, 0), 0) AS INTEGER) AS pct FROM cmp),
s AS (SELECT *, CASE WHEN metric_group = 'total' AND prev > 0 AND abs(delta) > 10 THEN 'info' WHEN metric_group = 'signal' AND prev > 0 AND abs(delta) >= 3 AND abs(pct) >= 15 THEN CASE WHEN abs(pct) >= 30 THEN 'high' ELSE 'medium' END
WHEN metric_group = 'churn' AND prev > 0 AND abs(delta) >= 2 THEN CASE WHEN delta > 0 THEN 'high' ELSE 'low' END WHEN metric_group = 'entity' AND prev > 0 AND abs(delta) >= 3 AND abs(pct) >= 20 THEN 'medium' WHEN metric_group = 'topic' AND prev IS NULL AND cur >= 3 THEN 'medium' END AS severity FROM p)
SELECT metric_group, metric, coalesce(prev, 0) AS prev, coalesce(cur, 0) AS current, delta, CASE WHEN metric_group IN ('signal', 'entity') THEN pct END AS pct_change, CASE WHEN metric_group = 'topic' THEN 'new' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction, severity FROM s WHERE severity IS NOT NULL""")
def _deltas(spark, sf):
    return tr.run_deltas(*_snapshots(spark, sf))


@query("relevant_alerts", f"""WITH {STATS}, a AS ({_VOLUME} UNION ALL {_SHIFT} UNION ALL {_EMERGE}), b AS (SELECT *, contains(lower(topic), 'rising') AS m FROM a WHERE baseline_value >= 0.1 AND (contains(lower(topic), 'rising') OR severity = 'high')),
r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, confidence DESC, topic, alert_type) AS i FROM b)
SELECT alert_type, topic, severity FROM r WHERE (m AND i <= 3) OR (NOT m AND i <= 4) ORDER BY m DESC, i LIMIT 4""")
def _relevant(spark, sf):
    return tr.relevant_alerts(tr.detect_trends(periods(spark, sf)), ["what", "is", "Rising"], 0.1).select("alert_type", "topic", "severity")


@query("relevant_absences", f"WITH {STATS} SELECT topic FROM z WHERE {_SKIP} AND mean_all >= 3 AND n = 0 AND contains(lower(topic), 'gone') ORDER BY topic LIMIT 2")
def _absences(spark, sf):
    return tr.relevant_absences(tr.silent_topics(periods(spark, sf)), ["gone", "the"]).select("topic")


_ASKED = "qs AS (SELECT event_id AS query_id, lower('What about ' || topic || ' and ' || 'Gone'[1:event_id % 5]) AS query FROM dt), qw AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(string_split_regex(query, '\\s+')) AS w FROM qs) WHERE length(w) > 3)"


def _asked(spark, sf):
    """A question per event, naming its topic, some of them a second one."""
    tail = F.expr("substring('Gone', 1, CAST(event_id % 5 AS INT))")
    return dated(spark, sf).select(F.col("event_id").alias("query_id"), F.lower(F.concat(F.lit("What about "), "topic", F.lit(" and "), tail)).alias("query"))


@query("alerts_for", f"""WITH {STATS}, {_ASKED}, a AS ({_VOLUME} UNION ALL {_SHIFT} UNION ALL {_EMERGE}), b AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, confidence DESC, topic, alert_type) AS g FROM a WHERE baseline_value >= 0.1),
mt AS (SELECT DISTINCT query_id, topic FROM (SELECT DISTINCT topic FROM b) JOIN qw ON contains(lower(topic), w)), c AS (SELECT qs.query_id, b.*, mt.topic IS NOT NULL AS m FROM qs JOIN b ON TRUE LEFT JOIN mt ON mt.query_id = qs.query_id AND mt.topic = b.topic WHERE mt.topic IS NOT NULL OR severity = 'high'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, m ORDER BY g) AS i FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, i) AS position FROM r WHERE NOT m OR i <= 3)
SELECT query_id, position, m AS matched, alert_type, topic, severity FROM p WHERE position <= 4""")
def _alerts_for(spark, sf):
    """Alerts for every question of a table, probed through the words of all questions at once."""
    return tr.alerts_for(tr.detect_trends(periods(spark, sf)), _asked(spark, sf), 0.1).select("query_id", "position", "matched", "alert_type", "topic", "severity")


@query("absences_for", f"""WITH {STATS}, {_ASKED}, s AS (SELECT topic FROM z WHERE {_SKIP} AND mean_all >= 3 AND n = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY topic) AS position, topic FROM (SELECT DISTINCT query_id, topic FROM s JOIN qw ON contains(lower(topic), w))) WHERE position <= 2""")
def _absences_for(spark, sf):
    return tr.absences_for(tr.silent_topics(periods(spark, sf)), _asked(spark, sf)).select("query_id", "position", "topic")


# --- evaluation --------------------------------------------------------------------------------------

_LABELS = "l AS (SELECT l.doc_id, quality = 1 AS actual, contains(lower(text), 'the') AS predicted, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS a, CASE WHEN contains(lower(text), 'thing') THEN 'good' WHEN contains(lower(text), 'que ') THEN 'toxic' ELSE 'poor' END AS p FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf):
    lo = F.lower("text")
    rows = table(spark, sf, "documents").select("doc_id", lo.contains("the").alias("predicted"), F.when(lo.contains("thing"), "good").when(lo.contains("que "), "toxic").otherwise("poor").alias("p"))
    gold = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("actual"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("a"))
    return ev.gold_vs_pipeline(gold, rows, "doc_id")


def _gold_sql(size: int) -> str:
    return f"""{INSIGHTS}, ns AS (SELECT source, brand_sentiment, count(*) AS n FROM insights GROUP BY 1, 2), qt AS (SELECT source, brand_sentiment, greatest(1, CAST(round_even(n * {size} / (SELECT sum(n) FROM ns)::DOUBLE, 0) AS INTEGER)) AS take FROM ns),
hh AS (SELECT *, md5(post_id || ':42') AS h FROM insights), rk AS (SELECT *, row_number() OVER (PARTITION BY source, brand_sentiment ORDER BY h, post_id) AS rn FROM hh),
gold AS (SELECT rk.* FROM rk JOIN qt USING (source, brand_sentiment) WHERE rn <= take ORDER BY h, post_id LIMIT {size})"""


@query("stratified_gold_sample", f"WITH {_gold_sql(200)} SELECT post_id, source, brand_sentiment FROM gold")
def _gold(spark, sf):
    return ev.stratified_gold_sample(insights(spark, sf), ["source", "brand_sentiment"], "post_id", 200).select("post_id", "source", "brand_sentiment")


@query("gold_entries", f"""WITH {_gold_sql(50)} SELECT row_number() OVER (ORDER BY post_id) - 1 AS gold_id, md5(text) AS text, title, source, url, brand_sentiment AS pipeline_sentiment, type_tag AS pipeline_taxonomy_type, topic AS pipeline_taxonomy_topic,
persona AS pipeline_persona, round(signal_strength, 6) AS pipeline_signal_strength, FALSE AS labeled FROM gold""")
def _entries(spark, sf):
    s = ev.gold_entries(ev.stratified_gold_sample(insights(spark, sf), ["source", "brand_sentiment"], "post_id", 50))
    return s.select("gold_id", F.md5("text").alias("text"), "title", "source", "url", "pipeline_sentiment", "pipeline_taxonomy_type", "pipeline_taxonomy_topic", "pipeline_persona",
                    R6(F.col("pipeline_signal_strength")).alias("pipeline_signal_strength"), "labeled")


@query("gold_vs_pipeline", f"WITH {_LABELS} SELECT doc_id, actual, predicted, a, p FROM l")
def _gold_join(spark, sf):
    return labelled(spark, sf)


@query("accuracy", f"WITH {_LABELS} SELECT round(avg(CAST(p = a AS INTEGER)), 6) AS accuracy FROM l")
def _accuracy(spark, sf):
    return labelled(spark, sf).agg(R6(ev.accuracy(F.col("p"), F.col("a"))).alias("accuracy"))


_PRF = "round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall, round(2 * (tp / greatest(tp + fp, 1)::DOUBLE) * (tp / greatest(tp + fn, 1)::DOUBLE) / greatest(tp / greatest(tp + fp, 1)::DOUBLE + tp / greatest(tp + fn, 1)::DOUBLE, 1e-9), 6) AS f1"


def _prf(df):
    return df.select(*[c for c in df.columns if c not in ("precision", "recall", "f1")], *[R6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("precision_recall_f1", f"WITH {_LABELS}, c AS (SELECT count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted AND NOT actual) AS fp, count(*) FILTER (WHERE NOT predicted AND actual) AS fn FROM l) SELECT *, {_PRF} FROM c")
def _precision(spark, sf):
    return _prf(ev.precision_recall_f1(labelled(spark, sf), F.col("predicted"), F.col("actual")))


@query("per_class_prf", f"WITH {_LABELS}, k AS (SELECT DISTINCT a AS class FROM l), c AS (SELECT class, count(*) FILTER (WHERE p = class AND a = class) AS tp, count(*) FILTER (WHERE p = class AND a <> class) AS fp, count(*) FILTER (WHERE p <> class AND a = class) AS fn FROM k, l GROUP BY 1) SELECT *, {_PRF} FROM c")
def _per_class(spark, sf):
    return _prf(ev.per_class_prf(labelled(spark, sf), "p", "a"))


@query("cluster_size_stats", f"WITH {INSIGHTS}, c AS (SELECT topic, count(*) AS n FROM insights GROUP BY 1) SELECT min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, median(n) AS median_size FROM c")
def _sizes(spark, sf):
    return ev.cluster_size_stats(insights(spark, sf), "topic").withColumn("mean_size", R6(F.col("mean_size")))


@query("topic_purity", f"WITH {INSIGHTS}, c AS (SELECT persona, topic, count(*) AS c FROM insights GROUP BY 1, 2), p AS (SELECT persona, max(c) / sum(c)::DOUBLE AS p FROM c GROUP BY 1) SELECT round(avg(p), 6) AS mean_purity, round(min(p), 6) AS min_purity, count(*) FILTER (WHERE p >= 0.8) AS above_80 FROM p")
def _purity(spark, sf):
    t = ev.topic_purity(insights(spark, sf), "persona", "topic")
    return t.select(R6(F.col("mean_purity")).alias("mean_purity"), R6(F.col("min_purity")).alias("min_purity"), "above_80")


from tidemark.functions.text import STOP_QUALITY  # noqa: E402
from tidemark.queries.search_queries import coherence_sql, _docs_src  # noqa: E402


@query("token_coherence", f"WITH {coherence_sql(STOP_QUALITY)} SELECT round(avg(m), 6) AS mean_coherence, round(min(m), 6) AS min_coherence, round(max(m), 6) AS max_coherence FROM mj")
def _token_coherence(spark, sf):
    t = ev.token_coherence(_docs_src(spark, sf), "source", F.col("text"))
    return t.select(*[R6(F.col(c)).alias(c) for c in t.columns])


@query("citation_faithfulness", f"""WITH {ANSWERS}, a AS (SELECT conv_id, turn, regexp_extract_all(response, '\\[S(\\d+)\\]', 1) AS c, list_distinct(list_transform(regexp_extract_all(response, '\\[S(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT))) AS ids,
list_filter(list_transform(string_split_regex(response, '[.!?]\\s'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20 AND NOT starts_with(s, '#') AND NOT starts_with(s, '|') AND NOT starts_with(s, '-')) AS s FROM answers)
SELECT conv_id, turn, len(c) AS total_citations, len(list_filter(ids, lambda v: v BETWEEN 1 AND 10)) AS unique_sources_cited, len(list_filter(ids, lambda v: v > 10)) AS invalid_citations, len(s) AS total_substantive_sentences, len(list_filter(s, lambda v: regexp_matches(v, '\\[S\\d+\\]'))) AS cited_sentences,
round(len(list_filter(s, lambda v: regexp_matches(v, '\\[S\\d+\\]'))) / greatest(len(s), 1)::DOUBLE, 6) AS faithfulness_ratio, round(len(list_filter(ids, lambda v: v BETWEEN 1 AND 10)) / 10.0::DOUBLE, 6) AS source_coverage FROM a""")
def _citations(spark, sf):
    c = ev.citation_faithfulness(answers(spark, sf), "response", F.lit(10), ["conv_id", "turn"])
    return c.withColumns({"faithfulness_ratio": R6(F.col("faithfulness_ratio")), "source_coverage": R6(F.col("source_coverage"))})


# --- streaming: the batch form is the oracle -------------------------------------------------------------

_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
                       T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark, sf):
    return st.read_stream(spark, f"{sf}/events*.parquet", _EVENT).withColumn("ts", F.col("ts").cast("timestamp"))


_EVK = Pack.words("k", ["error", "view", "\"k\": 7"])
_CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query("stream_trend_log", f"SELECT CAST(ts AS DATE) AS day, keyword, count(*) AS n FROM (SELECT ts, unnest(list_filter(['error', 'view', '\"k\": 7'], lambda w: contains(event_type || props, w))) AS keyword FROM events) WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2")
def _st1(spark, sf):
    s = event_stream(spark, sf).withColumn("text", F.concat("event_type", "props"))
    return st.run_to_table(st.trend_counts(s, _EVK, "ts", "text"), "append", "trend-log")


@query("stream_dedup", "SELECT count(DISTINCT user_id || event_type) AS n FROM events")
def _st2(spark, sf):
    s = st.dedup_within(event_stream(spark, sf), F.concat(F.col("user_id").cast("string"), "event_type"), "ts", "60 days")
    return st.run_to_table(s.select("dedup_key"), "append", "dedup").agg(F.count(F.lit(1)).alias("n"))


@query("stream_enrich_novel", "SELECT md5(event_type) AS fp, event_type = 'error' AS negative FROM events GROUP BY 1, 2")
def _st3(spark, sf):
    s = event_stream(spark, sf).withColumn("fp", F.md5("event_type"))
    made = BucketTable(spark, scratch_path(spark, "novel"), "fp", "fp string, negative boolean", 16)
    label = lambda d: d.select("fp", (F.col("event_type") == "error").alias("negative"))
    st.enrich_novel(s, made, label, scratch_path(spark, "novel-chk")).awaitTermination()
    return made.read().select("fp", "negative")


@query("stream_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def _st3_upsert(spark, sf):
    """The newest event of each user, kept in a table that the stream updates bucket by bucket."""
    s = event_stream(spark, sf).select("user_id", "event_type", "event_id", F.col("ts"))
    made = BucketTable(spark, scratch_path(spark, "upsert"), "user_id", "user_id bigint, event_type string, event_id bigint, ts timestamp", 16)
    into(s, lambda batch, epoch: made.upsert(batch, [F.desc("ts"), F.desc("event_id")], epoch), scratch_path(spark, "upsert-chk")).awaitTermination()
    return made.read().select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_period_alerts", "SELECT start, topic, count(*) AS n, count(*) FILTER (WHERE topic = 'error') AS neg FROM (SELECT event_type AS topic, unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS start FROM events) GROUP BY 1, 2")
def _st4(spark, sf):
    s = st.period_counts(event_stream(spark, sf), "ts", "event_type", F.col("event_type") == "error")
    out = st.last_update(st.run_to_table(s, "update", "periods"), ["start", "topic"], ["n", "neg"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_CLOSED_PERIODS = f"""{DATED}, cl AS (SELECT CAST(max(day) - INTERVAL 1 DAY AS DATE) AS c FROM dt), p0 AS (SELECT topic, (date_diff('day', day, c) - 1) // 7 AS back, negative FROM dt, cl WHERE day < c),
pc AS (SELECT topic, CAST((SELECT max(back) FROM p0) - back AS INTEGER) AS p, count(*) AS n, count(*) FILTER (WHERE negative) AS neg FROM p0 GROUP BY 1, 2)"""


@query("stream_trend_alerts", _ALERT(f"{_VOLUME} UNION ALL {_SHIFT} UNION ALL {_EMERGE}").replace(PERIODS, _CLOSED_PERIODS))
def _st4_alerts(spark, sf):
    """Alerts of the newest closed window, from the windows that the stream has counted."""
    s = st.period_counts(dated_rows(event_stream(spark, sf)), "ts", "topic", F.col("negative"))
    windows = st.last_update(st.run_to_table(s, "update", "alert-periods"), ["start", "topic"], ["n", "neg"])
    return _alert_cols(tr.detect_trends(st.closed_periods(windows)))


@query("stream_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b, event_id FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g), r AS (SELECT user_id, sid, count(*) AS n, max(ts) + INTERVAL 12 HOUR AS e FROM s GROUP BY 1, 2) SELECT user_id, n, count(*) AS sessions FROM r WHERE e <= {_CLOSED} GROUP BY 1, 2""")
def _st5(spark, sf):
    s = st.sessions(event_stream(spark, sf), "ts", "user_id", "12 hours")
    return st.run_to_table(s, "append", "sessions").groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


@query("stream_run_delta", "SELECT event_type AS label, count(*) AS total_n FROM events GROUP BY 1")
def _st6(spark, sf):
    s = st.running_deltas(event_stream(spark, sf).select("event_id", "event_type"), "event_type")
    added = st.batch_deltas(st.run_to_table(s, "update", "deltas"), ["label"])
    return added.groupBy("label").agg(F.sum("batch_n").alias("total_n"))


@query("stream_label_deltas", "SELECT event_type AS label, count(*) AS added, count(*) AS total_n FROM events GROUP BY 1")
def _st6_keyed(spark, sf):
    """What each micro-batch added per label, from keyed state; its sum is the total that the state holds at the end."""
    s = keyed.label_deltas(event_stream(spark, sf), "event_type", "ts", silence="365 days")
    out = st.run_to_table(s, "update", "keyed")
    return out.where("not silent").groupBy("label").agg(F.sum("batch_n").alias("added"), F.max("total_n").alias("total_n"))


# --- sources and sinks: tables written out and read back ------------------------------------------------------

def _dump(spark, df, name, fmt="json"):
    path = scratch_path(spark, name)
    getattr(df.write, fmt)(path)
    return path


@query("read_posts_json", "SELECT CAST(doc_id AS VARCHAR) AS post_id, md5(text) AS text_md5, source, n_chars AS score FROM documents")
def _posts_json(spark, sf):
    """Documents landed as objects of large one-line files, read back in byte ranges."""
    d = table(spark, sf, "documents").select(F.to_json(F.struct("text", F.col("doc_id").cast("string").alias("post_id"), "source", F.col("n_chars").alias("score"))).alias("value"))
    path = scratch_path(spark, "posts")
    d.write.option("lineSep", ",").text(path)
    back = readers.read_posts_json(spark, [path], split=True)
    return back.where("_corrupt_record is null").select("post_id", F.md5("text").alias("text_md5"), "source", "score")


@query("flatten_listing_json", """WITH l AS (SELECT doc_id, 'Thread ' || doc_id AS title, coalesce(text, '') AS body, lang, n_chars FROM documents), t AS (SELECT *, CASE WHEN body <> '' THEN trim(title || chr(10) || chr(10) || body) ELSE trim(title) END AS full_text FROM l)
SELECT CAST(doc_id AS VARCHAR) AS post_id, md5(full_text) AS text_md5, title, lang AS subreddit, 'https://reddit.com/r/' || lang || '/' || doc_id AS url, CAST(DATE '2024-01-01' + CAST(doc_id % 50 AS INTEGER) AS DATE) AS post_date, n_chars AS score FROM t WHERE length(full_text) >= 30 AND body NOT IN ('[removed]', '[deleted]')""")
def _listing(spark, sf):
    """Documents landed as listings of a hundred children, read back child by child."""
    i = F.col("doc_id")
    post = F.struct(F.concat(F.lit("Thread "), i.cast("string")).alias("title"), F.col("text").alias("selftext"), i.cast("string").alias("id"), F.concat(F.lit("/r/"), "lang", F.lit("/"), i.cast("string")).alias("permalink"),
                    F.col("lang").alias("subreddit"), (F.lit(1704067200.0) + (i % 50) * 86400 + 3600).alias("created_utc"), F.col("n_chars").alias("score"))
    child = table(spark, sf, "documents").select(F.floor(i / 100).alias("part"), F.struct(F.lit("t3").alias("kind"), post.alias("data")).alias("child"))
    pages = child.groupBy("part").agg(F.struct(F.collect_list("child").alias("children")).alias("data")).select("data")
    back = readers.read_listing_json(spark, [_dump(spark, pages, "listing")], split=True)
    return readers.flatten_listing(back, as_of()).select("post_id", F.md5("text").alias("text_md5"), "title", "subreddit", "url", "post_date", "score")


_LANDED = ["'reddit_' || doc_id", "'x_posts' || doc_id", "'bsky/' || source", "'community/' || lang", "'all_scraped_' || source", "'Twitter-' || doc_id", "'max_' || source"]
_LANDED_AS = ["Reddit", "Twitter/X", "Bluesky", "Forums", "Multi-Source", "Twitter/X", "Unknown"]


@query("infer_source_from_path", "SELECT doc_id, CASE CAST(doc_id % 7 AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_LANDED_AS)) + " END AS source FROM documents")
def _infer(spark, sf):
    name = F.expr("CASE CAST(doc_id % 7 AS INT) " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_LANDED)) + " END")
    return table(spark, sf, "documents").select("doc_id", readers.infer_source(F.concat(F.lit("/landing/"), name, F.lit(".json"))).alias("source"))


@query("read_feed_xml", """WITH f AS (SELECT doc_id, source, lang, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS body FROM documents)
SELECT 'Item ' || doc_id || ' of ' || source || ' & <co>' AS title, md5('Item ' || doc_id || ' of ' || source || ' & <co>' || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END) AS text_md5, 'https://ex.org/' || doc_id AS url, 'News:wire' AS source,
CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS post_date, lang || ',' || source AS categories, substr(body, 1, 500) AS summary FROM f""")
def _feed(spark, sf):
    """Documents landed as feed items, entities doubled as feeds do, read back through the XML source."""
    d = table(spark, sf, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    items = d.select(F.concat(F.lit("Item "), F.col("doc_id").cast("string"), F.lit(" of "), "source", F.lit(" &amp; &lt;co&gt;")).alias("title"), F.concat(F.lit("https://ex.org/"), F.col("doc_id").cast("string")).alias("link"),
                     F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " ")).alias("description"), F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 08:00:00 +0000")).alias("pubDate"), F.array("lang", "source").alias("category"))
    path = scratch_path(spark, "feed")
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    back = readers.read_feed_xml(spark, [path], "wire", as_of())
    return back.select("title", F.md5("text").alias("text_md5"), "url", "source", "post_date", F.array_join("categories", ",").alias("categories"), "summary")


@query("read_posts_envelope", "SELECT CAST(doc_id AS VARCHAR) AS post_id, md5(trim(text)) AS text_md5, source FROM documents WHERE length(trim(text)) > 0")
def _envelope(spark, sf):
    """Documents landed as envelopes of at most a hundred items, one per line, with the text under raw_text."""
    d = table(spark, sf, "documents").select(F.col("text").alias("raw_text"), F.col("doc_id").cast("string").alias("post_id"), "source")
    env = d.groupBy(F.floor(F.col("post_id").cast("bigint") / 100).alias("part")).agg(F.collect_list(F.struct("raw_text", "post_id", "source")).alias("items"))
    path = _dump(spark, env.select("items"), "envelope")
    back = readers.read_posts_envelope(spark, [path], as_of(), multi_line=False)
    return back.select("post_id", F.md5("raw_text").alias("text_md5"), "source")


@query("read_posts_text", "SELECT md5(trim(l)) AS post_id, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS l FROM documents) WHERE length(trim(l)) > 0 GROUP BY 1")
def _text(spark, sf):
    path = _dump(spark, table(spark, sf, "documents").select(F.replace("text", F.lit("\r"), F.lit("")).alias("value")), "lines", "text")
    return readers.read_posts_text(spark, [path], as_of()).groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))


@query("consolidate_schema", f"WITH {POSTS} SELECT post_id::VARCHAR AS post_id, source, post_date, score, '' AS forum_section, 'unknown' AS username, 0 AS repost_count FROM posts")
def _consolidate(spark, sf):
    p = posts(spark, sf).drop("username").withColumns({"post_date": F.col("post_date").cast("string"), "post_id": F.col("post_id").cast("string")})
    return readers.consolidate(p, as_of()).select("post_id", "source", "post_date", "score", "forum_section", "username", "repost_count")


@query("extract_page", """WITH h AS (SELECT page_id, html, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS a FROM pages) SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS n_links, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) <> '' AS has_title, a <> '' AS has_article FROM h""")
def _page(spark, sf):
    d = readers.extract_page(table(spark, sf, "pages"))
    return d.select("page_id", F.size("links").cast("bigint").alias("n_links"), (F.col("page_title") != "").alias("has_title"), (F.length("body_text") > 0).alias("has_article"))


@query("comment_tree_depth", "WITH RECURSIVE t AS (SELECT event_id AS id, CASE WHEN event_id % 37 = 0 THEN -1 ELSE event_id - event_id % 37 + (event_id % 37 - 1) // 3 END AS parent FROM events), r(id, d) AS (SELECT id, 0 FROM t WHERE parent = -1 UNION ALL SELECT t.id, r.d + 1 FROM t JOIN r ON t.parent = r.id) SELECT d AS comment_depth, count(*) AS n FROM r GROUP BY 1")
def _depth(spark, sf):
    i = F.col("event_id")
    t = table(spark, sf, "events").select(i.alias("id"), F.when(i % 37 == 0, -1).otherwise(i - i % 37 + F.floor((i % 37 - 1) / 3)).alias("parent_id"))
    return readers.comment_depth(t).groupBy("comment_depth").agg(F.count(F.lit(1)).alias("n"))


@query("compose_video_posts", """WITH v AS (SELECT page_id AS vid, 'Video ' || page_id AS title, html AS tr, page_id % 3 = 0 AS has_tr FROM pages), c AS (SELECT doc_id, doc_id % (SELECT count(*) FROM pages) AS vid, text FROM documents WHERE length(text) >= 20)
SELECT 'video' AS kind, count(*) AS n, CAST(sum(length(CASE WHEN has_tr AND length(tr) > 50 THEN title || chr(10) || chr(10) || tr ELSE title || chr(10) || chr(10) || 'a long description' END)) AS BIGINT) AS chars FROM v UNION ALL SELECT 'comment', count(*), CAST(sum(length(text)) AS BIGINT) FROM c JOIN v USING (vid)""")
def _videos(spark, sf):
    p = table(spark, sf, "pages")
    n = p.agg(F.count(F.lit(1))).scalar()
    vid = F.col("page_id").cast("string")
    videos = p.select(vid.alias("video_id"), F.concat(F.lit("Video "), vid).alias("title"), F.lit("chan").alias("channel"), F.lit("2024-01-05T00:00:00Z").alias("published"), F.lit("a long description").alias("description"), F.col("page_id").alias("pos"))
    tr_ = p.where("page_id % 3 = 0").select(vid.alias("video_id"), F.col("html").alias("transcript"))
    com = table(spark, sf, "documents").select((F.col("doc_id") % n).cast("string").alias("video_id"), "text", F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("published"), F.lit(3).alias("likes"))
    out = readers.compose_video_posts(videos.unionByName(videos), tr_, com, as_of())
    return out.groupBy(F.when(F.col("source") == "YouTube (comment)", "comment").otherwise("video").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


_LOGK = [t for r in P["log_keywords"].rules for t in r.substr]


@query("trend_log_roundtrip", f"WITH {INSIGHTS}, h AS (SELECT *, len({sql_labels('log_keywords', 'tlo')}) AS hits FROM insights) SELECT count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits, 2 * count(*) - 100 AS dropped FROM h")
def _log(spark, sf):
    """Append twice, read back, compact to the newest 100."""
    i = insights(spark, sf)
    path, small = scratch_path(spark, "log"), scratch_path(spark, "log-small")
    sinks.append_trend_log(i, path, P["log_keywords"], F.lit("2024-02-01 00:00:00"))
    sinks.append_trend_log(i, path, P["log_keywords"], F.lit("2024-02-02 00:00:00"))
    sinks.compact_log(spark, path, small, 100)
    log = readers.read_trend_log(spark, path)
    newest = log.where("logged_at = timestamp'2024-02-02 00:00:00'")
    kept = readers.read_trend_log(spark, small).agg(F.count(F.lit(1))).scalar()
    return newest.agg(F.count(F.lit(1)).alias("n"), F.sum("_trend_score").alias("hits"), (log.agg(F.count(F.lit(1))).scalar() - kept).alias("dropped"))


@query("export_table", "SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents")
def _export(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.array("lang", "source").alias("tags"))
    path = scratch_path(spark, "export")
    sinks.export_table(d, path, "csv")
    back = spark.read.option("header", True).option("escape", '"').schema("doc_id bigint, source string, tags string").csv(path)
    return back.where(F.get_json_object("tags", "$[1]") == F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("export_markdown", f"""WITH {INSIGHTS} SELECT md5('## ' || CASE WHEN length(title) > 0 THEN title ELSE coalesce(substr(text, 1, 80), 'null') END || chr(10) || '- **Type:** ' || coalesce(type_tag, 'None') || ' > ' || coalesce(topic, 'None') || chr(10) || '- **Sentiment:** ' || coalesce(brand_sentiment, 'None')
|| chr(10) || '- **Persona:** ' || coalesce(persona, 'None') || chr(10) || '- **Journey Stage:** ' || coalesce(journey_stage, 'None') || chr(10) || '> ' || coalesce(text, 'null') || chr(10)) AS block, count(*) AS n FROM insights GROUP BY 1""")
def _markdown(spark, sf):
    return sinks.insight_markdown(insights(spark, sf)).groupBy(F.md5("value").alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("cluster_sink", f"WITH {INSIGHTS} SELECT topic AS cluster_id, count(*) AS n FROM insights GROUP BY 1")
def _cluster_sink(spark, sf):
    i = insights(spark, sf).withColumn("cluster_id", F.col("topic")).select("cluster_id", "post_id")
    cards = i.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("insight_count"))
    path = scratch_path(spark, "clusters")
    sinks.cluster_sink(i, cards, i.agg(F.count(F.lit(1)).alias("members")), path)
    return spark.read.parquet(f"{path}/members").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
