"""Time-bucketed baselines, alerts and run-over-run changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.rules import explode_hits
from tidemark.operators.ordering import rank_bounded, top_n_per_group
from tidemark.session import cut_lineage

# Alert thresholds and the topics that carry no alert.
Z_THRESHOLD, SHIFT_THRESHOLD, MIN_PERIODS = 2.0, 0.15, 2
SKIP_TOPICS = ("General", "Unknown", "")
NEGATIVE = ("Negative", "Complaint")
SEVERITIES = ("high", "medium", "low", "info")


def period_counts(df: DataFrame, topic: str, day: str, negative: Column, window_days: int = 7) -> DataFrame:
    """(topic, period_idx, n, neg): period 0 starts at the earliest day.

    The rows are read once: a row per topic and day is written, and the earliest day is a scalar subquery over those.
    """
    dated = df.where(F.col(day).isNotNull()).select(F.col(topic).alias("topic"), F.col(day).alias("_d"), negative.cast("int").alias("_neg"))
    daily = cut_lineage(dated.groupBy("topic", "_d").agg(F.count(F.lit(1)).alias("n"), F.sum("_neg").alias("neg")))
    first = daily.agg(F.min("_d")).scalar()
    idx = F.floor(F.datediff(F.col("_d"), first) / window_days).cast("int")
    # In a projection of its own: a grouping key may not hold a subquery.
    return daily.withColumn("period_idx", idx).groupBy("topic", "period_idx").agg(F.sum("n").alias("n"), F.sum("neg").alias("neg"))


def bucket_periods(df: DataFrame, topic: str, day: str, negative: Column, window_days: int = 7) -> DataFrame:
    """``period_counts`` with its ``start_end`` label."""
    first = df.agg(F.min(day)).scalar()
    start = F.date_add(first, F.col("period_idx") * window_days)
    label = F.concat(start.cast("string"), F.lit("_"), F.date_add(start, window_days - 1).cast("string"))
    return period_counts(df, topic, day, negative, window_days).withColumn("period", label)


def period_spine(df: DataFrame, day: str, window_days: int = 7) -> DataFrame:
    """Every period between the first and the last day, empty ones included: (period_idx, start_day, end_day)."""
    span = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    starts = F.sequence(F.col("_a"), F.col("_b"), F.expr(f"interval {window_days} days"))
    return span.select(F.posexplode(starts).alias("period_idx", "start_day")).withColumn(
        "end_day", F.date_add("start_day", window_days - 1))


def topic_baseline(periods: DataFrame) -> DataFrame:
    """Per topic: the last period against those before it.

    A topic's history starts with the period it first appears in; later silent periods
    count as zero.  Zeros need no rows: mean and deviation come from the sums and
    the number of periods, in whole numbers, so a flat history has deviation exactly 0.
    """
    last = periods.agg(F.max("period_idx")).scalar()
    p = periods.withColumn("_last", last)
    base, cur = F.col("period_idx") < F.col("_last"), F.col("period_idx") == F.col("_last")
    agg = p.groupBy("topic").agg(
        F.max("_last").alias("n_baseline"),
        F.min(F.when(base, F.col("period_idx"))).alias("first_seen"),
        F.coalesce(F.sum(F.when(base, F.col("n"))), F.lit(0)).alias("_s"),
        F.coalesce(F.sum(F.when(base, F.col("n") * F.col("n"))), F.lit(0)).alias("_q"),
        F.coalesce(F.sum(F.when(base, F.col("neg") / F.col("n"))), F.lit(0.0)).alias("_r"),
        F.count(F.when(base, F.lit(1))).alias("periods_seen"),
        F.coalesce(F.sum(F.when(cur, F.col("n"))), F.lit(0)).alias("current_n"),
        F.coalesce(F.sum(F.when(cur, F.col("neg"))), F.lit(0)).alias("current_neg"),
    )
    hist = F.when(F.col("first_seen").isNull(), F.lit(0)).otherwise(F.col("n_baseline") - F.col("first_seen"))
    out = agg.withColumn("history", hist)
    known = F.col("history") > 0
    mean = F.col("_s") / F.col("history")
    var = (F.col("history") * F.col("_q") - F.col("_s") * F.col("_s")) / (F.col("history") * F.col("history"))
    out = out.select(
        "topic", "n_baseline", "history", "periods_seen", "current_n", "current_neg",
        F.when(known, mean).alias("mean_n"), F.when(known, F.sqrt(var)).alias("std_n"),
        F.when(known, F.col("_r") / F.col("history")).alias("baseline_neg"),
        F.when(F.col("current_n") > 0, F.col("current_neg") / F.col("current_n")).alias("current_neg_ratio"),
        (F.col("_s") / F.col("n_baseline")).alias("mean_all_periods"))
    diff = F.col("current_n") - F.col("mean_n")
    z = F.when(F.col("std_n") > 0, diff / F.col("std_n")).when(diff == 0, 0.0).when(diff > 0, 5.0).otherwise(-5.0)
    return out.withColumn("z", F.when(F.col("history") > 0, z))


def _alert(df: DataFrame, kind: str, severity: Column, current: Column, baseline: Column, confidence: Column, message: Column,
           details: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("alert_type"), "topic", severity.alias("severity"), message.alias("message"),
                     current.cast("double").alias("current_value"), baseline.cast("double").alias("baseline_value"),
                     confidence.cast("double").alias("confidence"), details.alias("details"))


def _z_conf() -> Column:
    return F.least(F.lit(1.0), 1 - 1 / (1 + F.abs("z")))


def _pct() -> Column:
    return (F.col("current_n") - F.col("mean_n")) / F.greatest(F.col("mean_n"), F.lit(1.0)) * 100


def volume_alerts(stats: DataFrame, z_threshold: float = Z_THRESHOLD, min_periods: int = MIN_PERIODS) -> DataFrame:
    known = stats.where(F.col("history") >= min_periods)
    details = F.create_map(F.lit("z_score"), F.round("z", 2), F.lit("pct_change"), F.round(_pct(), 1))
    spikes = known.where((F.col("z") >= z_threshold) & (F.col("current_n") > 0))
    up = _alert(spikes, "volume_spike", F.when(F.col("z") >= 3, "high").otherwise("medium"), F.col("current_n"), F.col("mean_n"),
                _z_conf(), F.format_string("%s: +%.0f%% volume this period (%d vs avg %.0f, z=%.1f)", "topic", _pct(), "current_n", "mean_n", "z"), details)
    drops = known.where((F.col("z") <= -z_threshold) & (F.col("mean_n") > 2))
    down = _alert(drops, "declining", F.lit("medium"), F.col("current_n"), F.col("mean_n"), _z_conf(),
                  F.format_string("%s: %.0f%% volume drop (%d vs avg %.0f)", "topic", _pct(), "current_n", "mean_n"), details)
    return up.unionByName(down)


def sentiment_alerts(stats: DataFrame, threshold: float = SHIFT_THRESHOLD, min_periods: int = MIN_PERIODS) -> DataFrame:
    shift = F.col("current_neg_ratio") - F.col("baseline_neg")
    hit = stats.where((F.col("history") >= min_periods) & (F.col("current_n") >= 3) & (F.abs(shift) >= threshold))
    direction = F.when(shift > 0, "worsening").otherwise("improving")
    return _alert(hit, "sentiment_shift", F.when(F.abs(shift) >= 0.25, "high").otherwise("medium"),
                  F.col("current_neg_ratio"), F.col("baseline_neg"), F.when(F.col("current_n") >= 5, 0.7).otherwise(0.5),
                  F.format_string("%s: sentiment %s (%+.0f%% negative ratio shift, now %.0f%% vs baseline %.0f%%)", "topic", direction,
                                  shift * 100, F.col("current_neg_ratio") * 100, F.col("baseline_neg") * 100),
                  F.create_map(F.lit("shift_pp"), F.round(shift * 100, 1)))


def emerging_alerts(stats: DataFrame) -> DataFrame:
    hit = stats.where((F.col("current_n") >= 3) & (F.col("periods_seen") == 0))
    return _alert(hit, "emerging", F.lit("medium"), F.col("current_n"), F.lit(0), F.when(F.col("current_n") >= 5, 0.6).otherwise(0.4),
                  F.format_string("%s: NEW topic detected (%d signals, not seen in prior %d periods)", "topic", "current_n", "history"),
                  F.create_map(F.lit("periods_absent"), F.col("history").cast("double")))


def detect_trends(periods: DataFrame, z_threshold: float = Z_THRESHOLD, shift_threshold: float = SHIFT_THRESHOLD,
                  min_periods: int = MIN_PERIODS) -> DataFrame:
    """All alerts; nothing when fewer than ``min_periods`` + 1 periods exist."""
    stats = topic_baseline(periods).where(~F.col("topic").isin(*SKIP_TOPICS) & (F.col("n_baseline") >= min_periods))
    return (volume_alerts(stats, z_threshold, min_periods).unionByName(sentiment_alerts(stats, shift_threshold, min_periods))
            .unionByName(emerging_alerts(stats)))


def severity_order(df: DataFrame, severity: str = "severity", confidence: str = "confidence", tie: str = "topic") -> DataFrame:
    rank = F.coalesce(*[F.when(F.col(severity) == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(9))
    return df.orderBy(rank, F.desc(confidence), F.asc(tie))


def silent_topics(periods: DataFrame, min_baseline: float = 3.0) -> DataFrame:
    """Topics with an average of at least ``min_baseline`` over *all* earlier periods and nothing now."""
    stats = topic_baseline(periods)
    hit = stats.where(~F.col("topic").isin(*SKIP_TOPICS) & (F.col("n_baseline") >= 2)
                      & (F.col("mean_all_periods") >= min_baseline) & (F.col("current_n") == 0))
    return hit.select("topic", F.col("mean_all_periods").alias("baseline_avg"), "current_n",
                      F.col("periods_seen").alias("periods_with_signal"), F.col("n_baseline").alias("total_baseline_periods"),
                      F.format_string("%s: went silent (avg %.0f signals/period → 0 this period)", "topic", "mean_all_periods").alias("message"))


def spike_ratio(df: DataFrame, label: str, at: str, as_of: Column, window_days: int = 7, threshold: float = 2.0) -> DataFrame:
    """Labels whose recent count exceeds ``threshold`` times (older count + 1); both sides must occur."""
    recent = F.col(at) >= as_of - F.expr(f"interval {window_days} days")
    c = df.groupBy(label).agg(F.count_if(recent).alias("recent"), F.count_if(~recent).alias("prior"))
    ratio = F.col("recent") / (F.col("prior") + 1)
    return c.where((F.col("recent") > 0) & (F.col("prior") > 0)).withColumn("ratio", ratio).where(F.col("ratio") > threshold)


def rolling_sentiment(df: DataFrame, brand: str, day: str, sentiment: str, positive: str = "Praise", negative: str = "Complaint") -> DataFrame:
    """(brand, day, praise_3, complaint_3): 3-row means of daily counts, null before the third day."""
    daily = df.groupBy(brand, day).agg(F.count_if(F.col(sentiment) == positive).alias("praise"),
                                       F.count_if(F.col(sentiment) == negative).alias("complaint"))
    w = Window.partitionBy(brand).orderBy(day).rowsBetween(-2, 0)
    full = F.count(F.lit(1)).over(w) == 3
    return daily.select(brand, day, F.when(full, F.avg("praise").over(w)).alias("praise_3"),
                        F.when(full, F.avg("complaint").over(w)).alias("complaint_3"))


def sentiment_flips(df: DataFrame, brand: str, day: str, sentiment: str, positive: str = "Praise", negative: str = "Complaint") -> DataFrame:
    """Brands whose last rolling praise mean lies below the last complaint mean."""
    roll = rolling_sentiment(df, brand, day, sentiment, positive, negative)
    last = roll.groupBy(brand).agg(F.max_by("praise_3", day).alias("praise_3"), F.max_by("complaint_3", day).alias("complaint_3"))
    return last.where(F.col("praise_3") < F.col("complaint_3")).withColumn("note", F.lit("Complaint > Praise trend reversal"))


def snapshot_compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Full outer join of two long snapshots (metric_group, metric, value)."""
    c = current.select("metric_group", "metric", F.col("value").alias("current"))
    p = previous.select("metric_group", "metric", F.col("value").alias("prev"))
    return (c.join(p, ["metric_group", "metric"], "full_outer")
            .withColumn("delta", F.coalesce("current", F.lit(0)) - F.coalesce("prev", F.lit(0))))


def run_deltas(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Notable changes between two runs, by metric group.

    total: absolute change above 10; signals: 15 percent and 3 (high from 30 percent);
    churn: 2; entities: 20 percent and 3; topics: new with at least 3 rows.  Only
    where the earlier value is positive, new topics excepted.
    """
    both = snapshot_compare(current, previous)
    prev, cur, diff, grp = F.coalesce("prev", F.lit(0)), F.coalesce("current", F.lit(0)), F.col("delta"), F.col("metric_group")
    pct = F.bround(diff * 100.0 / F.when(prev > 0, prev)).cast("int")
    big = F.abs(diff) >= 3
    severity = (
        F.when((grp == "total") & (prev > 0) & (F.abs(diff) > 10), "info")
        .when((grp == "signal") & (prev > 0) & big & (F.abs(pct) >= 15), F.when(F.abs(pct) >= 30, "high").otherwise("medium"))
        .when((grp == "churn") & (prev > 0) & (F.abs(diff) >= 2), F.when(diff > 0, "high").otherwise("low"))
        .when((grp == "entity") & (prev > 0) & big & (F.abs(pct) >= 20), "medium")
        .when((grp == "topic") & F.col("prev").isNull() & (cur >= 3), "medium")
    )
    share = grp.isin("signal", "entity")
    return both.withColumn("severity", severity).where(F.col("severity").isNotNull()).select(
        "metric_group", "metric", prev.alias("prev"), cur.alias("current"), F.col("delta"),
        F.when(share, pct).alias("pct_change"),
        F.when(grp == "topic", "new").when(diff > 0, "up").otherwise("down").alias("direction"), "severity")


def relevant_alerts(alerts: DataFrame, words: list[str], min_baseline: float = 2.0, limit: int = 4, matched: int = 3) -> DataFrame:
    """For one question: up to three alerts whose topic contains a question word, topped up with high ones to four."""
    terms = [w.lower() for w in words if len(w) > 3]
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("topic").contains(t)
    base = alerts.where(F.col("baseline_value") >= min_baseline).withColumn("matched", hit)
    order = by_urgency()
    pool = base.where(F.col("matched") | (F.col("severity") == "high"))
    ranked = top_n_per_group(pool, "matched", order, limit, "_i").where(~F.col("matched") | (F.col("_i") <= matched))
    # At most 3 + 4 rows are left here.
    out = rank_bounded(ranked, [F.desc("matched"), F.asc("_i")], "position")
    return out.where(F.col("position") <= limit).drop("_i")


def relevant_absences(absences: DataFrame, words: list[str], limit: int = 2) -> DataFrame:
    hit = F.lit(False)
    for t in (w.lower() for w in words if len(w) > 3):
        hit = hit | F.lower("topic").contains(t)
    return absences.where(hit).orderBy("topic").limit(limit)


# --- many questions at once ----------------------------------------------------------------------------

def question_words(questions: DataFrame) -> DataFrame:
    """(query_id, word): the distinct lower-cased words of more than three characters of each question."""
    word = F.explode(F.array_distinct(F.split(F.lower("query"), r"\s+")))
    return questions.select("query_id", word.alias("word")).where(F.length("word") > 3)


def matching_topics(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, topic): which topics hold a word of which question. The words of all questions are one lexicon, in which each
    distinct topic is looked up once."""
    words = question_words(questions)
    topics = rows.select("topic").where("topic is not null").distinct()
    found = explode_hits(topics, "topic", words.select("word"), "word")
    return found.join(words, "word").select("query_id", "topic").distinct()


def by_urgency() -> list[Column]:
    """Severity, then confidence; ties by topic and type."""
    return [F.expr("case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end"),
            F.desc("confidence"), F.asc("topic"), F.asc("alert_type")]


def alerts_for(alerts: DataFrame, questions: DataFrame, min_baseline: float = 2.0, limit: int = 4, matched: int = 3) -> DataFrame:
    """(query_id, position, matched, alert..): ``relevant_alerts`` for every row of ``questions`` (query_id, query).

    A question's top-up are the first high alerts that it doesn't match; as many of the list are joined to it as it matches, plus
    ``limit``, so none is missed and no question meets all alerts.
    """
    base = cut_lineage(alerts.where(F.col("baseline_value") >= min_baseline))
    pairs = cut_lineage(matching_topics(base, questions))
    own = pairs.join(base, "topic")
    best = top_n_per_group(own, "query_id", by_urgency(), matched, "_i").withColumn("matched", F.lit(True))
    taken = own.groupBy("query_id").agg(F.count_if(F.col("severity") == "high").alias("_m"))
    asked = cut_lineage(questions.select("query_id").distinct().join(taken, "query_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0))))
    most = asked.agg(F.max("_m")).first()[0] or 0
    # the head of one list for all questions, as long as the question that skips most of it needs
    head = rank_bounded(base.where("severity = 'high'").orderBy(*by_urgency()).limit(int(most) + limit), by_urgency(), "_h")
    offered = asked.withColumn("_h", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int") + limit))).join(head, "_h")
    spare = offered.join(pairs, ["query_id", "topic"], "left_anti")
    extra = top_n_per_group(spare, "query_id", ["_h"], limit, "_i").withColumn("matched", F.lit(False))
    both = best.unionByName(extra.drop("_m", "_h"))
    return top_n_per_group(both, "query_id", [F.desc("matched"), F.asc("_i")], limit, "position").drop("_i")


def absences_for(absences: DataFrame, questions: DataFrame, limit: int = 2) -> DataFrame:
    """(query_id, position, absence..): ``relevant_absences`` for every row of ``questions`` (query_id, query)."""
    rows = cut_lineage(absences)
    return top_n_per_group(matching_topics(rows, questions).join(rows, "topic"), "query_id", ["topic"], limit, "position")
