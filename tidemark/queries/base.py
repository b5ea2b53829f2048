"""Registry of checked queries and the shared inputs: each entry is a Spark callable with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.rules import Pack, Rule, fenced, load_packs
from tidemark.operators import enrich

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = "2024-03-01"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def packs() -> dict[str, Pack]:
    return {**load_packs("marketplace"), **load_packs("sample")}


P = packs()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


# --- inputs -------------------------------------------------------------------------------

def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts, with the engagement fields derived from the id."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("post_id"), i.alias("pos"), "text", F.substring("text", 1, 40).alias("title"), "source", F.col("lang").alias("subreddit"),
        F.concat(F.lit("https://ex.org/p/"), (i % 700).cast("string")).alias("url"), F.concat(F.lit("user"), (i % 97).cast("string")).alias("username"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")).alias("post_date"), (F.col("n_chars") % 250).alias("score"),
        (i % 23).alias("like_count"), (i % 11).alias("num_comments"))


POSTS = """posts AS (SELECT doc_id AS post_id, doc_id AS pos, text, substr(text, 1, 40) AS title, source, lang AS subreddit,
  'https://ex.org/p/' || (doc_id % 700) AS url, 'user' || (doc_id % 97) AS username,
  CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS post_date, n_chars % 250 AS score,
  doc_id % 23 AS like_count, doc_id % 11 AS num_comments FROM documents)"""


def lowered(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).withColumn("lo", F.lower("text"))


LOW = f"{POSTS}, low AS (SELECT *, lower(text) AS lo FROM posts)"


def insights(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched posts plus the fields the richer path adds."""
    df = enrich.enrich_posts(posts(spark, sf), P, as_of(), normalize=False)
    df = df.withColumn("_lo", F.lower("text"))
    lo = F.col("_lo")
    df = df.withColumns(fenced({"target_brand": enrich.brand_of(lo, P), "journey_stage": enrich.best_label(lo, P["adhoc_journey"], "Unknown"),
                         "_sev": enrich.severity(lo, P)["score"]}))
    return df.withColumn("pm_priority_score", enrich.pm_priority(F.col("score"), F.col("_sev"), F.lit(None).cast("double"), F.lit(None).cast("double"))).drop("_lo", "_sev")


# --- packs as SQL ------------------------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(col: str, terms) -> str:
    terms = list(dict.fromkeys(terms))
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")" if terms else "FALSE"


# RE2 knows only ASCII word boundaries; spell the Unicode ones out.
_OPEN, _CLOSE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def sql_regex(pattern: str, lo: str = "lo") -> str:
    if pattern.startswith("\\b"):
        pattern = _OPEN + pattern[2:]
    if pattern.endswith("\\b"):
        pattern = pattern[:-2] + _CLOSE
    return f"regexp_matches({lo}, {q('(?i)' + pattern)})"


def sql_words(words, lo: str = "lo") -> str:
    return f"regexp_matches({lo}, {q(_OPEN + '(?:' + '|'.join(words) + ')' + _CLOSE)})"


def sql_rule(rule: Rule, lo: str = "lo", topics: str = "tp") -> str:
    pos = [f"coalesce({f}, FALSE)" for f in rule.flags]
    if rule.substr:
        pos.append(sql_any(lo, rule.substr))
    if rule.word:
        pos.append(sql_words(rule.word, lo))
    pos += [sql_regex(r, lo) for r in rule.regex]
    if rule.topics:
        pos.append(f"list_has_any({topics}, [{', '.join(q(t) for t in rule.topics)}])")
    parts = ["(" + " OR ".join(pos) + ")"] if pos else []
    parts += [sql_any(lo, g) for g in rule.all_of]
    parts += [sql_regex(r, lo) for r in rule.all_regex]
    parts += [f"coalesce({f}, FALSE)" for f in rule.all_flags] + [f"NOT coalesce({f}, FALSE)" for f in rule.none_flags]
    if rule.none_of:
        parts.append("NOT " + sql_any(lo, rule.none_of))
    return "(" + " AND ".join(parts) + ")" if parts else "TRUE"


def sql_pack(name: str, lo: str = "lo") -> str:
    return "(" + " OR ".join(sql_rule(r, lo) for r in P[name].rules) + ")"


def sql_sum(name: str, lo: str = "lo", weighted: bool = False) -> str:
    return "(" + " + ".join(f"CASE WHEN {sql_rule(r, lo)} THEN {r.weight if weighted else 1} ELSE 0 END" for r in P[name].rules) + ")"


def sql_first(name: str, default: str | None, lo: str = "lo") -> str:
    whens = " ".join(f"WHEN {sql_rule(r, lo)} THEN {q(r.label)}" for r in P[name].rules)
    return f"CASE {whens} ELSE {q(default) if default is not None else 'NULL'} END"


def sql_flags(name: str, lo: str = "lo") -> str:
    grouped: dict[str, list[str]] = {}
    for r in P[name].rules:
        grouped.setdefault(r.label, []).append(sql_rule(r, lo))
    return ", ".join(f"({' OR '.join(v)}) AS {k}" for k, v in grouped.items())


def sql_labels(name: str, lo: str = "lo") -> str:
    """Comma-joined labels in pack order."""
    return sql_labels_of(P[name], lo)


def sql_labels_of(pack: Pack, lo: str = "lo") -> str:
    grouped: dict[str, list[str]] = {}
    for r in pack.rules:
        grouped.setdefault(r.label, []).append(sql_rule(r, lo))
    items = ", ".join(f"CASE WHEN {' OR '.join(v)} THEN {q(k)} END" for k, v in grouped.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def sql_best(name: str, default: str, lo: str = "lo") -> str:
    counts = []
    for i, r in enumerate(P[name].rules):
        n = " + ".join(f"CAST(contains({lo}, {q(t)}) AS INTEGER)" for t in r.substr)
        counts.append(f"{{'hits': {n}, 'prio': {-i}, 'label': {q(r.label)}}}")
    best = f"list_aggregate([{', '.join(counts)}], 'max')"
    return f"CASE WHEN ({best}).hits > 0 THEN ({best}).label ELSE {q(default)} END"


_TYPE = (f"CASE WHEN is_churn_signal THEN 'Churn Signal' WHEN {sql_pack('question_phrases')} AND contains(lo, '?') THEN 'Question' "
         f"WHEN {sql_pack('complaint_words')} THEN 'Complaint' WHEN {sql_pack('request_words')} THEN 'Feature Request' "
         f"WHEN {sql_pack('bug_words')} THEN 'Bug Report' WHEN is_praise_signal THEN 'Praise' ELSE 'Feedback' END")
_SENT = (f"CASE WHEN {sql_sum('negative_words')} > {sql_sum('positive_words')} THEN 'Negative' WHEN {sql_sum('positive_words')} > {sql_sum('negative_words')} "
         f"THEN 'Positive' WHEN is_churn_signal THEN 'Negative' ELSE 'Neutral' END")
_SEV = "CASE " + " ".join(f"WHEN {sql_any('tlo', r.substr)} THEN {r.label}" for r in P["severity"].rules if r.substr) + " ELSE 30 END"

INSIGHTS = f"""{POSTS},
i0 AS (SELECT *, lower(title || ' ' || text) AS lo, lower(text) AS tlo FROM posts WHERE length(title || ' ' || text) >= 30),
i1 AS (SELECT *, {sql_flags('signal_flags')}, {sql_pack('pain')} AS pain, {sql_pack('urgent_words')} AS is_urgent FROM i0),
i2 AS (SELECT *, {sql_first('subtags', 'General')} AS topic, {_TYPE} AS type_tag, {_SENT} AS brand_sentiment, {sql_first('personas', 'General')} AS persona,
  CASE WHEN length(text) > 200 AND {sql_pack('specific_words')} THEN 'High' WHEN length(text) > 100 THEN 'Medium' ELSE 'Low' END AS clarity,
  {sql_first('brand_cascade', 'Other', 'tlo')} AS target_brand, {sql_best('adhoc_journey', 'Unknown', 'tlo')} AS journey_stage, {_SEV} AS severity_score FROM i1),
insights AS (SELECT *, least(least(score, 200) / 200.0::DOUBLE * 30 + least(length(text), 500) / 500.0::DOUBLE * 25 + CASE WHEN pain THEN 20 ELSE 0 END
  + CASE WHEN is_churn_signal THEN 15 ELSE 0 END + CASE WHEN topic <> 'General' THEN 10 ELSE 0 END, 100.0::DOUBLE) AS signal_strength,
  score * 0.2::DOUBLE + severity_score * 0.4::DOUBLE + 50 * 0.2::DOUBLE + 50 * 0.2::DOUBLE AS pm_priority_score FROM i2)"""
