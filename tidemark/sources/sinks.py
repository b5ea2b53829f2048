"""Writers: trend log, exports, cluster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.rules import Pack, all_labels
from tidemark.operators.ordering import latest
from tidemark.schema import TREND_LOG


def stamp_trends(df: DataFrame, keywords: Pack, now: Column, text: str = "text") -> DataFrame:
    hits = all_labels(F.lower(F.col(text)), keywords)
    return df.withColumns({"_trend_keywords": hits, "_trend_score": F.size(hits).cast("bigint"), "_logged_at": now.cast("string")})


def append_trend_log(df: DataFrame, path: str, keywords: Pack, now: Column) -> None:
    """Append stamped rows as JSON lines; files are added, nothing is rewritten."""
    stamp_trends(df, keywords, now).select(*[f.name for f in TREND_LOG.fields if f.name in df.columns or f.name.startswith("_")]).write.mode("append").json(path)


def compact_log(spark: SparkSession, path: str, out: str, keep: int = 50_000) -> None:
    """Newest entries to a new path; the caller swaps the paths."""
    log = spark.read.schema(TREND_LOG).json(path)
    latest(log, [F.desc("_logged_at"), F.desc(F.xxhash64("text"))], keep).write.mode("errorifexists").json(out)


def export_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV (arrays and structs as JSON text) or JSON lines, one file per task."""
    if fmt == "csv":
        flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields]
        df.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("errorifexists").json(path)


def insight_markdown(df: DataFrame) -> DataFrame:
    """One text block per insight."""
    s = lambda c: F.coalesce(F.col(c), F.lit("None"))
    title = F.coalesce(F.when(F.length("title") > 0, F.col("title")), F.substring("text", 1, 80))
    return df.select(F.format_string("## %s\n- **Type:** %s > %s\n- **Sentiment:** %s\n- **Persona:** %s\n- **Journey Stage:** %s\n> %s\n", title,
                                     s("type_tag"), s("topic"), s("brand_sentiment"), s("persona"), s("journey_stage"), F.col("text")).alias("value"))


def card_markdown(df: DataFrame, order: str = "cluster_id") -> DataFrame:
    """One text block per cluster card; quotes and ideas as lists."""
    lines = lambda arr, mark: F.array_join(F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda q: F.concat(F.lit(mark), q)), "\n")
    section = lambda head, arr, mark: F.when(F.size(arr) > 0, F.concat(F.lit(head), lines(arr, mark), F.lit("\n"))).otherwise("")
    return df.select(F.concat(F.lit("# Cluster: "), F.col("title"), F.lit("\n- Brand: "), F.coalesce("brand", F.lit("Unknown")), F.lit("\n- Tags: "),
                              F.array_join("topic_focus_tags", ", "), F.lit("\n### Summary:\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n"),
                              section("### Quotes:\n", F.col("quotes"), "> "), section("### Top Suggestions:\n", F.col("top_ideas"), "- "), F.lit("\n---\n")).alias("value"))


def export_markdown(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("errorifexists").text(path)


def cluster_sink(members: DataFrame, cards: DataFrame, meta: DataFrame, path: str, cluster: str = "cluster_id") -> None:
    """Two flat tables and one row of metadata; members are not nested into their cluster."""
    members.write.mode("errorifexists").parquet(f"{path}/members")
    cards.write.mode("errorifexists").parquet(f"{path}/cards")
    meta.write.mode("errorifexists").json(f"{path}/metadata")
