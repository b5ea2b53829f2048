"""Structured Streaming forms of the incremental steps.

Every builder returns an unstarted streaming DataFrame (or a started query where a sink
is part of the meaning).  ``run_to_table`` drains what has arrived and reads the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.rules import Pack, all_labels
from tidemark.session import scratch_path
from tidemark.streaming.upsert import BucketTable, into


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def trend_counts(rows: DataFrame, keywords: Pack, at: str, text: str, delay: str = "1 day") -> DataFrame:
    """(day, keyword, n) per tumbling day; late rows beyond the delay drop out."""
    hit = rows.withWatermark(at, delay).select(at, F.explode(all_labels(F.lower(F.col(text)), keywords)).alias("keyword"))
    return hit.groupBy(F.window(at, "1 day"), "keyword").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").cast("date").alias("day"), "keyword", "n")


def dedup_within(rows: DataFrame, key: Column, at: str, horizon: str = "7 days") -> DataFrame:
    """First arrival per key within the horizon; state is bounded by the watermark."""
    return rows.withColumn("dedup_key", key).withWatermark(at, horizon).dropDuplicatesWithinWatermark(["dedup_key"])


def period_counts(rows: DataFrame, at: str, topic: str, negative: Column, window: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, topic, n, neg) over sliding windows: the input of the volume rule."""
    return (rows.withColumn("_neg", negative.cast("int")).withWatermark(at, delay).groupBy(F.window(at, window, slide), F.col(topic).alias("topic"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_neg").alias("neg")).select(F.col("window.start").alias("start"), "topic", "n", "neg"))


def closed_periods(windows: DataFrame, window_days: int = 7, delay_days: int = 1) -> DataFrame:
    """(topic, period_idx, n, neg) for the trend rules: of the sliding windows the newest that the watermark has passed, and
    those ahead of it that meet end to end."""
    w = windows.withColumn("_d", F.col("start").cast("date"))
    closed = F.date_sub(w.agg(F.max("_d")).scalar(), delay_days)
    w = w.withColumn("_ago", F.datediff(closed, F.col("_d"))).where((F.col("_ago") >= window_days) & (F.col("_ago") % window_days == 0))
    last = w.agg(F.max("_ago")).scalar()
    return w.select("topic", ((last - F.col("_ago")) / window_days).cast("int").alias("period_idx"), "n", "neg")


def sessions(rows: DataFrame, at: str, who: str, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """(who, start, end, n): runs of rows whose gaps stay under the limit."""
    return (rows.withWatermark(at, delay).groupBy(F.session_window(at, gap), who).agg(F.count(F.lit(1)).alias("n"))
            .select(who, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"))


def running_deltas(rows: DataFrame, label: str) -> DataFrame:
    """(label, total_n) in update mode: the count so far of each label that a micro-batch touched.

    Rows are counted in each task before the shuffle, so a hot label sends one row per task.
    """
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("total_n"))


def batch_deltas(updates: DataFrame, keys: list[str], total: str = "total_n", out: str = "batch_n") -> DataFrame:
    """What each micro-batch of an update-mode table added to the running totals."""
    before = F.lag(total, 1, 0).over(Window.partitionBy(*keys).orderBy("epoch"))
    return updates.withColumn(out, F.col(total) - before)


def enrich_novel(rows: DataFrame, table: BucketTable, label: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Label only rows whose key the table lacks and add them; a micro-batch reads and writes the buckets of its keys alone.

    Returns a started query.  Replays are idempotent (see ``upsert``).
    """
    return into(rows, lambda batch, epoch: table.add_novel(batch, label, epoch), checkpoint)


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Drain the available input into a table in the shared folder and read it back.

    Update mode keeps the last value per key by writing each micro-batch with its id.
    """
    spark = stream.sparkSession
    out, chk = scratch_path(spark, name), scratch_path(spark, f"{name}-chk")
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", chk).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def last_update(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Newest value per key of an update-mode table."""
    return updates.groupBy(*keys).agg(*[F.max_by(v, "epoch").alias(v) for v in values])
