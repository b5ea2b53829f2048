"""Keyed state across restarts, timers, and the bucketed table: what it reads, replays, half-written batches."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import incremental as st, keyed
from tidemark.streaming.upsert import BucketTable

SCHEMA = "label string, at timestamp"


def drop_in(spark, src, rows):
    spark.createDataFrame(rows, "label string, t string").select("label", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(src)


def drain(spark, src, out, chk, **kw):
    """One start of the stream: what is new since the checkpoint, as (epoch, label, batch_n, total_n, silent)."""
    def put(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    s = keyed.label_deltas(st.read_stream(spark, src, SCHEMA, 1), "label", "at", **kw)
    s.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    return sorted((r.epoch, r.label, r.batch_n, r.total_n, r.silent) for r in rows)


def test_deltas_survive_a_restart(spark, tmp_path):
    batches = [[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00")], [("a", "2024-01-01 02:00:00")], [("b", "2024-01-01 03:00:00"), ("c", "2024-01-01 03:00:00")]]
    straight, halted = [str(tmp_path / n) for n in ("in1", "out1", "chk1")], [str(tmp_path / n) for n in ("in2", "out2", "chk2")]
    for rows in batches:
        drop_in(spark, straight[0], rows)
    once = drain(spark, *straight)
    for rows in batches:  # the same rows, the stream stopped and started again after each
        drop_in(spark, halted[0], rows)
        again = drain(spark, *halted)
    of = lambda rows: sorted(r[1:] for r in rows)
    assert of(once) == of(again) == [("a", 1, 3, False), ("a", 2, 2, False), ("b", 1, 1, False), ("b", 1, 2, False), ("c", 1, 1, False)]


def test_a_silent_label_is_reported_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for rows in ([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")], [("a", "2024-01-09 00:00:00")], [("a", "2024-01-10 00:00:00")], [("a", "2024-01-11 00:00:00")]):
        drop_in(spark, src, rows)
    got = drain(spark, src, out, chk, silence="3 days", delay="1 hour")
    silent = [r[1:] for r in got if r[4]]
    assert silent == [("b", 0, 1, True)]
    assert sum(r[2] for r in got if r[1] == "a") == 4


@pytest.fixture
def made(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "k", "k bigint, v string, n int", 8)
    t.upsert(spark.createDataFrame([(k, "old", 0) for k in range(200)], "k bigint, v string, n int"), [F.desc("n")], 0)
    return t


def state(t):
    return {r.k: (r.v, r.n) for r in t.read().collect()}


def test_upsert_reads_and_writes_touched_buckets_only(spark, made):
    batch = spark.createDataFrame([(3, "mid", 1), (3, "new", 2), (1000, "add", 1)], "k bigint, v string, n int")
    touched = made.touched_by(batch)
    others = [b for b in range(8) if b not in touched]
    assert others
    kept = f"{made.path}/data/version=0/bucket={others[0]}"
    shutil.move(kept, f"{made.path}/aside")  # a read of it would fail now
    made.upsert(batch, [F.desc("n")], 1)
    shutil.move(f"{made.path}/aside", kept)
    want = {k: ("old", 0) for k in range(200)} | {3: ("new", 2), 1000: ("add", 1)}
    assert state(made) == want
    assert {b: v for b, v in made.versions().items() if v == 1}.keys() == set(touched)


def test_replays_and_failed_batches_change_nothing(spark, made):
    batch = spark.createDataFrame([(5, "new", 1)], "k bigint, v string, n int")
    made.upsert(batch, [F.desc("n")], 1)
    want = state(made)
    made.upsert(batch, [F.desc("n")], 1)
    assert state(made) == want and len(want) == 200
    # written, but the manifest never came: not seen, and overwritten by the next attempt
    made.read().limit(1).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{made.path}/data/version=2")
    assert state(made) == want
    made.upsert(spark.createDataFrame([(7, "late", 9)], "k bigint, v string, n int"), [F.desc("n")], 2)
    assert state(made) == want | {7: ("late", 9)}


def test_an_empty_batch_is_no_version(spark, made):
    made.upsert(spark.createDataFrame([], "k bigint, v string, n int"), [F.desc("n")], 1)
    made.add_novel(spark.createDataFrame([(1,), (2,)], "k bigint"), lambda d: d.withColumns({"v": F.lit("x"), "n": F.lit(1)}), 2)
    assert state(made) == {k: ("old", 0) for k in range(200)}
