"""Keyed state: what each micro-batch added per label, out of the stream itself, and labels that fall silent.

State lives in the RocksDB store, one value per label with a schema of its own, and survives a restart in the checkpoint. A timer
per label goes off when event time has passed its last row by ``silence``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "label string, batch_n bigint, total_n bigint, silent boolean"


class LabelDeltas(StatefulProcessor):
    """Value state per label: rows so far and the time of the last one."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "total bigint, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total, last = self.seen.get() if self.seen.exists() else (0, None)
        added, newest = 0, last
        for r in rows:
            added += r["n"]
            newest = r["last_ms"] if newest is None else max(newest, r["last_ms"])
        if last is not None:
            self.handle.deleteTimer(last + self.silence_ms)
        self.seen.update((total + added, newest))
        self.handle.registerTimer(newest + self.silence_ms)
        yield Row(label=key[0], batch_n=added, total_n=total + added, silent=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(label=key[0], batch_n=0, total_n=self.seen.get()[0], silent=True)

    def close(self) -> None:
        pass


def counted(rows: DataFrame, label: str, at: str) -> DataFrame:
    """(label, at, n, last_ms): each task's rows of a label as one row per Arrow batch, so a hot label ships few rows. Rows without
    a label or a time are left out."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = pdf.groupby("label", sort=False)["at"].agg(["size", "max"]).reset_index()
            yield pd.DataFrame({"label": g["label"], "at": g["max"], "n": g["size"], "last_ms": g["max"].astype("datetime64[ms]").astype("int64")})

    some = rows.select(F.col(label).cast("string").alias("label"), F.col(at).alias("at")).where("label is not null and at is not null")
    return some.mapInPandas(count, "label string, at timestamp, n bigint, last_ms bigint")


def label_deltas(rows: DataFrame, label: str, at: str, silence: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(label, batch_n, total_n, silent): in update mode, a row per label that a micro-batch touched, and a row with ``silent`` once
    event time (less ``delay``) has passed a label's last row by ``silence``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    step = pd.Timedelta(silence) // pd.Timedelta("1ms")
    return (counted(rows, label, at).withWatermark("at", delay).groupBy("label")
            .transformWithState(LabelDeltas(int(step)), OUTPUT, outputMode="Update", timeMode="eventTime"))
