"""Model calls as streams: answers met with their requests by a deadline, and requests held to limits and budgets by keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def met_by_deadline(requests: DataFrame, hunter: DataFrame, mapper: DataFrame, deadline_s: int = 25, late: str = "1 minute") -> DataFrame:
    """requests (doc_id, asked_at) with what the two calls, answers (doc_id, answered_at, value), said in time: hunter, mapper, their flags, and codes.

    A row comes out once both have answered in time or the watermark says that none will; a call that is late or
    missing gives TIMEOUT, and what the other one said stays.
    """

    def answers(stream: DataFrame, name: str) -> DataFrame:
        return stream.select(F.col("doc_id").alias(f"{name}_doc"), F.col("answered_at").alias(f"{name}_at"), F.col("value").alias(name)).withWatermark(f"{name}_at", late)

    out = requests.withWatermark("asked_at", late)
    for stream, name in ((hunter, "hunter"), (mapper, "mapper")):
        in_time = F.expr(f"doc_id = {name}_doc and {name}_at >= asked_at and {name}_at <= asked_at + interval {deadline_s} seconds")
        met = out.join(answers(stream, name), in_time, "left_outer")
        out = met.withColumn(f"{name}_ok", F.col(f"{name}_at").isNotNull()).drop(f"{name}_doc", f"{name}_at")  # one event time a stream
    timed_out = F.when(F.col("hunter_ok") & F.col("mapper_ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit("TIMEOUT")))
    return out.select("doc_id", "asked_at", "hunter", "mapper", "hunter_ok", "mapper_ok", timed_out.alias("codes"))


class _Limiter(StatefulProcessor):
    """One key's window (its first request, and how many since) and what it has spent in all; a timer ends the window's state, spending stays."""

    def __init__(self, most: int, window_ms: int, cap: int):
        self.most, self.window_ms, self.cap = most, window_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, count long")
        self.spent = handle.getValueState("spent", "total long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        start, count = self.window.get() if self.window.exists() else (None, 0)
        total, before = (self.spent.get()[0] if self.spent.exists() else 0), start
        allowed, retry, affordable = [], [], []
        for t, cost in zip(batch["ts_ms"].tolist(), batch["cost"].tolist(), strict=True):
            if start is None or t - start >= self.window_ms:
                start, count = t, 0
            count += 1
            inside = count <= self.most
            allowed.append(inside)
            retry.append(None if inside else -((t - start - self.window_ms) // 1000))
            fits = inside and total + cost <= self.cap
            affordable.append(fits)
            total += cost if fits else 0
        self.window.update((start, count))
        self.spent.update((total,))
        if start != before:
            self.handle.registerTimer(start + self.window_ms)
        yield pd.DataFrame({"key": key[0], "ts_ms": batch["ts_ms"], "seq": batch["seq"], "allowed": allowed, "retry_after_s": pd.array(retry, dtype="Int64"), "affordable": affordable})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.window.exists() and self.window.get()[0] + self.window_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def held_to_limits(requests: DataFrame, most: int, window_ms: int, cap: int = 2**62, late: str = "1 minute") -> DataFrame:
    """requests (key, ts_ms, seq, cost) with allowed (at most `most` in a window that starts with a key's first request), retry_after_s, and affordable (allowed, and within the key's cap on all costs so far).

    Rows that come later than the watermark are left out, as their window may be over.  State lives in RocksDB.
    """
    spark: SparkSession = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = requests.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(_Limiter(most, window_ms, cap), "key long, ts_ms long, seq long, allowed boolean, retry_after_s long, affordable boolean", "append", "EventTime")
