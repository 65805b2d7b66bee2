"""Continuous intake with Structured Streaming: duplicates dropped within the watermark, windowed counts, and per-key limits as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_events(stream: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the time that rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, group: str, value: str, time: str = "ts", width: str = "1 day") -> DataFrame:
    """Rows and whole hundredths of a value for each group and window."""
    return stream.groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("hundredths"))


def limited(stream: DataFrame, most: int, window_ms: int) -> DataFrame:
    """Requests (key, ts_ms, seq) that a per-key limit lets through; the window starts with a key's first request and is kept as state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        for part in parts:
            keep = []
            for t in part.sort_values(["ts_ms", "seq"])["ts_ms"].tolist():
                if start is None or t - start >= window_ms:
                    start, count = t, 0
                count += 1
                keep.append(count <= most)
            state.update((start, count))
            yield part.sort_values(["ts_ms", "seq"])[keep][["key", "ts_ms", "seq"]]

    return stream.groupBy("key").applyInPandasWithState(step, "key long, ts_ms long, seq long", "start long, count long", "append", GroupStateTimeout.NoTimeout)


def replay(aggregated: DataFrame, folder: str) -> DataFrame:
    """Run a streaming aggregate over all that its source holds now and return its final state, kept as Parquet under `folder`."""
    spark: SparkSession = aggregated.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state-{number:06d}")
        numbers.append(number)

    numbers: list[int] = []
    query = aggregated.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], aggregated.schema)
    return spark.read.parquet(f"{folder}/state-{max(numbers):06d}")
