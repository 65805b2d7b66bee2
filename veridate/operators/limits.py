"""Per-key request limits in windows that start at a key's first request.

Rows are dealt by key and sorted, then each task walks them with one key's state at
a time: no key's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def rate_limit(requests: DataFrame, most: int, window_ms: int) -> DataFrame:
    """requests (key, ts_ms, seq) with allowed and retry_after_s; a new window opens with the first request after the last one closed."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = object(), 0, 0
        for part in parts:
            allowed, retry = [], []
            for k, t in zip(part["key"].tolist(), part["ts_ms"].tolist(), strict=True):
                if k != key or t - start >= window_ms:
                    key, start, count = k, t, 0
                count += 1
                allowed.append(count <= most)
                retry.append(None if count <= most else -((t - start - window_ms) // 1000))
            yield part.assign(allowed=allowed, retry_after_s=pd.array(retry, dtype="Int64"))

    kind = requests.schema["key"].dataType.simpleString()
    ordered = requests.select("key", "ts_ms", "seq").repartition("key").sortWithinPartitions("key", "ts_ms", "seq")
    return ordered.mapInPandas(walk, f"key {kind}, ts_ms long, seq long, allowed boolean, retry_after_s long")
