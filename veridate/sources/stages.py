"""Stages of a plan as tables in the folder that driver and executors share, each with figures observed while it is written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests on one machine) under a temporary one."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own = _own or tempfile.mkdtemp(prefix="veridate-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """df as a table, and the figures (aggregates over its rows) of the job that wrote it."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    seen = Observation() if figures else None
    (df.observe(seen, *(c.alias(n) for n, c in figures.items())) if seen else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if seen else {}
