"""Streaming replays of the event table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.streaming import intake


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="veridate-")
    return f"{base.rstrip('/')}/replay-{uuid.uuid4().hex}"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events by type, from a replay of the event stream with duplicates dropped."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema)
    # A stream reads folders only; where the table is one file, its name picks it from the folder it is in.
    one_file = all(f.rsplit("/", 1)[-1] == "events.parquet" for f in table.inputFiles())
    stream = (source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one_file else source.parquet(path)).withColumn("ts", F.col("ts").cast("timestamp"))
    state = intake.replay(intake.tumbling(intake.distinct_events(stream), "event_type", "value"), _folder(spark))
    return state.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "hundredths")


QUERIES = {"event_windows": event_windows}
ORACLES = {"event_windows": """SELECT strftime(ts, '%Y-%m-%d') AS "day", event_type, count(*) n, CAST(sum(CAST(round("value" * 100) AS BIGINT)) AS BIGINT) hundredths FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2"""}
