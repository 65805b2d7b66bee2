"""A sink that holds each payload exactly once, whoever writes and however often.

Payloads are written below ``attempts/attempt=<id>/prefix=<p and two digits of the key's hash>``; an
attempt counts once its entry stands in the log, whose numbers are created exclusively:
of two writers that commit at the same time one fails, leaves out what the other has
delivered meanwhile, and tries again.  A batch that stands in the log is not delivered
again.  Only the prefixes that a batch touches are read, and the log tells how much was
delivered, so that no call reads the whole sink.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class _Log:
    """Entries of a folder of numbered files on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/log")
        self.system = self.folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def entries(self) -> tuple[list[dict[str, Any]], int]:
        """All whole entries, and the next number.  One that its writer left unfinished counts as a number only."""
        if not self.system.exists(self.folder):
            return [], 0
        found, names = [], sorted(s.getPath().getName() for s in self.system.listStatus(self.folder) if s.getPath().getName().endswith(".json"))
        for name in names:
            stream = self.system.open(self.jvm.org.apache.hadoop.fs.Path(self.folder, name))
            try:
                found.append(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            except ValueError:
                continue
            finally:
                stream.close()
        return found, int(names[-1].removesuffix(".json")) + 1 if names else 0

    def commit(self, number: int, entry: dict[str, Any]) -> bool:
        """Whether this number was free and is now this entry's."""
        try:
            stream = self.system.create(self.jvm.org.apache.hadoop.fs.Path(self.folder, f"{number:012d}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return True


def delivered(spark: SparkSession, path: str) -> int:
    """How many payloads the sink holds."""
    return sum(e["rows"] for e in _Log(spark, path).entries()[0])


def payloads_of(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame | None:
    """Delivered payloads, of some prefixes if given; null if nothing is."""
    folder = f"{path.rstrip('/')}/attempts"
    attempts = [f"{folder}/attempt={e['attempt']}" for e in _Log(spark, path).entries()[0] if e["rows"]]
    if not attempts:
        return None
    held = spark.read.option("basePath", folder).parquet(*attempts).drop("attempt")
    return held if prefixes is None else held.where(F.col("prefix").isin(prefixes))


def deliver(payloads: DataFrame, path: str, batch: str, key: str = "idempotency_key") -> int:
    """Deliver the payloads whose key the sink does not hold yet; how many that were.  The same batch again delivers nothing and returns its first number."""
    spark = payloads.sparkSession
    log = _Log(spark, path)
    own = payloads.dropDuplicates([key]).withColumn("prefix", F.concat(F.lit("p"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2)))
    touched = [r[0] for r in own.select("prefix").distinct().collect()]  # 256 at most
    while True:
        entries, number = log.entries()
        done = next((e for e in entries if e["batch"] == batch), None)
        if done:
            return done["rows"]
        held, seen, attempt = payloads_of(spark, path, touched), Observation(), uuid.uuid4().hex
        fresh = own if held is None else own.join(held.select(key), key, "left_anti")
        fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy("prefix").parquet(f"{path.rstrip('/')}/attempts/attempt={attempt}")
        if log.commit(number, {"batch": batch, "attempt": attempt, "rows": seen.get["rows"]}):
            return seen.get["rows"]


def attempt(payloads: DataFrame, path: str | None, batch: str) -> dict[str, Any]:
    """Deliver and never fail: status not_configured (no sink), sent or failed, with the reason and how many payloads were new."""
    if not path:
        return {"status": "not_configured", "reason": "no sink is set", "rows": 0}
    try:
        return {"status": "sent", "reason": None, "rows": deliver(payloads, path, batch)}
    except (Py4JJavaError, PySparkException) as e:
        return {"status": "failed", "reason": str(e)[:500], "rows": 0}
