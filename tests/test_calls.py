"""Calls by a deadline, limits and budgets as keyed state, and a sink that holds each payload once: replays against batch results."""

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import functions as F

from veridate.operators import limits
from veridate.sources import delivery
from veridate.streaming import calls


def replay(stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def source(spark, folder, schema, *files):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_calls_met_by_a_deadline(spark, tmp_path):
    at = lambda s: (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    requests = source(spark, tmp_path / "r", "doc_id long, asked_at timestamp", [(i, at(i)) for i in range(5)], [(99, at(900))], [(98, at(2000))])
    answer = "doc_id long, answered_at timestamp, value string"
    hunter = source(spark, tmp_path / "h", answer, [(0, at(5), "a"), (1, at(3), "b"), (2, at(60), "late")], [(97, at(900), "x")], [(96, at(2000), "x")])
    mapper = source(spark, tmp_path / "m", answer, [(0, at(9), "A"), (2, at(20), "C"), (4, at(29), "E")], [(97, at(900), "x")], [(96, at(2000), "x")])
    found = {r.doc_id: r for r in replay(calls.met_by_deadline(requests, hunter, mapper), tmp_path).collect()}
    assert {i: (found[i].hunter, found[i].mapper, found[i].codes) for i in range(5)} == {0: ("a", "A", []), 1: ("b", None, ["TIMEOUT"]), 2: (None, "C", ["TIMEOUT"]), 3: (None, None, ["TIMEOUT"]), 4: (None, "E", ["TIMEOUT"])}
    assert (found[1].hunter_ok, found[1].mapper_ok) == (True, False)


def test_limits_equal_batch_and_budget_lasts(spark, tmp_path):
    rows = sorted(((k, 10**9 + t, k * 1000 + n, 30) for k in (1, 2, 3) for n, t in enumerate((0, 10, 20, 7000, 9999, 10000, 10001, 25000, 25001, 60000))), key=lambda r: r[1])
    stream = source(spark, tmp_path / "in", "key long, ts_ms long, seq long, cost long", rows[:17], rows[17:])
    out = replay(calls.held_to_limits(stream, 2, 10000, cap=100), tmp_path).toPandas().sort_values("seq")
    batch = limits.rate_limit(spark.createDataFrame(rows, "key long, ts_ms long, seq long, cost long"), 2, 10000).toPandas().sort_values("seq")
    assert out["seq"].tolist() == batch["seq"].tolist() and out["allowed"].tolist() == batch["allowed"].tolist()
    assert out["retry_after_s"].fillna(-1).tolist() == batch["retry_after_s"].fillna(-1).tolist()
    assert out.groupby("key")["affordable"].sum().tolist() == [3, 3, 3] and not (out["affordable"] & ~out["allowed"]).any()


def test_a_batch_is_delivered_once(spark, tmp_path):
    sink = str(tmp_path / "sink")
    payloads = lambda *keys: spark.createDataFrame([(f"k{i}", i) for i in keys], "idempotency_key string, v long")
    assert delivery.deliver(payloads(1, 2, 1), sink, "b0") == 2
    assert delivery.deliver(payloads(1, 2, 1), sink, "b0") == 2 and delivery.delivered(spark, sink) == 2  # a replay changes nothing
    assert delivery.deliver(payloads(2, 3), sink, "b1") == 1
    (tmp_path / "sink" / "log" / "000000000002.json").write_text("")  # a writer that died while it committed
    assert delivery.deliver(payloads(3, 4), sink, "b2") == 1
    assert sorted(r.v for r in delivery.payloads_of(spark, sink).collect()) == [1, 2, 3, 4]
    assert delivery.deliver(payloads(), sink, "b3") == 0
    assert delivery.attempt(payloads(1), None, "x")["status"] == "not_configured"
    assert delivery.attempt(payloads(9), sink, "b4") == {"status": "sent", "reason": None, "rows": 1}
    assert delivery.attempt(payloads(9), "nowhere://x", "b5")["status"] == "failed"


def test_two_writers_deliver_once(spark, tmp_path):
    sink = str(tmp_path / "sink")
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("idempotency_key"), F.col("id").alias("v"))
    with ThreadPoolExecutor(2) as pool:
        counts = list(pool.map(lambda b: delivery.deliver(rows, sink, b), ["left", "right"]))
    assert sum(counts) == 200 == delivery.delivered(spark, sink) == delivery.payloads_of(spark, sink).select("idempotency_key").distinct().count()
