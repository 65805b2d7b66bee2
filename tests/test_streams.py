"""The event stream from a single file and from a folder of part files."""

from veridate.plans import streams
from veridate.streaming import intake

DATA = "/root/testdata/sf0.001"


def test_events_of_part_files(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    whole = sorted(map(tuple, streams.event_windows(spark, DATA).collect()))
    assert whole and sorted(map(tuple, streams.event_windows(spark, str(tmp_path)).collect())) == whole


def test_limits_as_state(spark, tmp_path):
    rows = [(1, 0, 1), (1, 10, 2), (1, 20, 3), (2, 5, 4), (1, 7000, 5), (1, 10000, 6)]
    spark.createDataFrame(rows, "key long, ts_ms long, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts_ms long, seq long").parquet(str(tmp_path / "in"))
    query = intake.limited(stream, 2, 10000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 6]
