import pandas as pd
from pyspark.sql import functions as F

from veridate.operators import limits
from veridate.sources import files


def test_uploads(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 20
    for name, data in (("a.docx", png), ("b.png", png), ("c.jpg", b"PK\x03\x04zip"), ("e.heic", b"\0\0\0\x18ftypheic....")):
        (tmp_path / name).write_bytes(data)
    df = files.uploads(spark, str(tmp_path))
    found = {r.path[-6:]: (r.mime, r.rejected) for r in df.collect()}
    assert found["a.docx"] == found["/b.png"] == ("image/png", None)
    assert found["/c.jpg"] == (None, "UNSUPPORTED_TYPE") and found["e.heic"][0] == "image/heic"
    for brand, kind in ((b"avif", "image/avif"), (b"mif1", "image/heif"), (b"isom", None), (b"mp42", None)):
        r = spark.createDataFrame([(b"\0\0\0\x18ftyp" + brand + b"....",)], "c binary").select(files.sniff(F.col("c")).alias("m")).first()
        assert r.m == kind
    files.write_manifest(df, str(tmp_path / "manifest"))
    assert {(r.filename, r.mime) for r in spark.read.json(str(tmp_path / "manifest")).collect()} >= {("b.png", "image/png"), ("c.jpg", None)}
    r = spark.range(1).select(*(files.pages_to_process(F.lit(n)).alias(f"p{n}") for n in (0, 2, 9)), files.positive_number(F.lit("2.5"), F.lit(1.0)).alias("a"), files.positive_number(F.lit("-3"), F.lit(1.0)).alias("b"), files.positive_number(F.lit("x"), F.lit(1.0)).alias("c")).first()
    assert [tuple(r[f"p{n}"]) for n in (0, 2, 9)] == [(1, False), (2, False), (3, True)] and (r.a, r.b, r.c) == (2.5, 1.0, 1.0)
    once = files.once_by_content(df.where("rejected is null"), lambda d: d.selectExpr("content_hash", "length(content) n"))
    assert sorted(r.n for r in once.collect()) == [16, 28, 28]


def test_ground_truth_and_delivery(spark, tmp_path):
    rows = [("a.png", "2029-11-14", 'says "x", twice'), ("b.png", None, "null")]
    df = spark.createDataFrame(rows, "filename string, expected_date string, notes string")
    files.write_ground_truth(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.ground_truth(spark, str(tmp_path / "t")).collect())) == sorted(rows)
    sink = str(tmp_path / "sink")
    p = spark.createDataFrame([("k1", 1), ("k2", 2), ("k1", 1)], "idempotency_key string, v int")
    assert files.deliver(p, sink) == 2 and files.deliver(p, sink) == 2


def test_rate_limit(spark):
    rows = [(1, 0, 1), (1, 10, 2), (1, 20, 3), (2, 5, 4), (1, 7000, 5), (1, 10000, 6)]
    out = limits.rate_limit(spark.createDataFrame(rows, "key long, ts_ms long, seq long"), 2, 10000).toPandas().set_index("seq")
    assert out.allowed.to_dict() == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
    assert out.retry_after_s[5] == 3 and pd.isna(out.retry_after_s[1])
