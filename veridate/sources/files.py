"""Sources and sinks: uploads as binary files, ground truth as CSV, manifests as JSON, and an idempotent delivery sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.sources import delivery

#: File signatures as upper-case hex of the first bytes.
SIGNATURES = [("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("47494638", "image/gif"), ("25504446", "application/pdf"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]
#: Brands of the media container and the image types they stand for; other brands are video.
BRANDS = {"avif": "image/avif", "avis": "image/avif", "mif1": "image/heif", "heic": "image/heic", "heix": "image/heic"}
MAX_BYTES, MOST_PAGES = 4_500_000, 3


def sniff(content: Column) -> Column:
    """Type by the first bytes, never by name; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    out = F
    for start, kind in SIGNATURES:
        out = out.when(head.startswith(start), kind)
    riff = head.startswith("52494646") & head.endswith("57454250")
    out = out.when(riff, "image/webp")
    for brand, kind in BRANDS.items():
        out = out.when((F.substring(head, 9, 8) == "66747970") & (F.substring(head, 17, 8) == brand.encode().hex().upper()), kind)
    return out


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: content hash, type, and why it is rejected (null: accepted); content stays for accepted files only.

    Spark's reader leaves out files of no bytes; the code EMPTY_FILE is for uploads from other sources.
    """
    raw = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > MAX_BYTES, "TOO_LARGE").when(F.col("mime").isNull(), "UNSUPPORTED_TYPE")
    df = raw.select("path", "length", F.sha2("content", 256).alias("content_hash"), sniff(F.col("content")).alias("mime"), "content").withColumn("rejected", reason)
    return df.withColumn("content", F.when(F.col("rejected").isNull(), F.col("content")))


def once_by_content(df: DataFrame, compute, key: str = "content_hash") -> DataFrame:
    """Apply `compute` to one row of each distinct content and give its result to all of them."""
    return df.drop("content").join(compute(df.dropDuplicates([key])), key, "left")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quoted commas and doubled quotes; the word null stands for no date in expected_date only."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.withColumn("expected_date", F.nullif("expected_date", F.lit("null")))


def write_ground_truth(df: DataFrame, path: str) -> None:
    df.withColumn("expected_date", F.coalesce("expected_date", F.lit("null"))).write.csv(path, header=True, quote='"', escape='"')


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_manifest(files: DataFrame, path: str) -> None:
    """One JSON row a file with its name, type, size and content hash, as `manifest` reads it line by line too."""
    files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "mime", F.col("length").alias("bytes"), "content_hash", "rejected").write.json(path)


def pages_to_process(pages: Column, most: int = MOST_PAGES) -> Column:
    """Struct (process, truncated): at least one page and at most `most` are looked at."""
    return F.struct(F.greatest(F.lit(1), F.least(pages, F.lit(most))).alias("process"), (pages > most).alias("truncated"))


def positive_number(text: Column, otherwise: Column) -> Column:
    """A setting that has to be a number above zero, else its default."""
    value = text.try_cast("double")
    return F.when((value > 0) & (value < float("inf")), value).otherwise(otherwise)


def deliver(payloads: DataFrame, path: str, key: str = "idempotency_key") -> int:
    """Append the payloads whose key was not delivered before; returns how many are delivered in all. Delivering twice changes nothing."""
    delivery.deliver(payloads, path, uuid.uuid4().hex, key)
    return delivery.delivered(payloads.sparkSession, path)
