"""Uploads, settings and calls at the edge of the engine, and where a zone may stand, over inputs derived from documents, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.functions import answers, pixels, text
from veridate.operators import evaluate, pages, twocalls
from veridate.plans.orders import pick, read
from veridate.sources import files

_HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "255044462D312E37", "424D0000", "49492A00", "524946460000000057454250", "000000186674797061766966", "0000001866747970686569630000", "000000186674797069736F6D", "504B0304", ""]


def upload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of twelve kinds of bytes: type by the first of them, size, content hash and why some are turned away."""
    k = F.col("doc_id")
    body = F.concat(F.unhex(pick(_HEADS, k % 12)), F.when(k % 12 != 11, k.cast("string").cast("binary")).otherwise(F.lit(b"")))
    raw = read(spark, sf_dir, "documents").select(k, body.alias("content"))
    kinds = raw.select("doc_id", files.sniff(F.col("content")).alias("mime"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("content_hash"))
    return kinds.withColumn("rejected", F.when(F.col("bytes") == 0, "EMPTY_FILE").when(F.col("mime").isNull(), "UNSUPPORTED_TYPE"))


def call_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request and its calls come to: client, kind of error, budget, pages that are looked at, a setting and its default, dollars of a reviewer's minutes."""
    k = F.col("c_custkey")
    forwarded = F.when(k % 3 == 0, F.concat(F.lit("10.0.0."), (k % 250).cast("string"), F.lit(", 10.9.9.9"))).when(k % 3 == 1, F.lit(""))
    status, name = pick(["429", "408", "500", "0", "503"], k % 5).cast("int"), pick(["RateLimitError", "Error", "APITimeoutError", "AbortError", "InternalServerError"], k % 5)
    p = files.pages_to_process((k % 7).cast("int"))
    rows = read(spark, sf_dir, "customer")
    return rows.select(
        k.alias("doc_id"), text.client_ip(forwarded, F.when(k % 2 == 0, F.lit(" 192.168.0.1 "))).alias("client"), twocalls.error_kind(status, name).alias("error"),
        twocalls.within_budget((k % 10) / 100.0, F.lit(0.05), F.when(k % 4 != 0, F.lit(0.1))).alias("affordable"), p["process"].alias("pages"), p["truncated"].alias("truncated"),
        files.positive_number(pick(["2.5", "-3", "x", "0", "1e3", "Infinity"], k % 6), F.lit(30.0)).alias("setting"), F.round(evaluate.minutes_to_dollars((k % 90).cast("double"), F.lit(30.0)), 4).alias("dollars"),
    )


def zone_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a machine-readable zone may stand on a page of three lines, of which one or two have a zone's length and alphabet."""
    k = F.col("c_custkey")
    box = lambda x0, y0, x1, y1: F.array(*(v if not isinstance(v, float) else F.lit(v) for v in (x0, y0, x1, y1)))
    zone = F.rpad(F.concat(F.lit("P<GBR"), k.cast("string")), 44, "<")
    lines = F.array(F.struct(F.lit("UNITED KINGDOM").alias("text"), box(0.0, 0.0, 1.0, 0.1).alias("bbox")), F.struct(zone.alias("text"), box(0.1 + (k % 5) / 100.0, 0.7, 0.9, 0.75).alias("bbox")), F.struct(F.when(k % 3 == 0, F.rpad(F.lit("no zone at all"), 44, "?")).otherwise(zone).alias("text"), box(0.05, 0.76, 0.8 + (k % 7) / 100.0, 0.9 + (k % 2) / 10.0).alias("bbox")))
    rows = read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.explode(lines).alias("l")).select("doc_id", "l.text", "l.bbox")
    side = lambda i: F.round(F.get("area", F.lit(i)), 6)
    return pages.zone_area(rows).select("doc_id", side(0).alias("x0"), side(1).alias("y0"), side(2).alias("x1"), side(3).alias("y1"))


def page_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners and the middle of an upright page, taken to the quadrilateral that it appears as."""
    k = F.col("vec_id")
    corners = F.array(*(v.cast("double") for v in (k % 5, k % 3, 90 + k % 7, k % 4, 95 + k % 3, 60 + k % 5, 2 + k % 2, 55 + k % 6)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", pixels.inverse_homography(corners, F.lit(80), F.lit(50)).alias("m"))
    at = lambda i, u, v: F.get("m", F.lit(3 * i)) * u + F.get("m", F.lit(3 * i + 1)) * v + F.get("m", F.lit(3 * i + 2))
    shown = [F.concat_ws(":", *(F.format_string("%.3f", F.round(at(i, u, v) / at(2, u, v), 6) + 0.0) for i in (0, 1))) for u, v in ((0, 0), (80, 0), (80, 50), (0, 50))]
    return rows.select("vec_id", F.concat_ws(";", *shown).alias("corners"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' answers about each customer as JSON text, most of them cut short, of the wrong form or not JSON: what can be used of them."""
    k = F.col("c_custkey")
    date = F.date_format(F.date_add(F.lit("1999-01-13").cast("date"), (k * 31 % 300).cast("int")), "MM/dd/yyyy")
    hunter = F.concat(F.lit('{"expiry_raw": '), F.when(k % 5 == 0, F.lit("null")).when(k % 5 == 1, F.lit("5")).otherwise(F.concat(F.lit('"'), date, F.lit('"'))), F.lit(', "label_verbatim": null, "neighbouring_text": "near", "reasoning": "r"'), F.when(k % 5 == 2, ', "more": 1}').when(k % 5 == 3, "").otherwise("}"))
    entry = F.concat(F.lit('{"raw": "'), date, F.lit('", "label_verbatim": "EXP", "neighbouring_text": null, "inferred_role": "'), F.when(k % 7 == 1, "LATER").otherwise("EXPIRY"), F.lit('", "illegible": '), F.when(k % 7 == 2, '"no"').otherwise("true"), F.lit("}"))
    dates = F.when(k % 7 == 3, F.lit("[]")).when(k % 7 == 4, F.concat(F.lit("["), entry, F.lit(', {"raw": "x"}]'))).otherwise(F.concat(F.lit("["), entry, F.lit("]")))
    mapper = F.concat(F.lit('{"dates": '), dates, F.lit(', "document_type": '), F.when(k % 7 == 5, '"INVOICE"').when(k % 2 == 0, '"PASSPORT"').otherwise("null"), F.lit(', "issuing_authority": null, "contains_instruction_like_text": '), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("}"))
    rows = read(spark, sf_dir, "customer").select(k.alias("doc_id"), answers.hunter_answer(F.when(k % 11 != 0, hunter)).alias("h"), answers.mapper_answer(answers.latin_text(mapper.cast("binary"))).alias("m"))
    told = F.array_join(F.transform("m.dates", lambda d: F.concat_ws(":", d["role"], d["raw"], d["illegible"].cast("string"), d["label"])), ";")
    return rows.select("doc_id", F.col("h").isNotNull().alias("hunter_ok"), "h.expiry_raw", F.col("h.snippet").alias("snippet"), F.col("m").isNotNull().alias("mapper_ok"), told.alias("dates"), F.col("m.kind").alias("kind"), F.col("m.injected").alias("injected"))


QUERIES = {f.__name__: f for f in (model_answers, upload_manifest, call_settings, zone_areas, page_corners)}
ORACLES = {
    "model_answers": """WITH c AS (SELECT c_custkey k, strftime(CAST(DATE '1999-01-13' + CAST(c_custkey * 31 % 300 AS INTEGER) AS DATE), '%m/%d/%Y') d, c_custkey % 11 <> 0 AND c_custkey % 5 IN (0, 4) h, c_custkey % 7 IN (0, 3, 6) m FROM customer)
      SELECT k doc_id, h hunter_ok, CASE WHEN h AND k % 5 = 4 THEN d END expiry_raw, CASE WHEN h THEN 'near' END snippet, m mapper_ok, CASE WHEN m THEN CASE WHEN k % 7 = 3 THEN '' ELSE 'EXPIRY:' || d || ':true:EXP' END END dates, CASE WHEN m AND k % 2 = 0 THEN 'PASSPORT' END kind, CASE WHEN m THEN k % 3 = 0 END injected FROM c""",
    "upload_manifest": """WITH d AS (SELECT doc_id, unhex((['FFD8FFE0', '89504E470D0A1A0A', '474946383961', '255044462D312E37', '424D0000', '49492A00', '524946460000000057454250', '000000186674797061766966', '0000001866747970686569630000', '000000186674797069736F6D', '504B0304', ''])[CAST(doc_id % 12 AS INTEGER) + 1]) || CASE WHEN doc_id % 12 <> 11 THEN CAST(CAST(doc_id AS VARCHAR) AS BLOB) ELSE CAST('' AS BLOB) END content FROM documents)
      SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'image/bmp' WHEN 5 THEN 'image/tiff' WHEN 6 THEN 'image/webp' WHEN 7 THEN 'image/avif' WHEN 8 THEN 'image/heic' END mime,
        octet_length(content) bytes, sha256(content) content_hash, CASE WHEN doc_id % 12 = 11 THEN 'EMPTY_FILE' WHEN doc_id % 12 > 8 THEN 'UNSUPPORTED_TYPE' END rejected FROM d""",
    "call_settings": """SELECT c_custkey doc_id, CASE WHEN c_custkey % 3 = 0 THEN '10.0.0.' || CAST(c_custkey % 250 AS VARCHAR) WHEN c_custkey % 2 = 0 THEN '192.168.0.1' ELSE 'unknown' END client, CASE c_custkey % 5 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'timeout' WHEN 2 THEN 'timeout' WHEN 3 THEN 'aborted' ELSE 'unavailable' END error,
      c_custkey % 4 = 0 OR c_custkey % 10 <= 5 affordable, CAST(greatest(1, least(c_custkey % 7, 3)) AS INTEGER) pages, c_custkey % 7 > 3 truncated, CAST(CASE c_custkey % 6 WHEN 0 THEN 2.5 WHEN 4 THEN 1000 ELSE 30 END AS DOUBLE) setting, CAST(round(c_custkey % 90 / 60.0 * 30, 4) AS DOUBLE) dollars FROM customer""",
    "zone_areas": """SELECT c_custkey doc_id, CAST(round(CASE WHEN c_custkey % 3 = 0 THEN 0.1 + c_custkey % 5 / 100.0 ELSE 0.05 END - 0.03, 6) AS DOUBLE) x0, CAST(0.15 AS DOUBLE) y0, CAST(round(least(1, CASE WHEN c_custkey % 3 = 0 THEN 0.9 ELSE greatest(0.9, 0.8 + c_custkey % 7 / 100.0) END + 0.03), 6) AS DOUBLE) x1,
      CAST(round(least(1, CASE WHEN c_custkey % 3 = 0 THEN 0.75 ELSE 0.9 + c_custkey % 2 / 10.0 END + 0.03), 6) AS DOUBLE) y1 FROM customer""",
    "page_corners": """SELECT vec_id, concat_ws(';', printf('%d.000:%d.000', vec_id % 5, vec_id % 3), printf('%d.000:%d.000', 90 + vec_id % 7, vec_id % 4), printf('%d.000:%d.000', 95 + vec_id % 3, 60 + vec_id % 5), printf('%d.000:%d.000', 2 + vec_id % 2, 55 + vec_id % 6)) corners FROM embeddings""",
}
