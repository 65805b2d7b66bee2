"""Rasters of pages on a desk, derived from embeddings: outline, rectification, area resampling, quarter turns and tilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.functions import pixels
from veridate.operators import classify
from veridate.plans.orders import read

#: Edges of the derived rasters.
WIDTH, HEIGHT = 32, 28


def _desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of light paper on a dark desk, its place and slant by id, its shades by the embedding; some desks are bare."""
    at = "transform(sequence(0, 895), i -> if(vec_id % 9 > 0 and i div 32 between 3 + vec_id % 4 and 21 + vec_id % 5 and i % 32 - (i div 32) div 8 * (vec_id % 2) between 2 + vec_id % 3 and 24 + vec_id % 3, 190 + floor(abs(embedding[i % 64]) * 100) % 50, 40 + i % 7))"
    rows = read(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    return rows.select("vec_id", F.transform(F.expr(at), lambda v: v.cast("double")).alias("gray"))


def _sized(name: str = "gray") -> tuple[Column, Column, Column]:
    return F.col(name), F.lit(WIDTH), F.lit(HEIGHT)


def document_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the sheet in each raster, how much of it there is, and how far it is from a rectangle."""
    found = _desk(spark, sf_dir).select("vec_id", pixels.document_outline(*_sized()).alias("o"))
    shown = F.array_join(F.transform("o.corners", lambda v: v.cast("int").cast("string")), ",")
    return found.select("vec_id", shown.alias("corners"), F.round("o.coverage", 6).alias("coverage"), F.round("o.contact", 6).alias("contact"), F.col("o.edges").alias("edges"), F.round("o.deviation", 4).alias("deviation"))


def rectified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of each raster that lies straight, cut out through its outline."""
    d = _desk(spark, sf_dir).where("vec_id % 2 = 0").withColumn("o", pixels.document_outline(*_sized()))
    r = d.select("vec_id", pixels.warp(*_sized(), F.col("o.corners")).alias("w"))
    total = F.aggregate("w.gray", F.lit(0.0), lambda a, v: a + v)
    return r.select("vec_id", "w.width", "w.height", total.cast("long").alias("total"), F.get("w.gray", F.lit(0)).cast("int").alias("first"), F.try_element_at("w.gray", F.lit(-1)).cast("int").alias("last"))


def resampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster at half its size, and the middle of it at a quarter of its own."""
    box = F.array(*map(F.lit, (0.25, 0.0, 0.75, 6 / 7)))  # 16 by 24 pixels
    r = _desk(spark, sf_dir).select("vec_id", pixels.resample(*_sized(), 16).alias("h"), pixels.resample(*_sized(), 6, box).alias("q"))
    shown = lambda x: F.sha2(F.array_join(F.transform(x, lambda v: F.round(v * 16).cast("long").cast("string")), ","), 256)
    return r.select("vec_id", F.col("h.width").alias("width"), F.col("h.height").alias("height"), shown("h.gray").alias("half"), F.col("q.width").alias("part_width"), F.col("q.height").alias("part_height"), shown("q.gray").alias("part"))


def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which quarter turn brings a raster's dark corner to the upper left."""
    small = F.transform("embedding", lambda x, i: F.when(i == F.element_at(F.array(*map(F.lit, (0, 7, 63, 56, 20))), (F.col("vec_id") % 5 + 1).cast("int")), 1.0).otherwise(200.0))
    rows = read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", small.alias("gray"))
    probe = lambda gray, width, height: F.when(F.get(gray, F.lit(0)) < 100, classify.aspect(width, height))
    found = rows.select("vec_id", pixels.first_turn(F.col("gray"), F.lit(8), F.lit(8), probe).alias("t"))
    return found.select("vec_id", F.col("t.degrees").alias("degrees"), F.col("t.result").alias("aspect"))


_DESK = """WITH d AS (SELECT vec_id k, embedding e FROM embeddings WHERE len(embedding) = 64),
  p AS (SELECT k, i, i % 32 x, i // 32 y, CASE WHEN k % 9 > 0 AND i // 32 BETWEEN 3 + k % 4 AND 21 + k % 5 AND i % 32 - (i // 32) // 8 * (k % 2) BETWEEN 2 + k % 3 AND 24 + k % 3 THEN 190 + CAST(floor(abs(CAST(e[i % 64 + 1] AS DOUBLE)) * 100) AS BIGINT) % 50 ELSE 40 + i % 7 END g FROM d, (SELECT unnest(range(896)) i))"""
_OUTLINE = """,
  b AS (SELECT k, (list(g ORDER BY g))[count(*) // 2 + 1] bg FROM p WHERE y < 1 OR y >= 27 OR x < 1 OR x >= 31 GROUP BY k),
  m AS (SELECT p.*, abs(g - bg) > 28 paper FROM p JOIN b USING (k)),
  o AS (SELECT k, count(*) FILTER (paper) / 896.0 cover, arg_min(i, (x + y) * 1000 + i) FILTER (paper) tl, arg_min(i, (y - x) * 1000 + i) FILTER (paper) tr, arg_min(i, -(x + y) * 1000 + i) FILTER (paper) br, arg_min(i, (x - y) * 1000 + i) FILTER (paper) bl,
    count(*) FILTER (paper AND y = 0) e0, count(*) FILTER (paper AND y = 27) e1, count(*) FILTER (paper AND x = 0) e2, count(*) FILTER (paper AND x = 31) e3 FROM m GROUP BY k),
  c AS (SELECT *, cover >= 0.05 seen, [tl % 32, tr % 32, br % 32, bl % 32] xs, [tl // 32, tr // 32, br // 32, bl // 32] ys FROM o)"""
_ANGLE = "abs(degrees(acos(greatest(-1.0, least(1.0, ((xs[(j + 2) % 4 + 1] - xs[j]) * (xs[j % 4 + 1] - xs[j]) + (ys[(j + 2) % 4 + 1] - ys[j]) * (ys[j % 4 + 1] - ys[j])) / (sqrt((xs[(j + 2) % 4 + 1] - xs[j]) ** 2 + (ys[(j + 2) % 4 + 1] - ys[j]) ** 2) * sqrt((xs[j % 4 + 1] - xs[j]) ** 2 + (ys[j % 4 + 1] - ys[j]) ** 2)))))) - 90)"
_BOX = "(SELECT k, i, x, y, g FROM p WHERE x BETWEEN 8 AND 23 AND y BETWEEN 0 AND 23)"

QUERIES = {f.__name__: f for f in (document_outlines, rectified_pages, resampled_pages, page_turns)}
ORACLES = {
    "document_outlines": f"""{_DESK}{_OUTLINE} SELECT k vec_id, CASE WHEN seen THEN concat_ws(',', xs[1], ys[1], xs[2], ys[2], xs[3], ys[3], xs[4], ys[4]) END corners, CASE WHEN seen THEN CAST(round(cover, 6) AS DOUBLE) END coverage, CASE WHEN seen THEN CAST(round((e0 + e1 + e2 + e3) / 120.0, 6) AS DOUBLE) END contact,
      CASE WHEN seen THEN CAST(e0 > 19.2 AS INTEGER) + CAST(e1 > 19.2 AS INTEGER) + CAST(e2 > 16.8 AS INTEGER) + CAST(e3 > 16.8 AS INTEGER) END edges, CASE WHEN seen THEN round(list_max(list_transform([1, 2, 3, 4], lambda j: {_ANGLE})), 4) END deviation FROM c""",
    "rectified_pages": f"""{_DESK}, s AS (SELECT k, min(x) FILTER (g > 100) l, min(y) FILTER (g > 100) t, max(x) FILTER (g > 100) - min(x) FILTER (g > 100) w, max(y) FILTER (g > 100) - min(y) FILTER (g > 100) h, list(g ORDER BY i) gs FROM p WHERE k % 2 = 0 GROUP BY k),
      f AS (SELECT k, l, t, w, h, gs, unnest(range(w * h)) j FROM s WHERE w IS NOT NULL),
      a AS (SELECT k, w, h, j, gs, round(l + j % w * w / CAST(w - 1 AS DOUBLE), 9) x, round(t + j // w * h / CAST(h - 1 AS DOUBLE), 9) y FROM f),
      n AS (SELECT *, CAST(floor(x) AS BIGINT) x0, CAST(floor(y) AS BIGINT) y0, x - floor(x) fx, y - floor(y) fy FROM a),
      v AS (SELECT k, w, h, j, floor((gs[y0 * 32 + x0 + 1] * (1 - fx) + gs[y0 * 32 + least(31, x0 + 1) + 1] * fx) * (1 - fy) + (gs[least(27, y0 + 1) * 32 + x0 + 1] * (1 - fx) + gs[least(27, y0 + 1) * 32 + least(31, x0 + 1) + 1] * fx) * fy + 0.000001) g FROM n),
      r AS (SELECT k, CAST(max(w) AS INTEGER) width, CAST(max(h) AS INTEGER) height, CAST(sum(g) AS BIGINT) total, CAST(arg_min(g, j) AS INTEGER) AS "first", CAST(arg_max(g, j) AS INTEGER) AS "last" FROM v GROUP BY k)
      SELECT d.k vec_id, width, height, total, "first", "last" FROM d LEFT JOIN r USING (k) WHERE d.k % 2 = 0""",
    "resampled_pages": f"""{_DESK}, h AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY a, b)) half FROM (SELECT k, y // 2 a, x // 2 b, CAST(sum(g) * 4 AS BIGINT) v FROM p GROUP BY ALL) GROUP BY k),
      q AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY a, b)) part FROM (SELECT k, y // 4 a, (x - 8) // 4 b, CAST(sum(g) AS BIGINT) v FROM {_BOX} GROUP BY ALL) GROUP BY k)
      SELECT k vec_id, CAST(16 AS INTEGER) width, CAST(14 AS INTEGER) height, half, CAST(4 AS INTEGER) part_width, CAST(6 AS INTEGER) part_height, part FROM h JOIN q USING (k)""",
    "page_turns": """SELECT vec_id, CAST(CASE vec_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 270 WHEN 2 THEN 180 WHEN 3 THEN 90 END AS INTEGER) degrees, CAST(CASE WHEN vec_id % 5 < 4 THEN 1 END AS DOUBLE) aspect FROM embeddings WHERE len(embedding) = 64""",
}
