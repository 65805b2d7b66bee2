"""Evidence, comparison and report queries over documents, pages, parts, customers, conversations, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.functions import text
from veridate.operators import classify, gate, layout, limits, metrics
from veridate.plans.orders import pick, read

TERMS = [t for _, _, terms in classify.KEYWORDS for t in terms]


def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best classes of each document by keyword score; one to three terms are appended by doc_id."""
    k = F.col("doc_id")
    terms = F.concat_ws(" ", pick(TERMS, k % len(TERMS)), pick(TERMS, k * 7 % len(TERMS)), F.when(k % 3 == 0, pick(TERMS, k * 11 % len(TERMS))))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), terms).alias("text"))
    top = docs.select("doc_id", F.posexplode(F.slice(classify.keyword_scores(classify.keyword_hits(F.col("text"))), 1, 3)).alias("pos", "c"))
    return top.select("doc_id", (F.col("pos") + 1).alias("rank"), F.col("c.class").alias("class"), (-F.col("c.less")).alias("score"))


def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, resolution and screen size of images with sizes derived from parts."""
    k = F.col("p_partkey")
    width = F.when(k % 10 == 0, F.element_at(F.array(*(F.lit(w) for w, _ in classify.SCREENS)), (k / 10 % 22).cast("int") + 1)).otherwise(600 + k * 37 % 1900).cast("int")
    high = F.when(k % 10 == 0, F.element_at(F.array(*(F.lit(h) for _, h in classify.SCREENS)), (k / 10 % 22).cast("int") + 1)).otherwise(400 + k * 53 % 2100).cast("int")
    d = read(spark, sf_dir, "part").select(k.alias("doc_id"), width.alias("width"), high.alias("height"), (k * 997 % 90000).alias("bytes"))
    w, h = F.col("width"), F.col("height")
    return d.select("doc_id", "width", "height", classify.shape(w, h).alias("shape"), classify.effective_dpi(w, h).alias("dpi"), classify.screen_sized(w, h).alias("screen"), classify.too_low_resolution(w, h, F.col("bytes")).alias("too_low"))


def script_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of Latin and other scripts in each document; some get Cyrillic, Hangul and Syriac words, many times."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.repeat(F.lit(" СРОК ДЕЙСТВИЯ 한국 ܫܠܡܐ"), (F.col("doc_id") % 90 + 1).cast("int")))).otherwise(F.col("text")).alias("text"))
    p = docs.select("doc_id", text.latin_letters(F.col("text")).alias("latin"), text.other_letters(F.col("text")).alias("other"), text.non_latin_dominant(F.col("text")).alias("dominant"))
    return p.withColumn("unsupported", text.unsupported_script(F.col("latin"), F.col("other")))


def page_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of web pages without tags, and whether the number in the address stands in it."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " "), r"\s+", " "))
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("number"), plain.alias("plain"))
    return p.select("page_id", "number", F.length("plain").alias("n_chars"), text.grounded(F.col("number"), F.col("plain")).alias("grounded"))


def cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine-read against printed dates of customers: agreements, mismatches and the confidence that is left."""
    k = F.col("c_custkey")
    day = lambda start, step, span: F.date_add(F.lit(start).cast("date"), (k * step % span).cast("int"))
    machine = {"expiry": day("1998-01-01", 13, 4000), "issue": day("1990-01-01", 7, 2000), "dob": day("1940-01-01", 37, 15000)}
    printed = {r: F.when(k % n == 0, None).when(k % m == 0, F.date_add(d, 1)).otherwise(d) for (r, d), n, m in zip(machine.items(), (11, 6, 8), (9, 10, 14), strict=True)}
    pairs = F.array(*(F.struct(F.lit(r).alias("role"), machine[r].alias("machine"), printed[r].alias("printed")) for r in machine))
    rows = read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.filter(pairs, lambda p: p["machine"].isNotNull() & p["printed"].isNotNull()).alias("p"))
    c = rows.select("doc_id", F.size(F.filter("p", lambda p: p["machine"] == p["printed"])).alias("agreed"), F.array_join(F.transform(F.filter("p", lambda p: p["machine"] != p["printed"]), lambda p: p["role"]), ";").alias("mismatched"))
    return c.withColumn("confidence", F.when(F.col("mismatched") != "", 0.5).when(F.col("agreed") > 0, 0.995).otherwise(0.99))


def two_call_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value from one model call against the inventory of another: corroborated, contradicted, or alone."""
    date = lambda n: F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    turns = read(spark, sf_dir, "conversations")
    hunter = turns.where("turn = 0").select("conv_id", date(F.col("conv_id") % 1000).alias("value")).distinct()
    mapper = turns.where("role = 'assistant'").select("conv_id", "turn", date((F.col("conv_id") + F.floor(F.col("turn") / 2) * 7 * (F.col("conv_id") % 3) + (F.col("conv_id") % 4 == 0).cast("int")) % 1000).alias("found"))
    inventory = mapper.groupBy("conv_id").agg(F.count(F.lit(1)).alias("entries"), F.collect_set(F.regexp_replace("found", "[^0-9A-Za-z]", "")).alias("keys"))
    met = hunter.join(inventory, "conv_id", "left")
    agrees = F.array_contains("keys", F.regexp_replace("value", "[^0-9A-Za-z]", ""))
    return met.select("conv_id", "value", F.coalesce("entries", F.lit(0)).alias("entries"), F.when(F.col("keys").isNull(), "UNCORROBORATED").when(agrees, "AGREE").otherwise("DISAGREE").alias("outcome"), F.when(F.col("keys").isNull(), 0.5).when(agrees, 0.85).otherwise(0.15).alias("confidence"))


def accuracy_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy over nine confidence thresholds."""
    scored = read(spark, sf_dir, "labels").select((F.col("doc_id") * 7919 % 1000 / 1000.0).alias("confidence"), (F.col("quality") == 1).alias("correct"))
    return metrics.accuracy_at_coverage(scored)


def coverage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest threshold that still answers two fifths."""
    return metrics.point_at_coverage(accuracy_at_coverage(spark, sf_dir), 0.4)


def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of model use by event type, and reviewer minutes that as many documents would take."""
    v = F.round(F.abs("value") * 100).cast("long")
    e = read(spark, sf_dir, "events").select("event_type", v.alias("i"), (v % 800).alias("o"), F.when(F.col("event_id") % 3 == 0, v % 500).alias("w"), F.when(F.col("event_id") % 5 == 0, v % 900).alias("r"))
    sums = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(c) for c in "iowr"))
    cost = metrics.cost_usd(F.col("i"), F.col("o"), F.col("w"), F.col("r"), F.lit(5.0), F.lit(25.0))
    return sums.select("event_type", "documents", F.round(cost, 6).alias("usd"), F.round(F.col("documents") * 480 / 30.0, 4).alias("minutes_low"), F.round(F.col("documents") * 480 / 20.0, 4).alias("minutes_high"))


def admission_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings taken as 8 by 8 gray images: brightness, ink, bands of text, sharpness, and whether the gate turns them away."""
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + x.cast("double") * 400).cast("double"))))
    e = read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", gray.alias("gray"))
    e = e.withColumn("l", gate.luminance(F.col("gray"))).withColumn("rows", gate.row_ink(F.col("gray"), 8, 8, F.col("l.mean") - 0.5 * F.col("l.stddev")))
    e = e.withColumns({"bands": gate.text_bands(F.col("rows")), "ink": gate.total(F.col("rows")) / 8, "sharpness": gate.laplacian_variance(F.col("gray"), 8, 8)})
    turned = gate.likely_no_document(F.col("bands"), F.col("l.stddev"), F.col("ink"), F.lit(False))
    return e.select("vec_id", F.round("l.mean", 4).alias("mean"), F.round("l.stddev", 4).alias("stddev"), F.round("ink", 6).alias("ink"), "bands", F.round("sharpness", 3).alias("sharpness"), turned.alias("turned_away"))


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests of a user in six hours from the first one; the rest wait."""
    requests = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"))
    return limits.rate_limit(requests, 3, 6 * 3600 * 1000)


def label_value_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines of an order as labels, even ones as values, in boxes derived from keys; each label's nearest admissible value."""
    x, y = (F.col("l_partkey") * 31 % 900).cast("double"), (F.col("l_suppkey") * 17 % 400).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 60 + F.col("l_partkey") % 50).alias("x1"), (y + 30).alias("y1"))
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("ord"), box.alias("box"), (F.col("l_linenumber") % 2 == 1).alias("odd")).distinct()
    labels = own.where("odd").select("doc_id", F.col("ord").alias("label_ord"), F.col("box").alias("label"))
    values = own.where("not odd").select("doc_id", F.col("ord").alias("value_ord"), F.col("box").alias("value"), F.lit(90.0).alias("confidence"))
    return layout.bind(labels, values).withColumn("distance", F.round("distance", 6))


_KEY = ", ".join("({}, '{}', {}, '{}')".format([n for n in dict.fromkeys(c for c, _, _ in classify.KEYWORDS)].index(c), c, w, t.replace("'", "''")) for c, w, ts in classify.KEYWORDS for t in ts)
_TERMS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TERMS) + "]"
_N = len(TERMS)
_W, _H = ([s[i] for s in classify.SCREENS] for i in (0, 1))

QUERIES = {f.__name__: f for f in (keyword_classes, page_shapes, script_profiles, page_grounding, cross_checks, two_call_merge, accuracy_at_coverage, coverage_point, usage_costs, admission_figures, rate_limits, label_value_bindings)}
_CURVE = """WITH s AS (SELECT doc_id * 7919 % 1000 / 1000.0 c, quality = 1 ok FROM labels), t(threshold) AS (SELECT CAST(x AS DOUBLE) FROM (VALUES (0.5), (0.6), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95), (0.99)) v(x)),
  p AS (SELECT threshold, count(*) n, count(*) FILTER (c >= threshold) a, count(*) FILTER (c >= threshold AND ok) r FROM s CROSS JOIN t GROUP BY threshold),
  curve AS (SELECT threshold, a answered, round(a / n, 6) coverage, round(CASE WHEN a > 0 THEN r / a ELSE 1 END, 6) accuracy, a - r confident_wrong FROM p)"""
ORACLES = {
    "keyword_classes": f"""WITH k(o, "class", w, t) AS (VALUES {_KEY}), d AS (SELECT doc_id, lower(text || ' ' || concat_ws(' ', ({_TERMS})[CAST(doc_id % {_N} AS INTEGER) + 1], ({_TERMS})[CAST(doc_id * 7 % {_N} AS INTEGER) + 1], CASE WHEN doc_id % 3 = 0 THEN ({_TERMS})[CAST(doc_id * 11 % {_N} AS INTEGER) + 1] END)) x FROM documents),
      s AS (SELECT doc_id, "class", o, CAST(round(sum(w), 6) AS DOUBLE) score FROM d JOIN k ON contains(x, t) GROUP BY ALL)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS INTEGER) AS "rank", "class", score FROM s QUALIFY "rank" <= 3""",
    "page_shapes": f"""WITH d AS (SELECT p_partkey doc_id, CAST(CASE WHEN p_partkey % 10 = 0 THEN ({_W})[CAST(p_partkey // 10 % 22 AS INTEGER) + 1] ELSE 600 + p_partkey * 37 % 1900 END AS INTEGER) width, CAST(CASE WHEN p_partkey % 10 = 0 THEN ({_H})[CAST(p_partkey // 10 % 22 AS INTEGER) + 1] ELSE 400 + p_partkey * 53 % 2100 END AS INTEGER) height, p_partkey * 997 % 90000 b FROM part),
      a AS (SELECT *, greatest(width, height) / CAST(least(width, height) AS DOUBLE) r, greatest(width, height) l FROM d),
      g AS (SELECT *, CAST(floor(l / CAST(CASE WHEN r BETWEEN 1.45 AND 1.75 THEN 3.37 WHEN r >= 1.3 AND r < 1.45 THEN 4.92 ELSE 11 END AS DOUBLE) + 0.5) AS INTEGER) dpi FROM a),
      z AS (SELECT unnest({_W}) w, unnest({_H}) h)
      SELECT doc_id, width, height, CASE WHEN abs(r - CAST(85.6 AS DOUBLE) / 54) <= CAST(0.14 AS DOUBLE) THEN 'ID1_CARD' WHEN r BETWEEN 1.25 AND 1.47 THEN 'PAPER' WHEN r < 1.1 THEN 'SQUARE' ELSE 'UNUSUAL' END shape, dpi,
        EXISTS (SELECT 1 FROM z WHERE (abs(width - w) <= 2 AND abs(height - h) <= 2) OR (abs(width - h) <= 2 AND abs(height - w) <= 2)) screen, b < 51200 AND dpi < 150 too_low FROM g""",
    "script_profiles": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || repeat(' СРОК ДЕЙСТВИЯ 한국 ܫܠܡܐ', CAST(doc_id % 90 + 1 AS INTEGER)) ELSE text END x FROM documents),
      c AS (SELECT doc_id, CAST(length(regexp_replace(x, '[^A-Za-z\x{c0}-\x{24f}]', '', 'g')) AS INTEGER) latin,
        CAST(length(regexp_replace(x, '[^\x{370}-\x{3ff}\x{400}-\x{52f}\x{530}-\x{58f}\x{590}-\x{5ff}\x{600}-\x{6ff}\x{700}-\x{74f}\x{750}-\x{77f}\x{900}-\x{97f}\x{980}-\x{dff}\x{e00}-\x{e7f}\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]', '', 'g')) AS INTEGER) other,
        length(regexp_replace(x, '[\x{0}-\x{36f}]', '', 'g')) beyond, length(regexp_replace(x, '[^0-\x{24f}]', '', 'g')) near FROM d)
      SELECT doc_id, latin, other, beyond + near > 0 AND beyond / CAST(greatest(beyond + near, 1) AS DOUBLE) >= 0.3 dominant, latin + other >= 3 AND other / CAST(greatest(latin + other, 1) AS DOUBLE) >= 0.3 unsupported FROM c""",
    "page_grounding": r"""WITH p AS (SELECT page_id, regexp_extract(url, '/(\d+)', 1) number, trim(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) plain FROM pages)
      SELECT page_id, number, CAST(length(plain) AS INTEGER) n_chars, number <> '' AND contains(regexp_replace(plain, '[^0-9]', '', 'g'), number) grounded FROM p""",
    "cross_checks": """WITH c AS (SELECT c_custkey doc_id, [c_custkey % 11 <> 0, c_custkey % 6 <> 0, c_custkey % 8 <> 0] there, [c_custkey % 9 = 0, c_custkey % 10 = 0, c_custkey % 14 = 0] off FROM customer),
      r AS (SELECT doc_id, list_filter([1, 2, 3], lambda i: there[i] AND NOT off[i]) ok, list_filter([1, 2, 3], lambda i: there[i] AND off[i]) bad FROM c)
      SELECT doc_id, CAST(len(ok) AS INTEGER) agreed, array_to_string(list_transform(bad, lambda i: (['expiry', 'issue', 'dob'])[i]), ';') mismatched, CAST(CASE WHEN len(bad) > 0 THEN 0.5 WHEN len(ok) > 0 THEN 0.995 ELSE 0.99 END AS DOUBLE) confidence FROM r""",
    "two_call_merge": """WITH h AS (SELECT DISTINCT conv_id, conv_id % 1000 v FROM conversations WHERE turn = 0), m AS (SELECT conv_id, (conv_id + turn // 2 * 7 * (conv_id % 3) + CAST(conv_id % 4 = 0 AS INTEGER)) % 1000 f FROM conversations WHERE "role" = 'assistant'),
      j AS (SELECT h.conv_id, v, count(f) entries, coalesce(bool_or(f = v), false) ok FROM h LEFT JOIN m USING (conv_id) GROUP BY ALL)
      SELECT conv_id, strftime(DATE '1998-01-01' + CAST(v AS INTEGER), '%Y-%m-%d') AS "value", entries, CASE WHEN entries = 0 THEN 'UNCORROBORATED' WHEN ok THEN 'AGREE' ELSE 'DISAGREE' END outcome, CAST(CASE WHEN entries = 0 THEN 0.5 WHEN ok THEN 0.85 ELSE 0.15 END AS DOUBLE) confidence FROM j""",
    "accuracy_at_coverage": f"{_CURVE} SELECT * FROM curve",
    "coverage_point": f"{_CURVE} SELECT * FROM curve WHERE coverage >= 0.4 ORDER BY threshold DESC LIMIT 1",
    "usage_costs": """WITH e AS (SELECT event_type, event_id, CAST(round(abs("value") * 100) AS BIGINT) v FROM events), s AS (SELECT event_type, count(*) documents, sum(v) i, sum(v % 800) o, sum(v % 500) FILTER (event_id % 3 = 0) w, sum(v % 900) FILTER (event_id % 5 = 0) r FROM e GROUP BY event_type)
      SELECT event_type, documents, CAST(round((i * 5.0 + o * 25.0 + coalesce(w, 0) * 6.25 + coalesce(r, 0) * 0.5) / 1e6, 6) AS DOUBLE) usd, CAST(round(documents * 16.0, 4) AS DOUBLE) minutes_low, CAST(round(documents * 24.0, 4) AS DOUBLE) minutes_high FROM s""",
    "admission_figures": """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0.0, least(255.0, floor(128 + CAST(x AS DOUBLE) * 400)))) g FROM embeddings WHERE len(embedding) = 64),
      l AS (SELECT *, list_sum(g) / 64 m, sqrt(greatest(list_sum(list_transform(g, lambda x: x * x)) / 64 - (list_sum(g) / 64) * (list_sum(g) / 64), 0)) s FROM g),
      r AS (SELECT *, list_transform(range(0, 8), lambda i: len(list_filter(g[i * 8 + 1 : i * 8 + 8], lambda x: x < m - 0.5 * s)) / CAST(8 AS DOUBLE)) ink_rows, list_transform(list_filter(range(0, 64), lambda i: i % 8 BETWEEN 1 AND 6 AND i BETWEEN 8 AND 55), lambda i: g[i] + g[i + 2] + g[i - 7] + g[i + 9] - 4 * g[i + 1]) lap FROM l),
      b AS (SELECT *, list_sum(ink_rows) / 8 ink, CAST(len(list_filter(range(1, 9), lambda i: ink_rows[i] > 0.03 AND ink_rows[i] < 0.6 AND (i = 1 OR NOT (ink_rows[i - 1] > 0.03 AND ink_rows[i - 1] < 0.6)))) AS INTEGER) bands, list_sum(list_transform(lap, lambda x: x * x)) / 36 - (list_sum(lap) / 36) * (list_sum(lap) / 36) sh FROM r)
      SELECT vec_id, round(m, 4) mean, round(s, 4) stddev, round(ink, 6) ink, bands, round(sh, 3) sharpness, bands < 2 AND (s < 10 OR ink < 0.02 OR ink > 0.98) turned_away FROM b""",
    "rate_limits": """WITH RECURSIVE e AS (SELECT user_id k, epoch_us(ts) // 1000 t, event_id q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
      w AS (SELECT k, t, q, i, t s, 1 n FROM e WHERE i = 1 UNION ALL SELECT e.k, e.t, e.q, e.i, CASE WHEN e.t - w.s >= 21600000 THEN e.t ELSE w.s END, CASE WHEN e.t - w.s >= 21600000 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1)
      SELECT k AS "key", t ts_ms, q seq, n <= 3 allowed, CASE WHEN n > 3 THEN CAST(ceil((s + 21600000 - t) / 1000.0) AS BIGINT) END retry_after_s FROM w""",
    "label_value_bindings": """WITH b AS (SELECT DISTINCT l_orderkey doc_id, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey ord, l_linenumber % 2 = 1 odd, CAST(l_partkey * 31 % 900 AS DOUBLE) x0, CAST(l_suppkey * 17 % 400 AS DOUBLE) y0, CAST(l_partkey * 31 % 900 + 60 + l_partkey % 50 AS DOUBLE) x1 FROM lineitem),
      m AS (SELECT l.doc_id, l.ord label_ord, v.ord value_ord, greatest(v.x0 - l.x1, 0) / 30 dx, greatest(v.y0 - l.y0 - 30, 0) / 30 dy, greatest(30 - abs(l.y0 - v.y0), 0) / 30 >= 0.35 AND v.x0 >= l.x1 - 7.5 beside, v.y0 >= l.y0 + 22.5 AND ((v.x0 <= l.x1 AND v.x1 >= l.x0) OR abs(v.x0 - l.x0) <= 60) under FROM b l JOIN b v USING (doc_id) WHERE l.odd AND NOT v.odd),
      o AS (SELECT doc_id, label_ord, value_ord, CASE WHEN beside AND dx <= 12 THEN dx END r, CASE WHEN under AND dy <= 2.5 THEN dy END u FROM m),
      p AS (SELECT *, CASE WHEN u IS NULL OR r <= u THEN 'RIGHT' ELSE 'BELOW' END relation, CASE WHEN u IS NULL OR r <= u THEN r ELSE u END distance FROM o WHERE r IS NOT NULL OR u IS NOT NULL)
      SELECT doc_id, label_ord, value_ord, relation, round(distance, 6) distance FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, label_ord ORDER BY distance / CASE relation WHEN 'RIGHT' THEN 12 ELSE 2.5 END, value_ord) = 1""",
}
