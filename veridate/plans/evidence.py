"""Gate, merging and memo queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.operators import classify, gate, merge
from veridate.plans.orders import CLASSES, ROLES, pick, read

ISSUERS = ["USA", "TX", "United States of America", "DEU", "Ontario", "", "CAN"]


def screen_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 gray images with bands drawn by id: stacked edges and side bars of screen captures, and the gate's decision."""
    k = F.col("vec_id")
    raw = F.transform("embedding", lambda x, i: F.when((k % 3 == 0) & (i < 8), F.lit(30.0)).when((k % 3 == 0) & (i < 24), F.lit(225.0)).when((k % 5 == 0) & (i % 8 == 0), F.lit(250.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + x.cast("double") * 400).cast("double")))))
    e = read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", raw.alias("gray")).withColumn("mean", gate.luminance(F.col("gray"))["mean"])
    for edge in ("TOP", "BOTTOM", "LEFT", "RIGHT"):
        a, b = gate.zones(F.col("gray"), 8, 8, edge)
        e = e.withColumns({f"{edge}_a": a, f"{edge}_b": b})
    stacked = gate.stacked(F.col("TOP_a"), F.col("TOP_b")) | gate.stacked(F.col("BOTTOM_a"), F.col("BOTTOM_b"))
    bar = gate.side_bar(F.col("LEFT_a"), F.col("mean")) | gate.side_bar(F.col("RIGHT_a"), F.col("mean"))
    found = e.select("vec_id", stacked.alias("stacked"), bar.alias("side_bar"), (k % 2 == 0).alias("screen_native"))
    return found.withColumn("decision", gate.outcome(F.lit(False), F.col("screen_native") & (F.col("stacked") | F.col("side_bar")), k % 7 == 0))


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that several readers found in an order, each once, from the reader with most authority."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 4).cast("int").alias("tier_rank"), (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("cand_ord"), pick(ROLES, F.col("l_linenumber") % 2).alias("role"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("iso"), F.lit("").alias("raw"))
    return merge.by_authority(rows.distinct()).select("doc_id", "role", F.date_format("iso", "yyyy-MM-dd").alias("iso"), "tier_rank", "cand_ord", "readers")


def issuer_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order of day and month an issuer's dates have."""
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 9 != 0, pick(ISSUERS, k % len(ISSUERS))).alias("issuer"), pick(CLASSES, k % 12).alias("class"))
    return rows.withColumn("convention", merge.issuer_convention(F.col("issuer"), F.col("class")))


def gate_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first domain keyword in each conversation turn, in listed order; a term is appended to every fourth."""
    terms = [t for _, t in classify.GATE_TERMS]
    body = F.concat("text", F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit(" "), pick(terms, (F.col("conv_id") + F.col("turn")) % len(terms)))).otherwise(""))
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", classify.gate_hit(body).alias("h"))
    return found.where("h is not null").select("conv_id", "turn", "h.term", "h.class")


def content_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done once for each distinct content and given to all its copies: figures of one row a content hash, joined back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.length("text").alias("chars"))
    once = docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("chars").alias("chars"))
    own, hashed = docs.select("doc_id", F.col("content_hash").alias("own")), once.alias("once")
    return own.join(hashed, F.col("own").eqNullSafe(F.col("content_hash"))).drop("own")


#: The SQL's own list of the gate's terms by class, in order (fixed values).
_GATE = {
    "BANK_STATEMENT": "statement period|account statement|account holder|account number|transaction history|statement of account|opening balance|closing balance|available balance|account summary|sort code|routing number|iban|withdrawals|deposits",
    "UTILITY_BILL": "meter reading|utility|supply address|kwh|tariff|billing period|council tax|electricity supply|gas supply|water services|service address",
    "EMPLOYMENT_LETTER": "to whom it may concern|confirmation of employment|employment history|letter confirms|employment status|employment verification|is employed|date of joining|annual salary|per annum|human resources|hereby certify|job title|designation",
    "MEDICAL_INSURANCE_CARD": "member id|insurance|coverage|plan name|benefits|group number|rx bin|rx pcn|copay|subscriber|health plan|policy number|coverage period",
    "PASSPORT": "passport|passeport|pasaporte|reisepass",
    "US_DRIVERS_LICENSE": "driver license|driver's license|driving licence|dl no|dln|department of licensing|department of motor vehicles",
    "US_STATE_ID": "identification card|state id|non-driver",
    "RESIDENCE_PERMIT": "residence permit|titre de sejour|aufenthaltstitel|aufenthaltserlaubnis|permesso di soggiorno",
    "NATIONAL_ID_CARD": "identity card|national id|carte nationale|personalausweis",
}
_TERMS = [(c, t) for c, ts in _GATE.items() for t in ts.split("|")]
_LIST = "[" + ", ".join("'" + t.replace("'", "''") + "'" for _, t in _TERMS) + "]"
_KEYS = ", ".join(f"({i}, '{c}', '" + t.replace("'", "''") + "')" for i, (c, t) in enumerate(_TERMS))
_Z = {"ta": "i < 8", "tb": "i BETWEEN 8 AND 23", "ba": "i >= 56", "bb": "i BETWEEN 40 AND 55", "la": "i % 8 = 0", "ra": "i % 8 = 7"}
_M = ", ".join(f"list_avg(list_transform(list_filter(range(0, 64), lambda i: {w}), lambda i: g[i + 1])) m{n}, sqrt(greatest(list_avg(list_transform(list_filter(range(0, 64), lambda i: {w}), lambda i: g[i + 1] * g[i + 1])) - list_avg(list_transform(list_filter(range(0, 64), lambda i: {w}), lambda i: g[i + 1])) ** 2, 0)) s{n}" for n, w in _Z.items())

QUERIES = {f.__name__: f for f in (screen_chrome, merged_candidates, issuer_conventions, gate_keywords, content_memo)}
ORACLES = {
    "screen_chrome": f"""WITH e AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN vec_id % 3 = 0 AND i < 8 THEN 30.0 WHEN vec_id % 3 = 0 AND i < 24 THEN 225.0 WHEN vec_id % 5 = 0 AND i % 8 = 0 THEN 250.0 ELSE greatest(0.0, least(255.0, floor(128 + CAST(embedding[i + 1] AS DOUBLE) * 400))) END) g FROM embeddings WHERE len(embedding) = 64),
      z AS (SELECT vec_id, list_avg(g) m, {_M} FROM e),
      f AS (SELECT vec_id, (sta <= 32 AND stb <= 32 AND abs(mta - mtb) >= 28) OR (sba <= 32 AND sbb <= 32 AND abs(mba - mbb) >= 28) stacked, (sla <= 32 AND abs(mla - m) >= 20) OR (sra <= 32 AND abs(mra - m) >= 20) side_bar, vec_id % 2 = 0 screen_native FROM z)
      SELECT *, CASE WHEN screen_native AND (stacked OR side_bar) THEN 'REJECT' WHEN vec_id % 7 = 0 THEN 'ADMIT_FULL' ELSE 'ADMIT_LIMITED' END decision FROM f""",
    "merged_candidates": """WITH c AS (SELECT DISTINCT l_orderkey doc_id, CAST(l_suppkey % 4 AS INTEGER) tier_rank, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey cand_ord, CASE WHEN l_linenumber % 2 = 0 THEN 'EXPIRY' ELSE 'UNKNOWN' END AS "role", strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d') iso FROM lineitem),
      n AS (SELECT doc_id, "role", iso, count(DISTINCT tier_rank) readers FROM c GROUP BY ALL)
      SELECT doc_id, "role", iso, tier_rank, cand_ord, CAST(readers AS INTEGER) readers FROM c JOIN n USING (doc_id, "role", iso) QUALIFY row_number() OVER (PARTITION BY doc_id, "role", iso ORDER BY tier_rank, cand_ord) = 1""",
    "issuer_conventions": f"""WITH c AS (SELECT c_custkey doc_id, CASE WHEN c_custkey % 9 <> 0 THEN (['USA', 'TX', 'United States of America', 'DEU', 'Ontario', '', 'CAN'])[CAST(c_custkey % 7 AS INTEGER) + 1] END issuer, (['US_DRIVERS_LICENSE', 'US_STATE_ID', 'NON_US_DRIVERS_LICENSE', 'PASSPORT', 'NATIONAL_ID_CARD', 'RESIDENCE_PERMIT', 'MEDICAL_INSURANCE_CARD', 'BANK_STATEMENT', 'UTILITY_BILL', 'EMPLOYMENT_LETTER', 'OTHER_DOCUMENT', 'NOT_A_DOCUMENT'])[CAST(c_custkey % 12 AS INTEGER) + 1] AS "class" FROM customer)
      SELECT *, CASE WHEN issuer IN ('USA', 'TX', 'United States of America') THEN 'US' WHEN issuer <> '' THEN 'DMY' WHEN "class" IN ('NON_US_DRIVERS_LICENSE', 'NATIONAL_ID_CARD') THEN 'DMY' END convention FROM c""",
    "gate_keywords": f"""WITH k(o, "class", term) AS (VALUES {_KEYS}), t AS (SELECT conv_id, turn, lower(text || CASE WHEN conv_id % 4 = 0 THEN ' ' || ({_LIST})[CAST((conv_id + turn) % {len(_TERMS)} AS INTEGER) + 1] ELSE '' END) x FROM conversations)
      SELECT conv_id, turn, term, "class" FROM t JOIN k ON contains(x, term) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) = 1""",
    "content_memo": """WITH d AS (SELECT doc_id, sha256(text) content_hash, length(text) chars FROM documents), o AS (SELECT content_hash, count(*) copies, min(doc_id) first_doc, CAST(max(chars) AS INTEGER) chars FROM d GROUP BY 1) SELECT doc_id, o.content_hash, copies, first_doc, o.chars FROM d JOIN o ON d.content_hash IS NOT DISTINCT FROM o.content_hash""",
}
