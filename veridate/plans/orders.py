"""Verdicts over orders: each order is a document whose dates come from its customer, itself and its line items.

The derived candidates are plain arithmetic on keys, written alike in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.operators import constraints, metrics, verdict

CLASSES = list(verdict.BASIS)
IDENTITY = CLASSES[:6]
ROLES = ["EXPIRY", "UNKNOWN", "TRANSACTION", "STATEMENT_PERIOD_END", "COVERAGE_END"]
TIERS = ["TA_MRZ", "TA_PDF417", "TB_OCR", "TC_VLM"]


def as_of() -> Column:
    return F.lit("1998-08-02").cast("date")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(keys: DataFrame) -> DataFrame:
    """keys over all cores, where a table of few small files would leave the work on each of its rows to few tasks; a table of many files stays as it is."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(cores) if keys.rdd.getNumPartitions() < cores else keys


def pick(values: list[str], index: Column) -> Column:
    """The value at a 0-based index Column."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birth and issue dates of each order and one dated candidate of each line item; some orders have none."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("issued"))
    born = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("o_custkey") * 37 % 12000).cast("int"))
    fixed = orders.select("o_orderkey", F.explode(F.array(F.struct(F.lit(0).alias("cand_ord"), F.lit("DATE_OF_BIRTH").alias("role"), born.alias("iso")), F.struct(F.lit(1).alias("cand_ord"), F.lit("ISSUE").alias("role"), F.col("issued").alias("iso")))).alias("c")).select(F.col("o_orderkey").alias("doc_id"), "c.*")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 1).alias("cand_ord"), pick(ROLES, F.col("l_linenumber") % 5).alias("role"), F.add_months(F.to_date("l_shipdate"), F.col("l_linenumber") * 36).alias("iso"))
    known = lines.join(orders.select(F.col("o_orderkey").alias("doc_id")), "doc_id", "left_semi")
    kind = pick(CLASSES, F.col("doc_id") % 12)
    return fixed.unionByName(known).where("doc_id % 97 <> 0").withColumns({"raw": F.date_format("iso", "yyyy-MM-dd"), "class": kind, "identity": kind.isin(IDENTITY), "recency_validated": kind.isin(*verdict.RECENT), "cross_call": F.lit(None).cast("boolean"), "grounded": (F.col("doc_id") + F.col("cand_ord")) % 7 != 0})


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = constraints.score(constraints.eliminate(candidates(spark, sf_dir), as_of()))
    k = F.col("doc_id")
    kind = pick(CLASSES, k % 12)
    every = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).withColumns({"class": kind, "identity": kind.isin(IDENTITY)})
    docs = constraints.outcome(scored, as_of(), every)
    extra = {
        "tier": pick(TIERS, k % 4), "checksum": k % 11 != 0, "cross_source": F.when(k % 5 == 0, True), "cross_call_ok": F.when(k % 4 == 3, k % 3 != 0),
        "grounded_ok": F.when(k % 2 == 0, k % 9 != 0), "blur": F.when(k % 6 != 0, (k % 200).cast("double")), "dpi": F.when(k % 8 != 0, (k % 400).cast("double")), "hard_failed": (F.col("survivors") == 0) & (F.col("eliminated") > 0),
    }
    judged = verdict.validity(docs.withColumns(extra), F.col("winner_iso"), as_of())
    return verdict.route(judged.withColumns({"confidence": verdict.confidence(judged), "confidence_codes": verdict.confidence_codes(judged)}))


def verdict_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which date decides each order's validity, the verdict, and whether a person should look."""
    codes = F.array_join(F.array_sort("final_codes"), ";")
    return verdicts(spark, sf_dir).select("doc_id", "class", "basis", F.date_format("date", "yyyy-MM-dd").alias("date"), "days_remaining", "verdict", "survivors", "eliminated", F.col("checks").cast("long").alias("checks"), "winner_score100", "confidence", "decision", codes.alias("codes"))


def constraint_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with why it was eliminated, how many checks it met, its score and rank."""
    scored = constraints.score(constraints.eliminate(candidates(spark, sf_dir), as_of()))
    return scored.select("doc_id", "cand_ord", "role", F.col("raw").alias("iso"), "eliminated_by", "checks", "score100", "rank")


def tier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, share, mean confidence and review rate of each tier."""
    return metrics.by_group(verdicts(spark, sf_dir), "tier")


def decision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).groupBy("decision", "verdict").count().withColumnRenamed("count", "documents")


def elimination_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each reason eliminated."""
    return constraints.eliminate(candidates(spark, sf_dir), as_of()).where("eliminated_by is not null").groupBy("eliminated_by").count().withColumnRenamed("count", "candidates")


def crm_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery row a document: a key of its content, thirteen flat properties and an association."""
    k = F.col("doc_id")
    line = F.concat_ws(":", F.col("cand_ord").cast("string"), "role", "raw")
    content = candidates(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(line)), ",").alias("content"))
    v = verdicts(spark, sf_dir).join(content, "doc_id", "left")
    key = F.concat(F.lit("kyc-"), F.sha2(F.concat_ws("|", k.cast("string"), F.coalesce("content", F.lit(""))).cast("binary"), 256))
    properties = {
        "request_id": F.concat(F.lit("req-"), k.cast("string")), "decision": F.col("decision"), "confidence": F.col("confidence"), "document_class": F.col("class"), "document_issuer": F.when(k % 4 < 2, "GBR"),
        "validity_basis": F.col("basis"), "expiry_date": F.date_format("date", "yyyy-MM-dd"), "verdict": F.col("verdict"), "days_remaining": F.col("days_remaining"), "source_tier": F.col("tier"),
        "reason_codes": F.array_join(F.array_sort("final_codes"), ";"), "cost_usd": F.when(F.col("tier") == "TC_VLM", 0.02).otherwise(0.0), "evaluated_at": F.lit("1998-08-02T00:00:00Z"),
    }
    applicant = F.when(k % 3 == 0, F.concat(F.lit("applicant-"), (k % 1000).cast("string")))
    return v.select(F.lit("kyc_check").alias("object_type"), key.alias("idempotency_key"), *(c.alias(f"kyc_{n}") for n, c in properties.items()), F.when(applicant.isNotNull(), "contact").alias("to_object_type"), applicant.alias("to_object_id"), F.when(applicant.isNotNull(), "kyc_check_to_contact").alias("association_type"))


_CANDIDATES = f"""
orders_ AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) issued FROM orders),
cand AS (
  SELECT o_orderkey doc_id, 0 cand_ord, 'DATE_OF_BIRTH' AS "role", CAST(DATE '1960-01-01' + CAST(o_custkey * 37 % 12000 AS INTEGER) AS DATE) iso FROM orders_
  UNION ALL SELECT o_orderkey, 1, 'ISSUE', issued FROM orders_
  UNION ALL SELECT l_orderkey, l_linenumber + 1, (['EXPIRY', 'UNKNOWN', 'TRANSACTION', 'STATEMENT_PERIOD_END', 'COVERAGE_END'])[l_linenumber % 5 + 1], CAST(CAST(l_shipdate AS DATE) + to_months(l_linenumber * 36) AS DATE) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
cands AS (SELECT *, (['US_DRIVERS_LICENSE', 'US_STATE_ID', 'NON_US_DRIVERS_LICENSE', 'PASSPORT', 'NATIONAL_ID_CARD', 'RESIDENCE_PERMIT', 'MEDICAL_INSURANCE_CARD', 'BANK_STATEMENT', 'UTILITY_BILL', 'EMPLOYMENT_LETTER', 'OTHER_DOCUMENT', 'NOT_A_DOCUMENT'])[CAST(doc_id % 12 AS INTEGER) + 1] AS "class", (doc_id + cand_ord) % 7 <> 0 grounded FROM cand WHERE doc_id % 97 <> 0),
refs AS (SELECT doc_id, min(iso) FILTER ("role" = 'ISSUE') issue, min(iso) FILTER ("role" = 'DATE_OF_BIRTH') dob FROM cands GROUP BY doc_id),
judged AS (
  SELECT c.*, issue, dob, CASE WHEN "role" IN ('DATE_OF_BIRTH', 'ISSUE', 'COVERAGE_START', 'STATEMENT_PERIOD_START', 'EMPLOYMENT_START', 'EMPLOYMENT_END', 'APPRAISAL', 'PRINT_DATE', 'TRANSACTION') THEN 'ROLE' WHEN iso <= issue THEN 'NOT_AFTER_ISSUE'
    WHEN iso > CAST(issue + to_years(20) AS DATE) THEN 'TERM_TOO_LONG' WHEN iso > DATE '1998-08-02' AND iso > DATE '2023-08-02' THEN 'TOO_FAR_AHEAD'
    WHEN iso < CAST(dob + to_years(15) AS DATE) THEN 'HOLDER_TOO_YOUNG' WHEN dob > iso THEN 'BEFORE_BIRTH' END eliminated_by
  FROM cands c JOIN refs USING (doc_id)),
checked AS (
  SELECT *, CASE eliminated_by WHEN 'ROLE' THEN 1 WHEN 'NOT_AFTER_ISSUE' THEN 1 WHEN 'TERM_TOO_LONG' THEN 2 WHEN 'TOO_FAR_AHEAD' THEN 3
    WHEN 'HOLDER_TOO_YOUNG' THEN 3 + CAST(iso > DATE '1998-08-02' AS INTEGER) ELSE 4 + CAST(iso > DATE '1998-08-02' AS INTEGER) END checks, eliminated_by IS NULL survives
  FROM judged),
scored AS (
  SELECT *, CASE WHEN survives THEN CASE WHEN "role" IN ('EXPIRY', 'COVERAGE_END') OR ("class" IN ('UTILITY_BILL', 'BANK_STATEMENT') AND "role" = 'STATEMENT_PERIOD_END') THEN 20 ELSE 0 END
    + CASE WHEN len(list_filter([4, 5, 6, 8, 10], lambda t: abs(date_diff('day', issue, iso) / CAST(365.2425 AS DOUBLE) - t) < CAST(0.15 AS DOUBLE))) > 0 THEN 15 ELSE 0 END
    + CASE WHEN strftime(iso, '%m-%d') = strftime(dob, '%m-%d') THEN 25 ELSE 0 END
    + CASE WHEN iso = max(iso) FILTER (survives) OVER (PARTITION BY doc_id) AND count(*) FILTER (survives) OVER (PARTITION BY doc_id) > 1 THEN 5 ELSE 0 END
    + CASE WHEN grounded THEN 20 ELSE -20 END END score100 FROM checked),
ranked AS (SELECT *, CASE WHEN survives THEN row_number() OVER (PARTITION BY doc_id ORDER BY survives DESC, score100 DESC NULLS LAST, cand_ord, iso) END AS "rank" FROM scored),
"""
_DOCS = f"""
held AS (
  SELECT doc_id, max(iso) FILTER ("rank" = 1) winner_iso, max(score100) FILTER ("rank" = 1) winner_score100, max(score100) FILTER ("rank" = 2) runner, count(*) FILTER (survives) survivors,
    count(*) FILTER (eliminated_by IS NOT NULL) eliminated, max(issue) issue, max(dob) dob, sum(checks) + 1 + CAST(any_value("class") IN ('US_DRIVERS_LICENSE', 'US_STATE_ID', 'NON_US_DRIVERS_LICENSE', 'PASSPORT', 'NATIONAL_ID_CARD', 'RESIDENCE_PERMIT') AS INTEGER) checks, count(*) n, count(*) FILTER (survives AND NOT grounded) > 0 loose,
    count(*) FILTER (iso < dob AND "role" <> 'DATE_OF_BIRTH') before_birth, count(*) FILTER (eliminated_by = 'NOT_AFTER_ISSUE') > 0 nai, count(*) FILTER (eliminated_by IN ('TERM_TOO_LONG', 'TOO_FAR_AHEAD')) > 0 imp
  FROM ranked GROUP BY doc_id),
docs AS (
  SELECT o_orderkey doc_id, (['US_DRIVERS_LICENSE', 'US_STATE_ID', 'NON_US_DRIVERS_LICENSE', 'PASSPORT', 'NATIONAL_ID_CARD', 'RESIDENCE_PERMIT', 'MEDICAL_INSURANCE_CARD', 'BANK_STATEMENT', 'UTILITY_BILL', 'EMPLOYMENT_LETTER', 'OTHER_DOCUMENT', 'NOT_A_DOCUMENT'])[CAST(o_orderkey % 12 AS INTEGER) + 1] AS "class", winner_iso, winner_score100, runner, coalesce(survivors, 0) survivors, coalesce(eliminated, 0) eliminated, issue, dob, coalesce(checks, 0) checks, coalesce(n, 0) n, coalesce(loose, false) loose, coalesce(before_birth, 0) before_birth, coalesce(nai, false) nai, coalesce(imp, false) imp
  FROM orders LEFT JOIN held ON doc_id = o_orderkey),
based AS (
  SELECT *, CASE WHEN doc_id % 12 < 6 THEN 'EXPIRY_DATE' WHEN doc_id % 12 = 6 THEN 'COVERAGE_END' WHEN doc_id % 12 < 9 THEN 'RECENCY_WINDOW' WHEN doc_id % 12 = 9 THEN 'NO_EXPIRY' ELSE 'UNDETERMINED' END basis,
    list_filter([CASE WHEN issue > DATE '1998-08-02' THEN 'FUTURE_DATED_ISSUE' END, CASE WHEN nai THEN 'EXPIRY_BEFORE_ISSUE' END, CASE WHEN imp THEN 'IMPLAUSIBLE_VALIDITY_PERIOD' END], lambda x: x IS NOT NULL) anomalies,
    list_filter([CASE WHEN doc_id % 12 < 6 AND before_birth > 0 THEN 'AMBIGUOUS_DATE_FORMAT' END, CASE WHEN survivors = 0 AND n > 0 THEN 'NO_EXPIRY_SEMANTICS' END, CASE WHEN n = 0 THEN 'NO_DATES_FOUND' END,
      CASE WHEN loose OR (doc_id % 2 = 0 AND doc_id % 9 = 0) THEN 'VALUE_NOT_GROUNDED_IN_OCR' END, CASE WHEN doc_id % 4 = 3 AND doc_id % 3 = 0 THEN 'HUNTER_MAPPER_DISAGREE' END, CASE WHEN doc_id % 6 <> 0 AND doc_id % 200 < 60 THEN 'IMAGE_TOO_BLURRY' END, CASE WHEN doc_id % 8 <> 0 AND doc_id % 400 < 150 THEN 'RESOLUTION_TOO_LOW' END, CASE WHEN abs(winner_score100 - runner) < 10 THEN 'MULTIPLE_EXPIRY_CANDIDATES' END], lambda x: x IS NOT NULL) more FROM docs),
dated AS (
  SELECT *, CASE WHEN basis IN ('EXPIRY_DATE', 'COVERAGE_END') THEN date_diff('day', DATE '1998-08-02', winner_iso) WHEN basis = 'RECENCY_WINDOW' THEN CASE "class" WHEN 'BANK_STATEMENT' THEN 180 ELSE 90 END - date_diff('day', winner_iso, DATE '1998-08-02') END days_remaining,
    (['TA_MRZ', 'TA_PDF417', 'TB_OCR', 'TC_VLM'])[CAST(doc_id % 4 AS INTEGER) + 1] tier FROM based),
fused AS (
  SELECT *, CASE WHEN basis = 'NO_EXPIRY' THEN 'NOT_APPLICABLE' WHEN days_remaining IS NULL THEN 'INDETERMINATE' WHEN days_remaining >= 0 THEN 'VALID' ELSE 'EXPIRED' END verdict,
    CASE WHEN basis NOT IN ('NO_EXPIRY', 'UNDETERMINED') THEN strftime(winner_iso, '%Y-%m-%d') END AS "date",
    CAST(greatest(0, least(1, round(CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 11 <> 0 THEN 0.99 ELSE 0.45 END WHEN doc_id % 4 = 2 THEN 0.72 ELSE 0.55 END + CASE WHEN doc_id % 5 = 0 THEN 0.06 ELSE 0 END
      + CASE WHEN doc_id % 4 <> 3 THEN 0 WHEN doc_id % 3 <> 0 THEN 0.12 ELSE -0.18 END + CASE WHEN doc_id % 2 <> 0 THEN 0 WHEN doc_id % 9 <> 0 THEN 0.10 ELSE -0.25 END
      - (CASE WHEN doc_id % 6 <> 0 AND doc_id % 200 < 60 THEN 0.15 ELSE 0 END + CASE WHEN doc_id % 8 <> 0 AND doc_id % 400 < 150 THEN 0.10 ELSE 0 END) * CASE WHEN doc_id % 4 < 2 THEN 0.25 ELSE 1 END
      + least(0.08, checks * 0.02) - CASE WHEN survivors = 0 THEN 0.4 WHEN survivors > 1 THEN least(0.15, (survivors - 1) * 0.07) ELSE 0 END + greatest(-0.2, least(0.15, coalesce(winner_score100, 0) * 0.002)), 4))) AS DOUBLE) confidence FROM dated),
routed AS (
  SELECT *, CASE WHEN len(anomalies) > 0 OR verdict = 'INDETERMINATE' THEN 'REVIEW' WHEN verdict = 'NOT_APPLICABLE' AND confidence >= 0.7 THEN 'AUTO_PASS'
    WHEN confidence >= 0.95 AND NOT (survivors = 0 AND eliminated > 0) THEN CASE WHEN verdict = 'EXPIRED' THEN 'AUTO_FAIL' ELSE 'AUTO_PASS' END ELSE 'REVIEW' END decision FROM fused),
final AS (SELECT *, array_to_string(list_sort(CASE WHEN decision = 'REVIEW' AND len(anomalies) + len(more) = 0 THEN ['LOW_TIER_CONFIDENCE'] ELSE list_concat(anomalies, more) END), ';') codes FROM routed)
"""

QUERIES = {f.__name__: f for f in (verdict_per_order, constraint_trace, tier_report, decision_histogram, elimination_tally, crm_payloads)}
ORACLES = {
    "verdict_per_order": f"""WITH {_CANDIDATES} {_DOCS} SELECT doc_id, "class", basis, "date", CAST(days_remaining AS INTEGER) days_remaining, verdict, survivors, eliminated, CAST(checks AS BIGINT) checks, CAST(winner_score100 AS INTEGER) winner_score100, confidence, decision, codes FROM final""",
    "constraint_trace": f"""WITH {_CANDIDATES} x AS (SELECT 1) SELECT doc_id, CAST(cand_ord AS INTEGER) cand_ord, "role", strftime(iso, '%Y-%m-%d') iso, eliminated_by, CAST(checks AS INTEGER) checks, CAST(score100 AS INTEGER) score100, CAST("rank" AS INTEGER) AS "rank" FROM ranked""",
    "tier_report": f"""WITH {_CANDIDATES} {_DOCS} SELECT tier, count(*) documents, round(count(*) / sum(count(*)) OVER (), 6) AS "share", round(sum(CAST(round(confidence * 10000) AS BIGINT)) / 10000.0 / count(*), 6) mean_confidence, round(count(*) FILTER (decision = 'REVIEW') / count(*), 6) review_rate FROM final GROUP BY tier""",
    "decision_histogram": f"""WITH {_CANDIDATES} {_DOCS} SELECT decision, verdict, count(*) documents FROM final GROUP BY decision, verdict""",
    "elimination_tally": f"""WITH {_CANDIDATES} x AS (SELECT 1) SELECT eliminated_by, count(*) candidates FROM ranked WHERE eliminated_by IS NOT NULL GROUP BY eliminated_by""",
    "crm_payloads": f"""WITH {_CANDIDATES} {_DOCS}, body AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) content FROM (SELECT doc_id, CAST(cand_ord AS VARCHAR) || ':' || "role" || ':' || strftime(iso, '%Y-%m-%d') x FROM cands) GROUP BY doc_id)
      SELECT 'kyc_check' object_type, 'kyc-' || sha256(CAST(f.doc_id AS VARCHAR) || '|' || coalesce(content, '')) idempotency_key, 'req-' || CAST(f.doc_id AS VARCHAR) kyc_request_id, decision kyc_decision, confidence kyc_confidence, "class" kyc_document_class, CASE WHEN f.doc_id % 4 < 2 THEN 'GBR' END kyc_document_issuer, basis kyc_validity_basis, "date" kyc_expiry_date, verdict kyc_verdict,
        CAST(days_remaining AS INTEGER) kyc_days_remaining, tier kyc_source_tier, codes kyc_reason_codes, CAST(CASE WHEN tier = 'TC_VLM' THEN 0.02 ELSE 0 END AS DOUBLE) kyc_cost_usd, '1998-08-02T00:00:00Z' kyc_evaluated_at,
        CASE WHEN f.doc_id % 3 = 0 THEN 'contact' END to_object_type, CASE WHEN f.doc_id % 3 = 0 THEN 'applicant-' || CAST(f.doc_id % 1000 AS VARCHAR) END to_object_id, CASE WHEN f.doc_id % 3 = 0 THEN 'kyc_check_to_contact' END association_type FROM final f LEFT JOIN body USING (doc_id)""",
}
