"""Answers held against expectations, and the merge of two model calls, over inputs derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.operators import evaluate, twocalls
from veridate.plans import orders
from veridate.plans.orders import CLASSES, as_of, pick, read, spread


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of orders with expectations that differ here and there, latency and cost (ten-thousandths of a dollar)."""
    k = F.col("doc_id")
    v = orders.verdicts(spark, sf_dir).select("doc_id", F.col("class").alias("expected_class"), "basis", "date", "verdict", F.when(k % 29 == 0, "REJECTED").otherwise(F.col("decision")).alias("decision"), "tier")
    expected = {"expected_basis": F.when(k % 19 == 0, "EXPIRY_DATE").otherwise(F.col("basis")), "expected_date": F.when(k % 13 == 0, F.date_add("date", 1)).otherwise(F.col("date")), "expected_verdict": F.when(k % 17 == 0, "INDETERMINATE").otherwise(F.col("verdict"))}
    return evaluate.score(v.withColumns(expected | {"ms": k % 900 + 20, "cost": F.when(F.col("tier") == "TC_VLM", k % 50 + 200).otherwise(0)}))


def evaluation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document was answered, rightly, and what was wrong."""
    return _scored(spark, sf_dir).select("doc_id", "committed", "correct", "miss", evaluate.is_adversarial(F.col("expected_class")).alias("adversarial"))


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, accuracy, confident errors, what the gate turned away and what that saved."""
    return evaluate.summary(_scored(spark, sf_dir))


def evaluation_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, share, latency and cost of each tier, the largest first."""
    return evaluate.by_tier(_scored(spark, sf_dir))


def two_call_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two model calls about a customer's page, either of which may fail, disagree, or be injected."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("1999-01-13").cast("date"), (k * 31 % 300).cast("int"))
    other = F.date_add(day, 500)
    us = lambda d: F.date_format(d, "MM/dd/yyyy")
    entry = lambda raw, role, bad: F.struct(raw.alias("raw"), F.lit(role).alias("role"), bad.alias("illegible"))
    both = F.array(entry(F.date_format(day, "dd MMM yyyy"), "UNKNOWN", k % 5 == 0), entry(us(other), "ISSUE", F.lit(False)))
    mapper = F.when(k % 4 == 3, F.array().cast("array<struct<raw:string,role:string,illegible:boolean>>")).otherwise(both)
    hunter = F.when(k % 3 == 0, us(day)).when(k % 3 == 1, us(F.date_add(day, 7)))
    errors = F.when(k % 11 != 0, F.array(F.lit(None).cast("string"))).when(k % 6 == 1, F.array(F.lit("rate_limit"), F.lit("rate_limit"))).when(k % 6 == 2, F.array(F.lit("timeout"))).otherwise(F.array(F.lit("overloaded")))
    asked = twocalls.attempts(errors)["outcome"]
    failures = F.array_compact(F.array(F.when(asked != "OK", asked), F.when(k % 7 == 0, "MODEL_UNAVAILABLE")))
    found = twocalls.merge(hunter, asked == "OK", mapper, k % 7 != 0, pick(CLASSES, k % 12), k % 10 == 0, F.lit("US"), as_of(), failures)
    tried = twocalls.attempts(F.when(k % 6 == 0, F.array(F.lit("rate_limit"), F.lit(None))).when(k % 6 == 1, F.array(F.lit("rate_limit"), F.lit("rate_limit"))).when(k % 6 == 2, F.array(F.lit("timeout"))).otherwise(F.array(F.lit(None).cast("string"))))
    rows = spread(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("doc_id"), found.alias("m"), tried.alias("t"))
    told = F.array_join(F.transform("m.candidates", lambda c: F.concat_ws(":", c["role"], F.date_format(c["iso"], "yyyy-MM-dd"), F.format_string("%.3f", c["confidence"]))), ";")
    return rows.select("doc_id", told.alias("candidates"), F.array_join("m.codes", ";").alias("codes"), "m.abstained", "t.outcome", "t.waited_ms")


_EVALUATED = f"""WITH {orders._CANDIDATES} {orders._DOCS},
  v AS (SELECT doc_id k, "class" ec, basis, "date" d, verdict, CASE WHEN doc_id % 29 = 0 THEN 'REJECTED' ELSE decision END decision, tier, CASE WHEN doc_id % 19 = 0 THEN 'EXPIRY_DATE' ELSE basis END eb, CASE WHEN doc_id % 13 = 0 THEN strftime(CAST("date" AS DATE) + 1, '%Y-%m-%d') ELSE "date" END ed,
    CASE WHEN doc_id % 17 = 0 THEN 'INDETERMINATE' ELSE verdict END ev, doc_id % 900 + 20 ms, CASE WHEN tier = 'TC_VLM' THEN doc_id % 50 + 200 ELSE 0 END AS "cost" FROM final),
  s AS (SELECT *, decision <> 'REVIEW' committed, CASE WHEN ev = 'INDETERMINATE' THEN decision = 'REVIEW' WHEN ed IS NULL THEN d IS NULL AND basis = eb ELSE d IS NOT DISTINCT FROM ed AND basis = eb AND verdict = ev END ok, ec IN ('NOT_A_DOCUMENT', 'OTHER_DOCUMENT') adv FROM v)"""

QUERIES = {f.__name__: f for f in (evaluation_outcomes, evaluation_summary, evaluation_tiers, two_call_candidates)}
ORACLES = {
    "evaluation_outcomes": f"""{_EVALUATED} SELECT k doc_id, committed, ok correct, CASE WHEN NOT ok THEN CASE WHEN ev = 'INDETERMINATE' THEN 'committed' ELSE concat_ws(';', CASE WHEN d IS DISTINCT FROM ed THEN 'date' END, CASE WHEN basis <> eb THEN 'basis' END, CASE WHEN verdict <> ev AND ed IS NOT NULL THEN 'verdict' END) END END miss, adv adversarial FROM s""",
    "evaluation_summary": f"""{_EVALUATED}, n AS (SELECT count(*) n, count(*) FILTER (ok) c, count(*) FILTER (committed) a, count(*) FILTER (committed AND ok) r, count(*) FILTER (committed AND NOT ok) w, count(*) FILTER (adv) adversarial, count(*) FILTER (adv AND decision = 'REJECTED') t, count(*) FILTER (adv AND "cost" = 0) contained, count(*) FILTER (NOT adv AND decision = 'REJECTED') f, sum("cost") usd FROM s)
      SELECT n documents, round(a / n, 6) coverage, round(CASE WHEN a > 0 THEN r / a ELSE 0 END, 6) accuracy, round(c / n, 6) overall, w confidently_wrong, adversarial, t turned_away, contained, f false_rejects, CAST(round(usd / 10000.0, 4) AS DOUBLE) usd, CAST(round(t * 16.0, 4) AS DOUBLE) minutes_low, CAST(round(t * 24.0, 4) AS DOUBLE) minutes_high FROM n""",
    "evaluation_tiers": f"""{_EVALUATED} SELECT tier, count(*) documents, round(count(*) / sum(count(*)) OVER (), 6) AS "share", round(sum(ms) / count(*), 4) mean_ms, CAST(round(CAST(sum("cost") AS DOUBLE) / 10000 / count(*), 6) AS DOUBLE) mean_usd, CAST(row_number() OVER (ORDER BY count(*) DESC, tier) AS INTEGER) tier_rank FROM s GROUP BY tier""",
    "two_call_candidates": """WITH c AS (SELECT c_custkey k, CAST(DATE '1999-01-13' + CAST(c_custkey * 31 % 300 AS INTEGER) AS DATE) d, c_custkey % 11 <> 0 h, c_custkey % 7 <> 0 m, c_custkey % 4 = 3 bare, CASE c_custkey % 6 WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'TIMEOUT' ELSE 'MODEL_UNAVAILABLE' END fc FROM customer),
      r AS (SELECT *, h AND k % 3 <> 2 said, h AND k % 3 = 0 AND m AND NOT bare met FROM c),
      x AS (SELECT *, said AND NOT met beside, CASE WHEN m AND NOT bare THEN [CASE WHEN met THEN 'EXPIRY' ELSE 'UNKNOWN' END || ':' || strftime(d, '%Y-%m-%d') || ':' || CASE WHEN met THEN CASE WHEN k % 5 = 0 THEN '0.425' ELSE '0.850' END WHEN k % 5 = 0 THEN '0.250' ELSE '0.500' END, 'ISSUE:' || strftime(d + 500, '%Y-%m-%d') || ':0.500'] ELSE [] END own FROM r),
      y AS (SELECT *, CASE WHEN beside THEN list_append(own, 'EXPIRY:' || strftime(d + CASE WHEN k % 3 = 1 THEN 7 ELSE 0 END, '%Y-%m-%d') || ':' || CASE WHEN m THEN '0.150' ELSE '0.500' END) ELSE own END every FROM x)
      SELECT k doc_id, array_to_string(every, ';') candidates, concat_ws(';', CASE WHEN NOT h THEN fc END, CASE WHEN NOT m AND (h OR fc <> 'MODEL_UNAVAILABLE') THEN 'MODEL_UNAVAILABLE' END, CASE WHEN k % 10 = 0 AND m THEN 'PROMPT_INJECTION_SUSPECTED' END, CASE WHEN beside AND m THEN 'HUNTER_MAPPER_DISAGREE' END, CASE WHEN beside AND NOT m THEN 'LOW_TIER_CONFIDENCE' END, CASE WHEN (h OR m) AND len(every) = 0 THEN CASE WHEN k % 12 IN (9, 10, 11) THEN 'NO_EXPIRY_SEMANTICS' ELSE 'NO_DATES_FOUND' END END) codes,
        len(every) = 0 abstained, CASE k % 6 WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'TIMEOUT' ELSE 'OK' END outcome, CAST(CASE WHEN k % 6 < 2 THEN 500 ELSE 0 END AS BIGINT) waited_ms FROM y""",
}
