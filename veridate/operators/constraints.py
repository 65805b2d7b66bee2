"""Elimination and scoring of date candidates.

Input: one row a candidate, with doc_id, cand_ord (order within the document), role,
iso, raw, and document columns.  All of a document's candidates are looked at with
windows over doc_id: one shuffle, no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridate.functions import dates

#: Roles that never decide validity.
NEVER_EXPIRY = ["DATE_OF_BIRTH", "ISSUE", "COVERAGE_START", "STATEMENT_PERIOD_START", "EMPLOYMENT_START", "EMPLOYMENT_END", "APPRAISAL", "PRINT_DATE", "TRANSACTION"]
#: Usual terms of documents in years, and how near counts.
TERMS, NEAR = (4, 5, 6, 8, 10), 0.15
MAX_TERM, MAX_AHEAD, MIN_AGE = 20, 25, 15


def _reference(role: str, doc: Window) -> Column:
    """The first dated candidate of a role in the document."""
    return F.min(F.when((F.col("role") == role) & F.col("iso").isNotNull(), F.struct("cand_ord", "iso"))).over(doc)["iso"]


def eliminate(candidates: DataFrame, as_of: Column) -> DataFrame:
    """Adds issue and dob (reference dates), eliminated_by (null: survives) and checks (how many checks the row reached)."""
    doc = Window.partitionBy("doc_id")
    df = candidates.withColumns({"issue": _reference("ISSUE", doc), "dob": _reference("DATE_OF_BIRTH", doc)})
    iso, issue, dob = F.col("iso"), F.col("issue"), F.col("dob")
    ahead = iso > as_of
    reason = (
        F.when(iso.isNull(), F.when(F.coalesce(F.col("raw"), F.lit("")) != "", "UNRESOLVED"))
        .when(F.col("role").isin(NEVER_EXPIRY), "ROLE")
        .when(iso <= issue, "NOT_AFTER_ISSUE")
        .when(dates.exceeds_anniversary(issue, iso, MAX_TERM), "TERM_TOO_LONG")
        .when(ahead & dates.exceeds_anniversary(as_of, iso, MAX_AHEAD), "TOO_FAR_AHEAD")
        .when(dates.precedes_anniversary(dob, iso, MIN_AGE), "HOLDER_TOO_YOUNG")
        .when(dob > iso, "BEFORE_BIRTH")
    )
    of_issue, of_ahead = F.when(issue.isNotNull(), 2).otherwise(0), F.when(ahead, 1).otherwise(0)
    checks = (
        F.when(F.col("eliminated_by").isin("UNRESOLVED", "ROLE"), 1)
        .when(iso.isNull(), 0)
        .when(F.col("eliminated_by") == "NOT_AFTER_ISSUE", 1)
        .when(F.col("eliminated_by") == "TERM_TOO_LONG", 2)
        .when(F.col("eliminated_by") == "TOO_FAR_AHEAD", of_issue + 1)
        .when(F.col("eliminated_by") == "HOLDER_TOO_YOUNG", of_issue + of_ahead + 1)
        .otherwise(of_issue + of_ahead + F.when(dob.isNotNull(), 2).otherwise(0))
    )
    return df.withColumn("eliminated_by", reason).withColumn("checks", checks).withColumn("survives", iso.isNotNull() & F.col("eliminated_by").isNull())


def score(judged: DataFrame) -> DataFrame:
    """Adds score100 (hundredths) and rank (1: the winner) of the survivors of each document; recency_validated marks classes judged by age."""
    doc = Window.partitionBy("doc_id")
    iso, s = F.col("iso"), F.col("survives")
    latest, many = F.max(F.when(s, iso)).over(doc), F.count(F.when(s, 1)).over(doc)
    span = dates.span_years(F.col("issue"), iso)
    typical = F.exists(F.array(*map(F.lit, TERMS)), lambda t: F.abs(span - t) < NEAR)
    points = (
        F.when(F.col("role").isin("EXPIRY", "COVERAGE_END") | F.col("recency_validated") & (F.col("role") == "STATEMENT_PERIOD_END"), 20).otherwise(0)
        + F.when(typical, 15).otherwise(0)
        + F.when(F.date_format(iso, "MM-dd") == F.date_format("dob", "MM-dd"), 25).otherwise(0)
        + F.when((iso == latest) & (many > 1), 5).otherwise(0)
        + F.when(F.col("cross_call"), 25).otherwise(0)
        + F.when(F.col("grounded"), 20).when(~F.col("grounded"), -20).otherwise(0)
    )
    scored = judged.withColumn("score100", F.when(s, points))
    best = Window.partitionBy("doc_id").orderBy(F.col("survives").desc(), F.col("score100").desc_nulls_last(), "cand_ord", "iso")
    return scored.withColumn("rank", F.when(s, F.row_number().over(best)))


def outcome(scored: DataFrame, as_of: Column, documents: DataFrame | None = None) -> DataFrame:
    """One row a document: winner, counts, anomalies and reason codes.

    documents (doc_id, class, identity): those that have a row even without any candidate.
    """
    has = lambda reason: F.count_if(F.col("eliminated_by") == reason) > 0
    flat = scored.groupBy("doc_id").agg(
        F.first("class").alias("class"),
        F.max(F.when(F.col("rank") == 1, F.col("iso"))).alias("winner_iso"),
        F.max(F.when(F.col("rank") == 1, F.col("role"))).alias("winner_role"),
        F.max(F.when(F.col("rank") == 1, F.col("score100"))).alias("winner_score100"),
        F.max(F.when(F.col("rank") == 2, F.col("score100"))).alias("second_score100"),
        F.count_if("survives").alias("survivors"),
        F.count_if(F.col("eliminated_by").isNotNull()).alias("eliminated"),
        F.count(F.lit(1)).alias("candidates"),
        F.max("issue").alias("issue"),
        F.max("dob").alias("dob"),
        F.sum("checks").alias("checks"),
        F.count_if((F.col("iso") < F.col("dob")) & (F.col("role") != "DATE_OF_BIRTH")).alias("before_birth"),
        F.max("identity").alias("identity"),
        has("NOT_AFTER_ISSUE").alias("not_after_issue"),
        (has("TERM_TOO_LONG") | has("TOO_FAR_AHEAD")).alias("implausible"),
        (F.count_if(F.col("survives") & ~F.col("grounded")) > 0).alias("ungrounded"),
    )
    if documents is not None:
        counts = ["survivors", "eliminated", "candidates", "checks", "before_birth"]
        flat = documents.select("doc_id", "class", "identity").join(flat.drop("class", "identity"), "doc_id", "left")
        flat = flat.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {c: F.coalesce(c, F.lit(False)) for c in ("not_after_issue", "implausible", "ungrounded")})
    anomalies = [F.when(F.col("issue") > as_of, "FUTURE_DATED_ISSUE"), F.when(F.col("not_after_issue"), "EXPIRY_BEFORE_ISSUE"), F.when(F.col("implausible"), "IMPLAUSIBLE_VALIDITY_PERIOD")]
    codes = [
        *anomalies,
        F.when(F.col("identity") & F.col("dob").isNotNull() & (F.col("before_birth") > 0), "AMBIGUOUS_DATE_FORMAT"),
        F.when(F.col("ungrounded"), "VALUE_NOT_GROUNDED_IN_OCR"),
        F.when((F.col("survivors") == 0) & (F.col("candidates") > 0), "NO_EXPIRY_SEMANTICS"),
        F.when(F.col("candidates") == 0, "NO_DATES_FOUND"),
        F.when(F.abs(F.col("winner_score100") - F.col("second_score100")) < 10, "MULTIPLE_EXPIRY_CANDIDATES"),
    ]
    checks = F.col("checks") + F.when(F.col("issue").isNotNull(), 1).otherwise(0) + F.when(F.col("identity") & F.col("dob").isNotNull(), 1).otherwise(0)
    return flat.withColumns({"checks": checks, "anomalies": F.array_compact(F.array(*anomalies)), "reason_codes": F.array_compact(F.array(*codes))}).drop("not_after_issue", "implausible", "before_birth", "ungrounded")
