"""Validity by class, fusion of confidence, and routing, as Columns over one row a document."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What decides validity in each document class.
BASIS = {
    "US_DRIVERS_LICENSE": "EXPIRY_DATE", "US_STATE_ID": "EXPIRY_DATE", "NON_US_DRIVERS_LICENSE": "EXPIRY_DATE", "PASSPORT": "EXPIRY_DATE",
    "NATIONAL_ID_CARD": "EXPIRY_DATE", "RESIDENCE_PERMIT": "EXPIRY_DATE", "MEDICAL_INSURANCE_CARD": "COVERAGE_END", "BANK_STATEMENT": "RECENCY_WINDOW",
    "UTILITY_BILL": "RECENCY_WINDOW", "EMPLOYMENT_LETTER": "NO_EXPIRY", "OTHER_DOCUMENT": "UNDETERMINED", "NOT_A_DOCUMENT": "UNDETERMINED",
}
#: Days for which a dated document counts as recent; 90 elsewhere.
RECENT = {"UTILITY_BILL": 90, "BANK_STATEMENT": 180}
AUTO, FLOOR = 0.95, 0.7


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))[key]


def basis(document_class: Column) -> Column:
    return lookup(BASIS, document_class)


def validity(df: DataFrame, date: Column, as_of: Column, endless: Column | None = None) -> DataFrame:
    """Adds basis, date (null where no date applies), days_remaining and verdict; a document is valid to the end of its last day.

    endless: whether a document says itself that it does not expire, which is believed whatever its class.
    """
    b = basis(F.col("class")) if endless is None else F.when(endless, "NO_EXPIRY").otherwise(basis(F.col("class")))
    window = F.coalesce(lookup(RECENT, F.col("class")), F.lit(90))
    days = F.when(b.isin("EXPIRY_DATE", "COVERAGE_END"), F.datediff(date, as_of)).when(b == "RECENCY_WINDOW", window - F.datediff(as_of, date))
    verdict = F.when(b == "NO_EXPIRY", "NOT_APPLICABLE").when(days.isNull(), "INDETERMINATE").when(days >= 0, "VALID").otherwise("EXPIRED")
    return df.withColumns({"basis": b, "date": F.when(~b.isin("NO_EXPIRY", "UNDETERMINED"), date), "days_remaining": days, "verdict": verdict})


def confidence(df: DataFrame) -> Column:
    """Fused confidence, 4 places, from tier, checksum, cross_source, cross_call_ok, grounded_ok, blur, dpi, checks, survivors, winner_score100."""
    c = F.col
    machine = c("tier").isin("TA_MRZ", "TA_PDF417")
    base = F.when(machine, F.when(c("checksum"), 0.99).otherwise(0.45)).when(c("tier") == "TB_OCR", 0.72).when(c("tier") == "TC_VLM", 0.55).otherwise(0.2)
    quality = F.when(c("blur") < 60, 0.15).otherwise(0.0) + F.when(c("dpi") < 150, 0.10).otherwise(0.0)
    total = (
        base
        + F.when(c("cross_source"), 0.06).otherwise(0.0)
        + F.when(c("cross_call_ok"), 0.12).when(~c("cross_call_ok"), -0.18).otherwise(0.0)
        + F.when(c("grounded_ok"), 0.10).when(~c("grounded_ok"), -0.25).otherwise(0.0)
        - quality * F.when(machine, 0.25).otherwise(1.0)
        + F.least(F.lit(0.08), c("checks") * 0.02)
        - F.when(c("survivors") == 0, 0.4).when(c("survivors") > 1, F.least(F.lit(0.15), (c("survivors") - 1) * 0.07)).otherwise(0.0)
        + F.greatest(F.lit(-0.2), F.least(F.lit(0.15), F.coalesce(c("winner_score100"), F.lit(0)) * 0.002))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 4)))


def confidence_codes(df: DataFrame) -> Column:
    """Reason codes of what lowers the fused confidence."""
    c = F.col
    return F.array_compact(F.array(F.when(~c("cross_call_ok"), "HUNTER_MAPPER_DISAGREE"), F.when(~c("grounded_ok"), "VALUE_NOT_GROUNDED_IN_OCR"), F.when(c("blur") < 60, "IMAGE_TOO_BLURRY"), F.when(c("dpi") < 150, "RESOLUTION_TOO_LOW")))


def route(df: DataFrame) -> DataFrame:
    """Adds decision and final_codes from verdict, confidence, anomalies, hard_failed, reason_codes and confidence_codes; every REVIEW has a code."""
    codes = F.array_distinct(F.concat("reason_codes", "confidence_codes", "anomalies"))
    sure = (F.col("confidence") >= AUTO) & ~F.col("hard_failed")
    decision = (
        F.when(F.size("anomalies") > 0, "REVIEW")
        .when(F.col("verdict") == "INDETERMINATE", "REVIEW")
        .when((F.col("verdict") == "NOT_APPLICABLE") & (F.col("confidence") >= FLOOR), "AUTO_PASS")
        .when(sure, F.when(F.col("verdict") == "EXPIRED", "AUTO_FAIL").otherwise("AUTO_PASS"))
        .otherwise("REVIEW")
    )
    given = F.when((F.col("decision") == "REVIEW") & (F.size(codes) == 0), F.array(F.lit("LOW_TIER_CONFIDENCE"))).otherwise(codes)
    return df.withColumn("decision", decision).withColumn("final_codes", given)
