"""Plausibility of a document's dates, and machine-read dates against printed ones, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import dates

#: Years a document can be valid, confidence of a check digit, what agreement adds and disagreement leaves.
MOST_YEARS, SURE, AGREED, DISPUTED = 20, 0.99, 0.005, 0.5
#: Anomaly of a disagreement by source.
MISMATCH = {"MRZ": "MRZ_VIZ_MISMATCH", "PDF417": "BARCODE_PRINT_MISMATCH"}
ROLES = {"expiry": "EXPIRY", "issue": "ISSUE", "dob": "DATE_OF_BIRTH"}


def implausible(expiry: Column, issue: Column, dob: Column, as_of: Column) -> Column:
    """Anomalies of a triple of dates, each of which may be null."""
    return F.array_compact(F.array(
        F.when(expiry < issue, "EXPIRY_BEFORE_ISSUE"),
        F.when(dates.exceeds_anniversary(issue, expiry, MOST_YEARS), "IMPLAUSIBLE_VALIDITY_PERIOD"),
        F.when(expiry < dob, "DOB_AFTER_EXPIRY"),
        F.when(issue > as_of, "FUTURE_DATED_ISSUE"),
    ))


def cross_check(source: Column, machine: Column, printed: Column, as_of: Column, base: float = SURE) -> Column:
    """Struct (anomalies, agreement, confidence, force_review, comparisons) of two structs (expiry, issue, dob); a null struct was not read.

    Values that differ are both kept: the difference is an anomaly, never a tie to break.
    """
    own = F.coalesce(implausible(machine["expiry"], machine["issue"], machine["dob"], as_of), F.array().cast("array<string>"))
    other = F.coalesce(implausible(printed["expiry"], printed["issue"], printed["dob"], as_of), F.array().cast("array<string>"))
    pairs = F.array(*(F.struct(F.lit(role).alias("role"), machine[k].alias("machine"), printed[k].alias("printed"), (machine[k] == printed[k]).alias("agrees")) for k, role in ROLES.items()))

    def body(c: Column) -> Column:
        wrong = F.filter(c, lambda p: ~p["agrees"])
        code = F.when(source == "MRZ", MISMATCH["MRZ"]).otherwise(MISMATCH["PDF417"])
        anomalies = F.array_distinct(F.concat(own, other, F.when(F.size(wrong) > 0, F.array(code)).otherwise(F.array().cast("array<string>"))))
        names = lambda rows: F.array_join(F.transform(rows, lambda p: p["role"]), ", ")
        agreement = F.when(F.size(c) > 0, F.concat(source, F.when(F.size(wrong) == 0, F.concat(F.lit(" agrees with the printed values on "), names(c))).otherwise(F.concat(F.lit(" disagrees with the printed values on "), names(wrong)))))
        confidence = F.when(F.size(wrong) > 0, F.least(F.lit(base), F.lit(DISPUTED))).when(F.size(c) > 0, F.least(F.lit(1.0), F.lit(base + AGREED))).otherwise(F.lit(base))
        return F.struct(anomalies.alias("anomalies"), agreement.alias("agreement"), confidence.alias("confidence"), (F.size(anomalies) > 0).alias("force_review"), c.alias("comparisons"))

    return dates.let(F.filter(pairs, lambda p: p["machine"].isNotNull() & p["printed"].isNotNull()), body)
