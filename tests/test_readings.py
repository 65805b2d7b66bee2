"""Golden values of dates, machine-readable zones, payloads, labels and verdicts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veridate.functions import dates, machine, text
from veridate.operators import classify, constraints, layout, verdict

D = dt.date


def as_of():
    return F.lit("2026-08-09").cast("date")


@pytest.mark.parametrize(
    "raw, convention, iso, ambiguous",
    [
        ("03/25/2028", None, D(2028, 3, 25), False), ("25/03/2028", None, D(2028, 3, 25), False), ("03/04/2028", None, None, True), ("03/04/2028", "US", D(2028, 3, 4), False),
        ("03/04/2028", "DMY", D(2028, 4, 3), False), ("01/2028", "US", D(2028, 1, 31), False), ("02/2028", "US", D(2028, 2, 29), False), ("15 MAR 2028", None, D(2028, 3, 15), False),
        ("MARCH 15, 2028", None, D(2028, 3, 15), False), ("15 ENERO 2028", None, D(2028, 1, 15), False), ("15 avril 2028", None, D(2028, 4, 15), False), ("30/02/2028", None, None, False),
        ("20280315", None, D(2028, 3, 15), False), ("2028-03-15", None, D(2028, 3, 15), False), ("MARCH 28", None, D(2028, 3, 31), False), ("hello", None, None, False), ("", None, None, False), (None, None, None, None),
    ],
)
def test_free_text(spark, raw, convention, iso, ambiguous):
    df = spark.createDataFrame([(raw, convention)], "raw string, convention string")
    r = df.select(dates.free_text_date(F.col("raw"), F.col("convention"), F.lit("EXPIRY"), as_of()).alias("r")).first().r
    assert r.iso == iso
    if ambiguous is not None:
        assert r.ambiguous == ambiguous


def test_ranges_years_and_variants(spark):
    one = spark.range(1)
    r = one.select(dates.date_range(F.lit("01/2026 – 01/2028"), F.lit("US"), F.lit("COVERAGE_END"), as_of()).alias("r"), dates.date_range(F.lit("03/01/2026"), F.lit("US"), F.lit("EXPIRY"), as_of()).alias("n")).first()
    assert (r.r.start, r.r.end, r.n) == (D(2026, 1, 31), D(2028, 1, 31), None)
    years = one.select(*(dates.full_year(F.lit(y), F.lit("DATE_OF_BIRTH"), as_of()).alias(f"y{y}") for y in (95, 10, 27))).first()
    assert tuple(years) == (1995, 2010, 1927)
    assert set(one.select(dates.confusable_variants(F.lit("10")).alias("v")).first().v) == {"70", "18"}
    assert one.select(dates.years_after(F.lit("2024-02-29").cast("date"), 1).alias("d")).first().d == D(2025, 2, 28)


def test_check_digits_and_lines(spark):
    one = spark.range(1)
    assert tuple(one.select(*(machine.check_digit(F.lit(x)).alias(x) for x in ("L898902C3", "740812", "120415"))).first()) == ("6", "2", "9")
    good, bad = "L898902C36GBR7408122F3104150ZE184226B<<<<<16", "L898902C36GBR7408122F3104151ZE184226B<<<<<16"
    r = one.select(machine.td3_failures(F.lit(good)).alias("a"), machine.td3_failures(F.lit(bad)).alias("b")).first()
    assert r.a == [] and "expiry_date" in r.b
    d = one.select(dates.mrz_date(F.lit("190315"), F.lit("EXPIRY"), as_of()).alias("a"), dates.mrz_date(F.lit("310420"), F.lit("EXPIRY"), as_of()).alias("b")).first()
    assert (d.a, d.b) == (D(2019, 3, 15), D(2031, 4, 20))


@pytest.mark.parametrize("value, country, version, iso, conflict", [("05202028", "USA", 10, D(2028, 5, 20), False), ("05202028", "CAN", 10, None, True), ("20280520", "CAN", 10, D(2028, 5, 20), False), ("20291231", None, 1, D(2029, 12, 31), False), ("0423203", "USA", 10, None, False)])
def test_payload_dates(spark, value, country, version, iso, conflict):
    df = spark.createDataFrame([(value, country, version)], "v string, c string, n int")
    r = df.select(machine.aamva_resolved(F.col("v"), F.col("c"), F.col("n")).alias("r")).first().r
    assert (r.iso, r.conflict) == (iso, conflict)


CASES = [
    ([("DATE_OF_BIRTH", "1990-04-23"), ("ISSUE", "2024-04-23"), ("UNKNOWN", "2030-04-23"), ("UNKNOWN", "2091-04-23")], "2030-04-23", {"IMPLAUSIBLE_VALIDITY_PERIOD"}),
    ([("ISSUE", "2010-01-01"), ("EXPIRY", "2030-01-01")], "2030-01-01", set()),
    ([("ISSUE", "2010-01-01"), ("EXPIRY", "2030-01-02")], None, {"IMPLAUSIBLE_VALIDITY_PERIOD"}),
    ([("DATE_OF_BIRTH", "2000-06-15"), ("EXPIRY", "2015-06-15")], "2015-06-15", set()),
    ([("DATE_OF_BIRTH", "1990-04-23"), ("ISSUE", "2024-01-15"), ("UNKNOWN", "2030-04-23"), ("UNKNOWN", "2029-11-02")], "2030-04-23", set()),
    ([("TRANSACTION", "2024-02-17"), ("TRANSACTION", "2023-02-24")], None, set()),
    ([("ISSUE", "2024-04-23"), ("EXPIRY", "2020-04-23")], None, {"EXPIRY_BEFORE_ISSUE"}),
    ([("ISSUE", "2027-01-01")], None, {"FUTURE_DATED_ISSUE"}),
]


def test_constraint_cases(spark):
    data = [(i, n, role, D.fromisoformat(iso), iso) for i, (cands, _, _) in enumerate(CASES) for n, (role, iso) in enumerate(cands)]
    df = spark.createDataFrame(data, "doc_id long, cand_ord int, role string, iso date, raw string").selectExpr("*", "'PASSPORT' class", "true identity", "false recency_validated", "cast(null as boolean) cross_call", "cast(null as boolean) grounded")
    out = constraints.outcome(constraints.score(constraints.eliminate(df, as_of())), as_of())
    found = {r.doc_id: r for r in out.collect()}
    for i, (_, winner, anomalies) in enumerate(CASES):
        assert (found[i].winner_iso.isoformat() if found[i].winner_iso else None) == winner, i
        assert set(found[i].anomalies) == anomalies, i


def test_verdicts_and_confidence(spark):
    df = spark.createDataFrame([("PASSPORT", D(2019, 3, 15)), ("BANK_STATEMENT", D(2026, 6, 30)), ("UTILITY_BILL", D(2026, 1, 5)), ("EMPLOYMENT_LETTER", None), ("OTHER_DOCUMENT", D(2024, 2, 17)), ("PASSPORT", D(2026, 8, 9)), ("PASSPORT", None)], "class string, d date")
    out = verdict.validity(df, F.col("d"), as_of()).collect()
    assert [r.verdict for r in out] == ["EXPIRED", "VALID", "EXPIRED", "NOT_APPLICABLE", "INDETERMINATE", "VALID", "INDETERMINATE"]
    assert out[4].date is None
    cols = "tier string, checksum boolean, cross_source boolean, cross_call_ok boolean, grounded_ok boolean, blur double, dpi double, checks int, survivors int, winner_score100 int"
    rows = [("TA_PDF417", True, None, None, None, None, None, 3, 1, 40), ("TA_MRZ", False, None, None, None, None, None, 2, 1, 0), ("TC_VLM", None, None, False, False, None, None, 1, 1, 0), ("TC_VLM", None, None, True, True, 12.0, None, 2, 1, 20)]
    df = spark.createDataFrame(rows, cols)
    assert [r[0] for r in df.select(verdict.confidence(df)).collect()] == [1.0, 0.49, 0.14, 0.7]


def test_text_shape_and_placement(spark):
    one = spark.range(1)
    r = one.select(text.label_form(F.lit("  Données: 4b.")).alias("f"), text.similarity(F.lit("EXPIRAT10N DATE"), F.lit("EXPIRATION DATE")).alias("s"), text.is_sentinel(F.lit("Non-Expiring")).alias("a"), text.is_sentinel(F.lit("NANCY")).alias("b"), text.grounded(F.lit("04/23/2030"), F.lit("EXP 04 23 2030")).alias("g")).first()
    assert r.f == "DONNEES 4B" and r.s >= 0.85 and r.a and not r.b and r.g
    sizes = {(1600, 1009): "ID1_CARD", (2550, 3300): "PAPER", (1000, 1000): "SQUARE", (3000, 500): "UNUSUAL", (0, 5): "UNUSUAL"}
    for (w, h), shape in sizes.items():
        assert one.select(classify.shape(F.lit(w), F.lit(h)).alias("s")).first().s == shape
    low = one.select(*(classify.too_low_resolution(F.lit(w), F.lit(h), F.lit(b)).alias(str(w)) for w, h, b in ((250, 178, 16402), (2000, 1266, 900000), (1200, 760, 51199)))).first()
    assert tuple(low) == (True, False, False)
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))
    label = box(100, 100, 200, 130)
    p = one.select(*(layout.place(label, box(*v)).alias(f"p{i}") for i, v in enumerate(((230, 100, 400, 130), (100, 175, 280, 205), (800, 175, 900, 205), (700, 100, 800, 130), (100, 20, 200, 50))))).first()
    assert (p.p0.relation, p.p0.distance, p.p1.relation) == ("RIGHT", 1.0, "BELOW") and p.p2 is None and p.p3 is None and p.p4 is None
