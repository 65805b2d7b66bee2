"""The ladder of readers on documents with nothing known, without models, and where a call is not the document's own."""

import datetime as dt

from pyspark.sql import functions as F

from veridate.operators import ladder, pages
from veridate.plans import ladder as plan

DOCUMENT = f"""doc_id long, rejected string, likeness_negative boolean, screen_negative boolean, text_layer string, barcode string, tokens {pages.TOKENS}, ocr_confidence double, width int, height int, pages int, pdf boolean, blur double, dpi double,
  clipping double, quality_codes array<string>, elapsed_ms long, kind string"""
CALL = "doc_id long, hunter string, hunter_label string, hunter_snippet string, hunter_ok boolean, mapper array<struct<raw:string,role:string,illegible:boolean,label:string,snippet:string>>, mapper_ok boolean, failures array<string>, injected boolean, kind string, issuer string, usd double, budget_usd double"


def as_of():
    return F.lit("2026-08-09").cast("date")


def words(*lines):
    return [(w, i, (100.0 + 130 * j, 100.0 + 60 * i, 220.0 + 130 * j, 130.0 + 60 * i), 90.0) for i, line in enumerate(lines) for j, w in enumerate(line.split())]


def document(doc_id, lines=None, **more):
    row = dict.fromkeys(x.split()[0] for x in ("rejected likeness_negative screen_negative text_layer barcode tokens ocr_confidence width height pages pdf blur dpi clipping quality_codes elapsed_ms kind").split())
    return (doc_id, *(row | {"tokens": None if lines is None else words(*lines)} | more).values())


def test_documents_with_little_known(spark):
    rows = [
        document(1), document(2, []), document(3, ["EXPIRES 2030-04-23", "passport of ohio"]), document(4, ["passport", "VALID UNTIL NON-EXPIRING 2030-01-01"], quality_codes=["IMAGE_TOO_BLURRY"], ocr_confidence=10.0),
        document(5, ["passport"], likeness_negative=True), document(6, rejected="ENCRYPTED_PDF"), document(7, text_layer="passport\nEXPIRES 2030-04-23", pdf=True, width=0, height=0), document(8, barcode="a boarding pass"),
        document(9, ["passport"], ocr_confidence=12.0),
    ]
    docs, none = spark.createDataFrame(rows, DOCUMENT), spark.createDataFrame([], CALL)
    found, counts = ladder.run(docs, none, as_of())
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == set(range(1, 10)) and counts["documents"] == 9 and counts["admitted"] == 7 and counts["TC_VLM"] == 0
    assert all(r.codes for r in got.values() if r.decision == "REVIEW")
    assert (got[3].source_tier, got[3].date, got[3].admission) == ("TB_OCR", dt.date(2030, 4, 23), "ADMIT_FULL")
    assert got[5].decision == "REJECTED" and "NOT_A_DOCUMENT_IMAGE" in got[5].codes and got[5].spend_avoided_usd == 0.08
    assert got[6].decision == "REVIEW" and got[6].codes == ["ENCRYPTED_PDF"]
    assert {"MODEL_UNAVAILABLE", "NO_MACHINE_READABLE_REGION"} <= set(got[7].codes) and got[7]["class"] in ("PASSPORT", "OTHER_DOCUMENT")
    assert got[8].admission == "ADMIT_LIMITED" and "NO_DOMAIN_SIGNAL" in got[8].codes and got[8].spend_avoided_usd == 0.08
    assert "MIXED_ORIENTATION_SUSPECTED" in got[9].codes and "MIXED_ORIENTATION_SUSPECTED" not in got[4].codes
    assert not ladder.run(docs.where("false"), none, as_of())[0].collect()


def test_endless_by_its_own_words(spark):
    docs = spark.createDataFrame([document(1, ["driver license of texas driver license", "EXPIRES 2030-04-23"]), document(2, ["member id group number copay subscriber", "no termination date"])], DOCUMENT)
    found, _ = ladder.run(docs, spark.createDataFrame([], CALL), as_of())
    got = {r.doc_id: r for r in found.collect()}
    assert (got[1].basis, got[1].verdict) == ("EXPIRY_DATE", "VALID")
    assert (got[2].basis, got[2].verdict, got[2].date) == ("NO_EXPIRY", "NOT_APPLICABLE", None)


def test_models_are_asked_for_open_documents_only(spark):
    docs = spark.createDataFrame([document(1, ["EXPIRES 2030-04-23", "passport passeport"]), document(2, ["passport passeport"])], DOCUMENT)
    entry = [("23 APR 2031", "UNKNOWN", False, "EXPIRY", "mapper")]
    calls = spark.createDataFrame([(i, "04/23/2031", None, "hunter", True, entry, True, [], i == 2, None, None, 0.03, None) for i in (1, 2, 3)], CALL)
    found, counts = ladder.run(docs, calls, as_of())
    got = {r.doc_id: r for r in found.collect()}
    assert counts["open"] == counts["TC_VLM"] == 1 and set(got) == {1, 2}
    assert (got[1].source_tier, got[1].cost_usd) == ("TB_OCR", 0.0)
    assert (got[2].source_tier, got[2].cost_usd, got[2].date, got[2].label) == ("TC_VLM", 0.03, dt.date(2031, 4, 23), "EXPIRY")
    assert {"PROMPT_INJECTION_SUSPECTED", "VALUE_NOT_GROUNDED_IN_OCR"} <= set(got[2].codes)


def test_one_pass_without_shuffle_until_calls_are_joined(spark):
    docs, _ = plan.inputs(spark, "/root/testdata/sf0.001")
    text = ladder.read_locally(docs, as_of())._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 0 and "Join" not in text
