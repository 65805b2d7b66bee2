"""Documents from upload to response through all readers, over sixteen kinds of documents derived from customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.functions import machine
from veridate.operators import ladder
from veridate.plans.orders import as_of, read, spread
from veridate.plans.pages import _boxed

#: A specimen's zone (ICAO 9303) with a wrong check digit of the expiry.
_DAMAGED = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204158ZE184226B<<<<<10"]
_ENTRY = "array<struct<raw:string,role:string,illegible:boolean,label:string,snippet:string>>"


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and what two models say of some of them, by customer."""
    k = F.col("c_custkey")
    v, part = k % 16, F.floor(k / 16) % 3
    e = F.date_add(F.lit("1996-01-01").cast("date"), (k * 13 % 1500).cast("int"))
    d = F.when(k % 2 == 0, F.add_months(e, -60)).otherwise(F.add_months(e, -84))
    b = F.when(k % 3 == 0, F.add_months(e, -360)).otherwise(F.date_add(F.add_months(e, -360), 40))
    form = lambda x, f: F.date_format(x, f)
    iso, us, six = "yyyy-MM-dd", "MMddyyyy", "yyMMdd"
    base = spread(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("doc_id"), v.alias("v"), part.alias("part"), e.alias("e"), d.alias("d"), b.alias("b"))
    c = F.col
    check = lambda x: F.concat(x, machine.check_digit(x))
    shown = F.when((c("v") == 13) & (c("doc_id") % 2 == 1), F.date_add("e", 1)).otherwise(c("e"))
    base = base.withColumns({"n": check(F.concat(F.lit("L"), F.lpad(c("doc_id").cast("string"), 8, "0"))), "zb": check(form(c("b"), six)), "ze": check(form(shown, six))})
    rest = F.lit("<<<<<<<<<<<<<<0")
    zone = F.concat("n", F.lit("GBR"), "zb", F.lit("F"), "ze", rest, machine.check_digit(F.concat("n", "zb", "ze", rest)))
    head = F.rpad(F.lit("P<GBRDOE<<JANE<"), 44, "<")
    country, state = F.when(c("v") == 4, "CAN").otherwise("USA"), F.when(c("v") == 4, "ON").otherwise("CA")
    payload = F.concat(F.lit("@\n\x1e\rANSI 636014100101DL00310100DLDBA"), form(c("e"), us), F.lit("\nDBD"), form(c("d"), us), F.lit("\nDBB"), form(c("b"), us), F.lit("\nDCAD\nDCG"), country, F.lit("\nDAJ"), state, F.lit("\r"))
    words = lambda *x: F.concat(*(F.split(w, " ") if isinstance(w, Column) else F.array(F.lit(w)) for w in x))
    line = lambda x: words(F.lit(x))
    lines = (
        F.when(c("v") == 4, F.array(words("EXPIRES", form(c("e"), iso)), line("DRIVER LICENSE TEXAS")))
        .when(c("v") == 5, F.array(line("REPUBLIC OF UTOPIA"), F.array(head), F.array(zone)))
        .when(c("v") == 6, F.array(line("REPUBLIC OF UTOPIA"), *(F.array(F.lit(x)) for x in _DAMAGED)))
        .when(c("v") == 7, F.array(line("ACCOUNT STATEMENT OPENING BALANCE CLOSING BALANCE"), words(F.lit("STATEMENT DATE"), form(c("e"), iso))))
        .when(c("v") == 8, F.array(line("TO WHOM IT MAY CONCERN"), line("CONFIRMATION OF EMPLOYMENT JOB TITLE")))
        .when(c("v") == 9, F.array(line("UNION OF STATES DRIVING LICENCE")))
        .when(c("v") == 10, F.array(line("IDENTITY CARD")))
        .when(c("v") == 12, F.array(line("MEMBER ID GROUP NUMBER COPAY"), line("COVERAGE CONTINUOUS WHILE EMPLOYED")))
        .when(c("v") >= 14, F.array(line("PASSPORT PASSEPORT")))
        .otherwise(F.array(line("hello there general")))
    )
    none = F.lit(None)
    documents = base.select(
        "doc_id", F.when(c("v") == 0, "EMPTY_FILE").when(c("v") == 1, "CORRUPT_FILE").alias("rejected"), F.lit(False).alias("likeness_negative"), (c("v") == 2).alias("screen_negative"),
        F.when(c("v") == 13, F.concat_ws("\n", F.lit("UNITED STATES"), head, zone)).alias("text_layer"), F.when(c("v").isin(3, 4, 13), payload).alias("barcode"), _boxed(lines, F.lit(90.0)).alias("tokens"),
        F.when(c("v") == 14, 20.0).otherwise(90.0).alias("ocr_confidence"), F.lit(1000).alias("width"), F.lit(1400).alias("height"), F.lit(1).alias("pages"), (c("v") == 13).alias("pdf"), F.lit(200.0).alias("blur"), F.lit(300.0).alias("dpi"), F.lit(0.0).alias("clipping"),
        F.array().cast("array<string>").alias("quality_codes"), F.when((c("v") == 15) & (c("part") == 0), 42000).when((c("v") == 15) & (c("part") == 1), 38000).otherwise(900).cast("long").alias("elapsed_ms"),
    )
    entry = lambda raw, role, snippet: F.array(F.struct(raw, F.lit(role), F.lit(False), none.cast("string"), snippet)).cast(_ENTRY)
    long_form = form(c("e"), "dd MMM yyyy")
    slashed = form(F.make_date(1999 + c("doc_id") % 2, 1 + c("doc_id") % 12, 1 + F.floor(c("doc_id") / 16) % 12), "dd/MM/yyyy")
    mapper = (
        F.when(c("v") == 6, entry(long_form, "EXPIRY", F.when(c("doc_id") % 2 == 0, "mapper and hunter").otherwise("mapper")))
        .when(c("v") == 9, entry(slashed, "EXPIRY", none.cast("string")))
        .when(c("v") == 10, entry(form(c("d"), iso), "ISSUE", F.lit("mapper")))
        .otherwise(F.array().cast(_ENTRY))
    )
    calls = base.where(c("v").isin(6, 8, 9, 10, 14, 15)).select(
        "doc_id", F.when(c("v").isin(6, 10), long_form).when(c("v") == 9, slashed).alias("hunter"), F.when(c("v") == 10, "Expires").alias("hunter_label"), F.when(c("v") == 10, "hunter").alias("hunter_snippet"), (c("v") != 14).alias("hunter_ok"),
        mapper.alias("mapper"), (c("v") != 14).alias("mapper_ok"), F.when(c("v") == 14, F.array(F.lit("RATE_LIMITED"), F.lit("TIMEOUT"))).otherwise(F.array().cast("array<string>")).alias("failures"), F.lit(False).alias("injected"),
        F.when(c("v") == 6, "PASSPORT").when(c("v") == 9, "NON_US_DRIVERS_LICENSE").when(c("v") == 10, "NATIONAL_ID_CARD").alias("kind"), F.when(c("v") == 9, "INDIA").alias("issuer"), F.when(c("v") == 14, 0.0).otherwise(0.05).alias("usd"), F.when((c("v") == 15) & (c("part") == 2), 0.05).alias("budget_usd"),
    )
    return documents, calls


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's response after all readers that it needed."""
    found, _ = ladder.run(*inputs(spark, sf_dir), as_of())
    joined = lambda x: F.array_join(F.array_sort(x), ";")
    return found.select("doc_id", "class", "class_confidence", "issuer", "side", "basis", F.date_format("date", "yyyy-MM-dd").alias("date"), "date_raw", "verdict", "days_remaining", "decision", "confidence", joined("codes").alias("codes"), "source_tier", "label", "checksum", "cross_source", joined("anomalies").alias("anomalies"), F.size("dates_found").alias("n_dates"), "admission", "spend_avoided_usd", "cost_usd")


def ladder_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents came to each reader, as observed by the jobs that read them."""
    _, counts = ladder.run(*inputs(spark, sf_dir), as_of())
    return spark.createDataFrame(list(counts.items()), "reader string, documents long")


_KINDS = """WITH k AS (SELECT c_custkey k, c_custkey % 16 v, c_custkey // 16 % 3 part, CAST(DATE '1996-01-01' + CAST(c_custkey * 13 % 1500 AS INTEGER) AS DATE) e FROM customer),
  i AS (SELECT *, CAST(e - CASE WHEN k % 2 = 0 THEN INTERVAL 5 YEAR ELSE INTERVAL 7 YEAR END AS DATE) d, CAST(e - INTERVAL 30 YEAR AS DATE) + CASE WHEN k % 3 = 0 THEN 0 ELSE 40 END b, CAST(make_date(1999 + k % 2, 1 + k % 12, 1 + k // 16 % 12) AS DATE) x FROM k),
  s AS (SELECT *, CASE WHEN len(list_filter([4, 5, 6, 8, 10], lambda t: abs(date_diff('day', d, e) / CAST(365.2425 AS DOUBLE) - t) < CAST(0.15 AS DOUBLE))) > 0 THEN 15 ELSE 0 END typical, CASE WHEN strftime(e, '%m-%d') = strftime(b, '%m-%d') THEN 25 ELSE 0 END birthday, CASE WHEN e > DATE '1998-08-02' THEN 0.02 ELSE 0 END ahead, v = 13 AND k % 2 = 1 odd FROM i),
  w AS (SELECT *, odd AND birthday = 0 later FROM s),
  u AS (SELECT *, CASE WHEN v IN (3, 4, 5, 6, 7, 10, 13) THEN CASE WHEN later THEN e + 1 ELSE e END WHEN v = 9 THEN x END won,
    CASE WHEN v IN (0, 1, 2) THEN 'NOT_A_DOCUMENT' WHEN v IN (3, 4) THEN 'US_DRIVERS_LICENSE' WHEN v IN (5, 6, 13, 14) OR (v = 15 AND part > 0) THEN 'PASSPORT' WHEN v = 7 THEN 'BANK_STATEMENT' WHEN v = 8 THEN 'EMPLOYMENT_LETTER' WHEN v = 9 THEN 'NON_US_DRIVERS_LICENSE' WHEN v = 10 THEN 'NATIONAL_ID_CARD' WHEN v = 12 THEN 'MEDICAL_INSURANCE_CARD' ELSE 'OTHER_DOCUMENT' END AS "class" FROM w)"""

QUERIES = {f.__name__: f for f in (document_verdicts, ladder_flow)}
ORACLES = {
    "document_verdicts": f"""{_KINDS},
  y AS (SELECT *, CASE WHEN v IN (0, 1, 2) OR "class" = 'OTHER_DOCUMENT' THEN 'UNDETERMINED' WHEN v = 7 THEN 'RECENCY_WINDOW' WHEN v IN (8, 12) THEN 'NO_EXPIRY' ELSE 'EXPIRY_DATE' END basis,
    CASE WHEN v = 7 THEN 180 - date_diff('day', e, DATE '1998-08-02') WHEN won IS NOT NULL THEN date_diff('day', DATE '1998-08-02', won) END left_,
    CASE WHEN v IN (3, 5, 13) THEN 1 WHEN v IN (4, 7) THEN 0.90 + ahead WHEN v = 6 THEN CASE WHEN k % 2 = 0 THEN 0.47 ELSE 0.30 END + ahead WHEN v = 9 THEN 0.32 WHEN v = 10 THEN 0.20 + typical * 0.002 WHEN v = 8 THEN 0.92 WHEN v = 0 THEN 1 WHEN v = 2 THEN 0.9 ELSE 0 END sure,
    list_sort(list_filter([CASE WHEN v = 0 THEN 'CLASS_UNRECOGNIZED' WHEN v = 1 THEN 'CORRUPT_FILE' END, CASE WHEN v = 2 THEN 'OUT_OF_DOMAIN' END, CASE WHEN v = 2 THEN 'SCREEN_CAPTURE_NOT_DOCUMENT' END,
      CASE WHEN v IN (4, 9) THEN 'AMBIGUOUS_DATE_FORMAT' END, CASE WHEN v >= 4 AND v <> 13 THEN 'NO_MACHINE_READABLE_REGION' END, CASE WHEN v IN (5, 6) OR v BETWEEN 8 AND 12 OR v >= 14 THEN 'NO_DATES_FOUND' END, CASE WHEN v = 6 THEN 'CHECKSUM_FAILED' END, CASE WHEN v IN (6, 9, 10) THEN 'VALUE_NOT_GROUNDED_IN_OCR' END,
      CASE WHEN v = 8 THEN 'NO_EXPIRY_SEMANTICS' END, CASE WHEN v = 10 THEN 'HUNTER_MAPPER_DISAGREE' END, CASE WHEN v = 11 THEN 'NO_DOMAIN_SIGNAL' END, CASE WHEN v = 12 OR odd THEN 'MODEL_UNAVAILABLE' END, CASE WHEN odd THEN 'MRZ_VIZ_MISMATCH' END, CASE WHEN later THEN 'MULTIPLE_EXPIRY_CANDIDATES' END,
      CASE WHEN v = 14 THEN 'MIXED_ORIENTATION_SUSPECTED' END, CASE WHEN v = 14 THEN 'RATE_LIMITED' END, CASE WHEN v = 14 OR (v = 15 AND part < 2) THEN 'TIMEOUT' END, CASE WHEN v = 15 AND part = 2 THEN 'COST_CAP_REACHED' END], lambda c: c IS NOT NULL)) codes FROM u),
  z AS (SELECT *, CASE WHEN v IN (0, 2, 8, 12) THEN 'NOT_APPLICABLE' WHEN basis = 'UNDETERMINED' OR won IS NULL THEN 'INDETERMINATE' WHEN left_ >= 0 THEN 'VALID' ELSE 'EXPIRED' END verdict FROM y)
  SELECT k doc_id, "class", CAST(CASE WHEN v < 3 THEN 0 WHEN v = 3 THEN 0.96 WHEN v = 4 THEN 0.73 WHEN v IN (5, 12, 13) THEN 0.97 WHEN v IN (6, 9, 10) THEN 0.7 WHEN "class" = 'OTHER_DOCUMENT' THEN 0.25 ELSE 0.89 END AS DOUBLE) class_confidence,
    CASE WHEN v = 3 THEN 'CA' WHEN v = 4 THEN 'TX' WHEN v IN (5, 13) THEN 'GBR' WHEN v = 6 THEN 'UTO' WHEN v = 9 THEN 'INDIA' END issuer, CASE WHEN v < 3 OR v IN (7, 8) THEN 'N/A' WHEN v = 3 THEN 'BACK' WHEN v IN (5, 13) THEN 'FRONT' ELSE 'UNKNOWN' END side, basis,
    strftime(won, '%Y-%m-%d') AS "date", CASE WHEN v = 3 OR (v = 13 AND NOT later) THEN strftime(e, '%m%d%Y') WHEN v IN (4, 7) THEN strftime(e, '%Y-%m-%d') WHEN v = 5 OR later THEN strftime(won, '%y%m%d') WHEN v IN (6, 10) THEN strftime(e, '%d %b %Y') WHEN v = 9 THEN strftime(x, '%d/%m/%Y') END date_raw, verdict, CAST(left_ AS INTEGER) days_remaining,
    CASE WHEN v IN (0, 2) THEN 'REJECTED' WHEN v = 8 THEN 'AUTO_PASS' WHEN v IN (3, 5) OR (v = 13 AND NOT odd) THEN CASE WHEN verdict = 'VALID' THEN 'AUTO_PASS' ELSE 'AUTO_FAIL' END ELSE 'REVIEW' END decision, CAST(round(sure, 4) AS DOUBLE) confidence, array_to_string(codes, ';') codes,
    CASE WHEN v = 3 OR (v = 13 AND NOT later) THEN 'TA_PDF417' WHEN v = 5 OR later THEN 'TA_MRZ' WHEN v IN (4, 7) THEN 'TB_OCR' WHEN v IN (6, 9, 10) THEN 'TC_VLM' ELSE 'NONE' END source_tier,
    CASE WHEN v = 3 OR (v = 13 AND NOT later) THEN 'DBA (document expiration date)' WHEN v = 4 THEN 'EXPIRES' WHEN v = 7 THEN 'STATEMENT DATE' WHEN v = 5 OR later THEN 'MRZ expirationDate' WHEN v = 10 THEN 'Expires' END AS "label",
    CASE WHEN v IN (3, 5, 13) THEN true END AS "checksum", CASE WHEN v = 13 THEN CASE WHEN odd THEN 'MRZ disagrees with the printed values on EXPIRY' ELSE 'MRZ agrees with the printed values on EXPIRY, DATE_OF_BIRTH' END END cross_source, CASE WHEN v = 6 THEN 'CHECKSUM_FAILED' WHEN odd THEN 'MRZ_VIZ_MISMATCH' ELSE '' END anomalies,
    CAST(CASE WHEN odd THEN 4 WHEN v IN (3, 13) THEN 3 WHEN v IN (5, 10) THEN 2 WHEN v IN (4, 6, 7, 9) THEN 1 ELSE 0 END AS INTEGER) n_dates, CASE WHEN v < 2 THEN NULL WHEN v = 2 THEN 'REJECT' WHEN v = 11 THEN 'ADMIT_LIMITED' ELSE 'ADMIT_FULL' END admission,
    CAST(CASE WHEN v IN (2, 11) THEN 0.08 END AS DOUBLE) spend_avoided_usd, CAST(CASE WHEN v IN (6, 8, 9, 10) THEN 0.05 ELSE 0 END AS DOUBLE) cost_usd FROM z""",
    "ladder_flow": f"""{_KINDS}, f AS (SELECT *, v >= 3 admitted, v >= 4 AND v <> 13 AND NOT (v = 15 AND part = 0) page, v IN (6, 8, 9, 10, 11, 12, 14, 15) OR odd open FROM u),
  n AS (SELECT count(*) a, count(*) FILTER (admitted) b, count(*) FILTER (page) c, count(*) FILTER (page OR v = 13) d, count(*) FILTER (open) e, count(*) FILTER (v IN (6, 8, 9, 10, 14) OR (v = 15 AND part = 2)) f FROM f)
  SELECT unnest(['documents', 'admitted', 'TA_PDF417', 'TB_OCR', 'TA_MRZ', 'open', 'TC_VLM']) reader, unnest([a, b, b, c, d, e, f]) documents FROM n""",
}
