"""Golden values of labels, scripts, date shapes, zones, classes, cross-checks, rejections and call merges."""

import datetime as dt

from pyspark.sql import functions as F

from veridate.functions import dates, labels, machine, phrases, text, tokens
from veridate.operators import classify, crosscheck, evaluate, gate, pages, respond, twocalls

D = dt.date


def as_of():
    return F.lit("2026-08-09").cast("date")


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_month_names_of_all_languages(spark):
    raw = {"15 ENE 2028": 1, "15 OKT 2028": 10, "15 DIC 2028": 12, "15 AVR 2028": 4, "15 MÄRZ 2028": 3, "15 FÉVRIER 2028": 2, "15 ABR 2028": 4, "15 JUIL 2028": 7, "15 AGO 2028": 8, "15 AOÛT 2028": 8, "15 DEZ 2028": 12, "15 GEN 2028": 1}
    df = spark.createDataFrame([(r, m) for r, m in raw.items()], "raw string, month int")
    for r in df.select("raw", "month", dates.free_text_date(F.col("raw"), F.lit(None).cast("string"), F.lit("EXPIRY"), as_of())["iso"].alias("iso")).collect():
        assert r.iso == D(2028, r.month, 15), r.raw


def test_sentinels_and_labels(spark):
    yes = ["NIL", "Indefinitely", "NON-EXPIRING", "NonExpiring", "n/a", "Does not expire", "PERMANENT", "Unlimited"]
    no = ["NEVER", "LIFETIME", "INDEF", "NANCY", ""]
    df = spark.createDataFrame([(x,) for x in yes + no], "x string")
    assert [r[0] for r in df.select(text.is_sentinel(F.col("x"))).collect()] == [True] * len(yes) + [False] * len(no)
    cases = {"EXP.": ("EXP", "EXPIRY"), "EXPIRAT10N DATE": ("EXPIRATION DATE", "EXPIRY"), "Date of issue": ("DATE OF ISSUE", "STATEMENT_PERIOD_END"), "4b": ("4B", "EXPIRY"), "4c": None, "EXPORT": None, "Fecha de Vencimiento": ("FECHA DE VENCIMIENTO", "EXPIRY"), "ISSUED": None, "DOB": None, "billing date": None}
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", labels.match(text.label_form(F.col("x"))).alias("m"))
    assert {r.x: (r.m.canonical, r.m.role) if r.m else None for r in df.collect()} == cases
    r = one(spark, a=labels.declares_no_expiry(F.lit("VALID: NON-EXPIRING")), b=labels.declares_no_expiry(F.lit("EXPIRES 04/23/2030")), f=text.label_form(F.lit("Ǆ Żółć ﬁ émigré ß")))
    assert r.a and not r.b and r.f == "ZO C FI EMIGRE SS"


def test_documents_that_say_they_have_no_end(spark):
    cases = {"VALID: NON-EXPIRING": True, "NON-EXPIRING": True, "permanent": True, "Coverage continuous while employed": True, "EXPIRES 04/2030": False, "Expiry date: N/A": False, "": False, None: False}
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", labels.declares_no_expiry(F.col("x")).alias("d"))
    assert {r.x: r.d for r in df.collect()} == cases


def test_phrases_of_one_pass(spark):
    texts = ["ushers", "", None, "he she", "x" * 2_000_000 + "hers"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", phrases.hits(F.col("t"), ["he", "she", "his", "hers", "he"]).alias("h"))
    assert {r.i: r.h for r in df.collect()} == {0: [0, 1, 3], 1: [], 2: None, 3: [0, 1], 4: [0, 3]}


def test_misreads_and_repairs_both_ways(spark):
    is_date = lambda v: F.try_to_date(v, "MM/dd/yyyy").isNotNull()
    r = one(spark, a=dates.probable_misread(F.lit("81/01/2030"), is_date), b=dates.probable_misread(F.lit("99/99/2030"), is_date), c=dates.probable_misread(F.lit("0/8"), is_date))
    assert (r.a, r.b, r.c) == (True, False, False)
    td3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    r = one(spark, a=machine.repair_notes(F.lit("TD3"), F.array(F.lit(td3[0].replace("UTO", "UT0")), F.lit(td3[1].replace("UTO", "UT0")))), b=machine.repair_notes(F.lit("TD3"), F.array(F.lit(td3[0]), F.lit(td3[1].replace("1204159", "1204158")))), c=machine.repair_notes(F.lit("TD3"), F.array(*map(F.lit, td3))))
    assert (r.a, r.b, r.c) == ("0→O at line 1 col 5, 0→O at line 2 col 13", None, None)


def test_payloads(spark):
    version2 = "@\n\x1e\rANSI 636014100102DL00410279ZC03200010DLDAQD123\nDBA04232030\nDBD04232024 \nDBB04231990\nDBA01012099\nDAC\rDCGUSA\x1eDAJCA\r"
    version1 = "ANSI 6360140101DL00290179DLDBA20300423\nDBB19900423\n"
    df = spark.createDataFrame([(0, version2), (1, version1), (2, "no header"), (3, None), (4, "AAMVA63601405")], "i int, p string").select("i", machine.aamva_payload(F.col("p")).alias("x"))
    found = {r.i: r.x for r in df.collect()}
    assert (found[0].iin, found[0].version, found[0].types) == ("636014", 10, ["DL", "ZC"])
    assert found[0].elements == {"DAQ": "D123", "DBA": "04232030", "DBD": "04232024", "DBB": "04231990", "DCG": "USA", "DAJ": "CA"}
    assert (found[1].version, found[1].elements) == (1, {"DBA": "20300423", "DBB": "19900423"})
    assert found[2] is None and found[3] is None and found[4].elements == {}


def test_scripts(spark):
    r = one(spark, n=text.other_letters(F.lit("한ᄒ㐀ݐ")), u=text.unsupported_script(F.lit(2), F.lit(2)), v=text.unsupported_script(F.lit(1), F.lit(1)), l=text.latin_letters(F.lit("aÀ×ɏ1")), d=text.non_latin_dominant(F.lit("СРОК do")), e=text.non_latin_dominant(F.lit("...")))
    assert (r.n, r.u, r.v, r.l, r.d, r.e) == (4, True, False, 4, True, False)


def test_date_shapes(spark):
    cases = {"04/23/2030": 3, "2030-04-23": 3, "20300423": 3, "04/2030": 2, "23 APR 2030": 3, "APRIL 23, 2030": 3, "APR 2030": 2, "12 34": 0, "EXPIRES": 0, "": 0, "01/2026 – 01/2028": 4, "01/2026 TO": 0}
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", tokens.strength(F.col("x")).alias("n"))
    assert {r.x: r.n for r in df.collect()} == cases
    words = lambda *w: text.join_words(F.array(*map(F.lit, w)))
    r = one(spark, a=words("04", "/23/", "2030"), b=words("23", "APR", "2030"), c=words("01/2026", "–", "01/2028"))
    assert tuple(r) == ("04/23/2030", "23 APR 2030", "01/2026–01/2028")


PAGES = [
    (["EXPIRES 04/23/2030"], None, [D(2030, 4, 23)]), (["EXPIRES", "04/23/2030"], None, [D(2030, 4, 23)]), (["EXPIRATION DATE NONE", "04/23/2030 printed"], "NO_EXPIRY_SEMANTICS", None),
    (["COVERAGE PERIOD 01/2026 – 01/2028"], None, [D(2028, 1, 31)]), (["EXPIRES", "23", "APR", "2030"], None, [D(2030, 4, 23)]), (["NEXT STATEMENT DATE 04/23/2030"], "NO_EXPIRY_SEMANTICS", None),
    (["3 04/23/1990", "EXPIRES 04/23/2030"], None, [D(2030, 4, 23)]), (["4a 01/02/2020", "4b 01/02/2030", "3 05/06/1990"], None, [D(2030, 1, 2), D(2020, 1, 2), D(1990, 5, 6)]), ([], "NO_DATES_FOUND", None),
]


def test_pages(spark):
    words = lambda lines: [(w, i, (100.0 + 130 * j, 100.0 + 40 * i, 220.0 + 130 * j, 130.0 + 40 * i), 90.0) for i, ws in enumerate(lines) for j, w in enumerate(ws.split())]
    df = spark.createDataFrame([(n, 1000.0, 1400.0, "US", words(lines)) for n, (lines, _, _) in enumerate(PAGES)], f"doc_id long, width double, height double, convention string, tokens {pages.TOKENS}")
    for r in pages.read_pages(df, as_of()).select("doc_id", "reason", "candidates").collect():
        lines, reason, isos = PAGES[r.doc_id]
        assert r.reason == reason, lines
        assert ([c.iso for c in r.candidates] if r.candidates else None) == isos, lines


def test_zone_area_and_plain_texts(spark):
    line = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
    df = spark.createDataFrame([(1, line, [0.1, 0.8, 0.9, 0.85]), (1, line, [0.1, 0.86, 0.95, 0.9]), (1, "else", [0.0, 0.0, 1.0, 0.1]), (2, "no zone", [0.0, 0.0, 1.0, 0.1]), (3, line, None)], "doc_id long, text string, bbox array<double>")
    found = pages.zone_area(df).collect()
    assert [r.doc_id for r in found] == [1] and [round(x, 6) for x in found[0].area] == [0.07, 0.25, 0.98, 0.93]
    r = one(spark, a=text.same_value(F.lit("04-23-2030"), F.lit("04/23/2030")), b=text.same_value(F.lit("a1"), F.lit("A2")), c=text.client_ip(F.lit("1.2.3.4, 5.6.7.8"), F.lit("9.9.9.9")), d=text.client_ip(F.lit(None).cast("string"), F.lit(" 9.9.9.9")), e=text.client_ip(F.lit(""), F.lit(None).cast("string")))
    assert tuple(r) == (True, False, "1.2.3.4", "9.9.9.9", "unknown")


def test_zones(spark):
    td3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    td1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]
    td2 = ["I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6"]
    wrong = [td3[0], td3[1].replace("1204159", "12O4159")]
    df = spark.createDataFrame([(n, ["some text", *z]) for n, z in (("TD3", td3), ("TD1", td1), ("TD2", td2), ("BAD", wrong), ("NONE", ["a", "b"]))], "n string, lines array<string>").select("n", machine.band(F.col("lines")).alias("b"))
    df = df.select("n", "b", machine.check_reports(F.col("b.format"), F.col("b.lines")).alias("r"), machine.repair_notes(F.col("b.format"), F.col("b.lines")).alias("fix"), machine.zone_fields(F.col("b.format"), F.col("b.lines")).alias("f"))
    found = {r.n: r for r in df.collect()}
    for n in ("TD1", "TD2", "TD3"):
        assert found[n].b.format == n and found[n].b.start == 1 and all(x.valid for x in found[n].r) and found[n].f.issuer == "UTO" and found[n].f.birth == "740812"
    assert [x.field for x in found["BAD"].r if not x.valid] == ["expirationDate", "composite"] and found["BAD"].fix == "O→0 at line 2 col 24"
    assert found["NONE"].b is None
    r = one(spark, a=machine.sanitized(F.lit("p«utoc ‹x")), b=machine.alphabet_ratio(F.lit("AB <!")), c=machine.alphabet_ratio(F.lit("")))
    assert (r.a, r.b, r.c) == ("P<<UTO<<X", 0.75, 0.0)


def classified(spark, text_=None, size=(1000, 1000), mrz=None, fmt=None, code=None, payload=None, hint=None, n=1, pdf=False, exact=False, blur=None, dpi=None, clip=None):
    v = lambda x, kind: F.lit(x).cast(kind)
    return one(spark, k=classify.classify(v(text_, "string"), F.lit(size[0]), F.lit(size[1]), v(mrz, "boolean"), v(fmt, "string"), v("UTO" if fmt else None, "string"), v(code, "boolean"), v(payload, "string"), v(hint, "string"), F.lit(n), F.lit(pdf), F.lit(exact), v(blur, "double"), v(dpi, "double"), v(clip, "double"))).k


def test_classes(spark):
    assert (classified(spark, mrz=True, fmt="TD3")["class"], classified(spark, mrz=True, fmt="TD1").inconclusive) == ("PASSPORT", True)
    assert [classified(spark, code=True, payload=p)["class"] for p in ("DCAD\nDCGUSA\n", "DCAC\nDCGCAN\n", "DCANONE\n", None)] == ["US_DRIVERS_LICENSE", "NON_US_DRIVERS_LICENSE", "US_STATE_ID", "US_DRIVERS_LICENSE"]
    k = classified(spark, text_="Account statement. Opening balance. Closing balance. Texas", blur=200.0)
    assert (k["class"], k.confidence, k.side, k.issuer, k.inconclusive) == ("BANK_STATEMENT", 0.89, "N/A", "TX", False)
    assert classified(spark, text_="", mrz=False, code=False, blur=300.0)["class"] == "NOT_A_DOCUMENT" and classified(spark, text_="", mrz=False, code=False, blur=10.0)["class"] == "OTHER_DOCUMENT"
    k = classified(spark, size=(1600, 1009), mrz=False, code=False)
    assert k.hypotheses[0] == "US_DRIVERS_LICENSE" and k.codes == ["NO_MACHINE_READABLE_REGION"]
    assert classified(spark, size=(1250, 880)).hypotheses[0] == "PASSPORT" and classified(spark, size=(2550, 3300), n=2).hypotheses[0] == "BANK_STATEMENT"
    r = one(spark, a=classify.damping(F.lit(10.0), F.lit(90), F.lit(0.5)), b=classify.damping(F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("double")))
    assert (round(r.a, 6), r.b) == (0.612, 1.0)


def test_cross_checks(spark):
    triple = lambda *d: F.struct(*(F.lit(x).cast("date").alias(n) for x, n in zip(d, ("expiry", "issue", "dob"), strict=True)))
    same = one(spark, x=crosscheck.cross_check(F.lit("MRZ"), triple("2030-01-01", None, "1990-01-01"), triple("2030-01-01", "2020-01-01", "1990-01-01"), as_of())).x
    assert (same.anomalies, same.confidence, same.force_review, same.agreement) == ([], 0.995, False, "MRZ agrees with the printed values on EXPIRY, DATE_OF_BIRTH")
    other = one(spark, x=crosscheck.cross_check(F.lit("PDF417"), triple("2030-01-01", "2027-01-01", None), triple("2030-01-02", None, None), as_of())).x
    assert (other.anomalies, other.confidence, other.force_review) == (["FUTURE_DATED_ISSUE", "BARCODE_PRINT_MISMATCH"], 0.5, True)
    bad = one(spark, x=crosscheck.implausible(F.lit("2010-01-01").cast("date"), F.lit("2011-01-01").cast("date"), F.lit("2012-01-01").cast("date"), as_of()), y=crosscheck.implausible(F.lit("2031-01-02").cast("date"), F.lit("2011-01-01").cast("date"), F.lit(None).cast("date"), as_of()))
    assert bad.x == ["EXPIRY_BEFORE_ISSUE", "DOB_AFTER_EXPIRY"] and bad.y == ["IMPLAUSIBLE_VALIDITY_PERIOD"]


def test_rejections_and_quality(spark):
    none = F.array().cast("array<string>")
    kinds = ["EMPTY_FILE", "UNSUPPORTED_TYPE", "ENCRYPTED_PDF"]
    r = one(spark, **{k: respond.rejected(F.lit(k), none) for k in kinds}, gate=respond.rejected(F.lit(None).cast("string"), F.array(F.lit("SCREEN_CAPTURE_NOT_DOCUMENT"))), seen=respond.rejected(F.lit(None).cast("string"), none))
    assert [r[k].decision for k in kinds] == ["REJECTED", "REJECTED", "REVIEW"] and r["ENCRYPTED_PDF"].codes == ["ENCRYPTED_PDF"] and r["EMPTY_FILE"].codes == ["CLASS_UNRECOGNIZED"]
    assert r.gate.codes == ["OUT_OF_DOMAIN", "SCREEN_CAPTURE_NOT_DOCUMENT"] and r.gate.confidence == 0.9 and r.seen is None
    a = one(spark, a=respond.admission(F.lit(False), F.lit(True), F.lit(True), F.lit(0.02))).a
    assert (a.decision, len(a.signals), a.codes, a.spend_avoided_usd) == ("REJECT", 2, ["SCREEN_CAPTURE_NOT_DOCUMENT"], 0.02)
    limited, full = (one(spark, a=respond.admission(F.lit(False), F.lit(False), F.lit(p))).a for p in (False, True))
    assert (limited.decision, limited.spend_avoided_usd, full.decision, full.spend_avoided_usd) == ("ADMIT_LIMITED", 0.0, "ADMIT_FULL", None)
    q = one(spark, c=gate.clipping(F.array(*(F.lit(float(x)) for x in (0, 5, 100, 250)))), q=gate.quality_codes(F.lit(99.0), F.lit(0.1), F.lit(50.0), F.lit(40.0), F.lit(-16.0), F.lit(149)))
    assert (q.c.highlight, q.c.shadow, len(q.q)) == (0.25, 0.5, 5)


def test_scores(spark):
    rows = [("VALID", "EXPIRY_DATE", "2030-01-01", "AUTO_PASS", "EXPIRY_DATE", "2030-01-01", "VALID"), ("INDETERMINATE", "EXPIRY_DATE", None, "REVIEW", "EXPIRY_DATE", None, "VALID"), ("INDETERMINATE", "EXPIRY_DATE", None, "AUTO_PASS", "EXPIRY_DATE", None, "VALID"), ("NOT_APPLICABLE", "NO_EXPIRY", None, "AUTO_PASS", "NO_EXPIRY", None, "NOT_APPLICABLE"), ("VALID", "EXPIRY_DATE", "2030-01-01", "AUTO_PASS", "COVERAGE_END", "2030-01-02", "EXPIRED")]
    df = spark.createDataFrame(rows, "expected_verdict string, expected_basis string, expected_date string, decision string, basis string, date string, verdict string")
    assert [(r.correct, r.miss) for r in evaluate.score(df).collect()] == [(True, None), (True, None), (False, "committed"), (True, None), (False, "date;basis;verdict")]
    assert one(spark, d=evaluate.minutes_to_dollars(F.lit(90.0), F.lit(30.0))).d == 45.0


def test_calls(spark):
    entry = lambda raw, role, bad=False: F.struct(F.lit(raw).alias("raw"), F.lit(role).alias("role"), F.lit(bad).alias("illegible"))
    run = lambda hunter, mapper, ok=True: one(spark, m=twocalls.merge(F.lit(hunter).cast("string"), F.lit(True), mapper, F.lit(ok), F.lit("PASSPORT"), F.lit(False), F.lit("US"), as_of())).m
    both = run("04/23/2030", F.array(entry("23 APR 2030", "UNKNOWN"), entry("01/02/2020", "ISSUE")))
    assert [(c.role, c.confidence) for c in both.candidates] == [("EXPIRY", 0.85), ("ISSUE", 0.5)] and both.codes == []
    against = run("04/24/2030", F.array(entry("23 APR 2030", "EXPIRY", True)))
    assert [c.confidence for c in against.candidates] == [0.3, 0.15] and against.codes == ["HUNTER_MAPPER_DISAGREE"]
    ranged = run(None, F.array(entry("01/2026 – 01/2028", "COVERAGE_START")))
    assert [(c.role, c.iso) for c in ranged.candidates] == [("COVERAGE_END", D(2028, 1, 31))]
    assert run(None, F.array().cast("array<struct<raw:string,role:string,illegible:boolean>>")).codes == ["NO_DATES_FOUND"]
    a = F.array(F.lit("04/23/2030"))
    r = one(spark, y=twocalls.agreed(F.lit("04-23-2030"), a, a), n=twocalls.agreed(F.lit("04232030"), a, F.array(F.lit("x"))), u=twocalls.agreed(F.lit("zz"), a, a), b=twocalls.backoff_ms(F.lit(2)), k=twocalls.error_kind(F.lit(429), F.lit("x")), t=twocalls.error_kind(F.lit(0), F.lit("APITimeoutError")), w=twocalls.within_budget(F.lit(0.2), F.lit(0.1), F.lit(0.25)), x=twocalls.within_budget(F.lit(0.2), F.lit(0.1), F.lit(None).cast("double")))
    assert (r.y, r.n, r.u, r.b, r.k, r.t, r.w, r.x) == (True, False, None, 2000, "rate_limit", "timeout", False, True)


def test_pixels(spark):
    import numpy as np

    from veridate.functions import pixels

    def lines(degrees):
        y, x = np.mgrid[0:120, 0:160]
        return np.where((y - x * np.tan(np.deg2rad(degrees))) % 12 < 4, 20.0, 230.0).ravel().tolist()

    rows = [(lines(d), 160, 120, d) for d in (0.0, 5.0, -7.0)] + [([128.0] * 400, 20, 20, 0.0)]
    df = spark.createDataFrame(rows, "g array<double>, w int, h int, d double")
    assert all(abs(r.s - r.d) <= 0.5 for r in df.select("d", pixels.skew_angle("g", "w", "h").alias("s")).collect())
    square, slanted = [0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0], [0.0, 0.0, 10.0, 0.0, 15.0, 10.0, 5.0, 10.0]
    df = spark.createDataFrame([(square,), (slanted,)], "c array<double>").select("c", pixels.max_corner_deviation("c").alias("d"), pixels.inverse_homography("c", F.lit(20), F.lit(20)).alias("m"))
    a, b = df.collect()
    assert a.d == 0 and abs(b.d - 26.565) < 0.01
    m = np.array(b.m).reshape(3, 3) @ [20, 20, 1]
    assert np.allclose(m[:2] / m[2], [15, 10])
