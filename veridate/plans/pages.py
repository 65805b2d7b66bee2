"""Pages of words, machine-readable zones, classes and cross-checks, over inputs derived from orders, customers, parts and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.functions import dates, labels, machine
from veridate.operators import classify, crosscheck, gate, pages, respond
from veridate.plans import evidence
from veridate.plans.orders import as_of, pick, read, spread

TEXT_LABELS = [*labels.EXPIRY_LABELS, *labels.RECENCY_LABELS]


def _iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def _boxed(lines: Column, confidence: Column) -> Column:
    """Tokens of lines of words, in boxes on a grid."""
    word = lambda w, i, j: F.struct(w.alias("text"), i.cast("int").alias("line"), F.struct((j * 130 + 100).cast("double").alias("x0"), (i * 60 + 100).cast("double").alias("y0"), (j * 130 + 220).cast("double").alias("x1"), (i * 60 + 130).cast("double").alias("y1")).alias("box"), confidence.alias("confidence"))
    return F.flatten(F.transform(lines, lambda ws, i: F.transform(ws, lambda w, j: word(w, i, j)))).cast(pages.TOKENS)


def page_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of words of each customer in one of fifteen layouts: what its labels and dates come to."""
    k = F.col("c_custkey")
    d = F.date_add(F.lit("1992-01-01").cast("date"), (k * 7 % 2400).cast("int"))
    e, v = F.date_add(d, (k % 3000 + 1000).cast("int")), k % 15
    label = pick(TEXT_LABELS, k % len(TEXT_LABELS))
    label = F.when((k % 2 == 1) & v.isin(0, 2, 14), F.translate(label, "O", "0")).otherwise(label)
    words = lambda *x: F.concat(*(F.split(w, " ") if isinstance(w, Column) else F.array(F.lit(w)) for w in x))
    us = lambda x: F.date_format(x, "MM/dd/yyyy")
    page = lambda *lines: F.array(*lines)
    lines = (
        F.when(v == 0, page(words(label, us(e))))
        .when(v == 1, page(words(label), words(F.date_format(e, "dd MMM yyyy"))))
        .when(v == 2, page(words(label, F.date_format(e, "MMMM dd, yyyy"))))
        .when(v == 3, page(words(label, F.concat(F.date_format(d, "MM/yyyy"), F.lit(" – "), F.date_format(e, "MM/yyyy")))))
        .when(v == 4, page(words(label, F.date_format(e, "dd/MM/yyyy"))))
        .when(v == 5, page(words(label, "NONE"), words("printed", us(e))))
        .when(v == 6, page(words("EXPIRES", us(e)), words(F.lit("VALID UNTIL"), us(F.date_add(e, 400)))))
        .when(v == 7, page(words("printed", us(e))))
        .when(v == 8, page(words(F.lit("nothing to read"))))
        .when(v == 9, page(words(F.lit("СРОК ДЕЙСТВИЯ EXP"), us(e))))
        .when(v == 10, page(words("EXPIRES", us(e)), words(F.lit("VALID UNTIL"), us(e))))
        .when(v == 11, page(words(F.lit("NEXT STATEMENT DATE"), us(e))))
        .when(v == 12, F.array().cast("array<array<string>>"))
        .when(v == 13, page(words("4a", us(d)), words("4b", us(e)), words("3", us(F.add_months(d, -300)))))
        .otherwise(page(words(label, us(e))))
    )
    confidence = F.when(v == 14, 60.0).otherwise(90.0)
    rows = spread(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("doc_id"), F.lit(1000.0).alias("width"), F.lit(1400.0).alias("height"), F.when(v != 4, "US").alias("convention"), _boxed(lines, confidence).alias("tokens"))
    found = pages.read_pages(rows, as_of())
    first = F.get("candidates", F.lit(0))
    return found.select("doc_id", "reason", _iso(first["iso"]).alias("iso"), first["role"].alias("role"), first["label"].alias("label"), first["relation"].alias("relation"), first["confidence"].alias("confidence"), F.array_join(F.transform("candidates", lambda c: c["role"]), ";").alias("roles"), F.array_join("codes", ";").alias("codes"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of an order's lines, out of order on the page, put back into lines."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    at = (n - 1) % 3
    x, y = (F.floor((n - 1) / 3) * 200 + 50).cast("double"), (at * 60 + F.col("l_partkey") % 7).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 30).alias("y1"))
    words = read(spark, sf_dir, "lineitem").select(k.alias("doc_id"), (n.cast("long") * 1000000 + F.col("l_partkey")).alias("word_ord"), F.col("l_returnflag").alias("text"), box.alias("box"), F.lit(1000.0).alias("width"), F.lit(400.0).alias("height")).distinct()
    found = pages.lines(words)
    side = lambda i: F.round(F.get("bbox", F.lit(i)), 6)
    return found.select("doc_id", "line_ord", "text", side(0).alias("x0"), side(1).alias("y0"), side(2).alias("x1"), side(3).alias("y1"))


def zone_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' machine-readable zones of three formats below two other lines, some with a letter for a digit, some damaged: fields, failed checks, what would mend them, and anomalies."""
    k = F.col("c_custkey")
    day = lambda start, step, span: F.date_format(F.date_add(F.lit(start).cast("date"), (k * step % span).cast("int")), "yyMMdd")
    number, birth, expiry = F.concat(F.lit("L"), F.lpad(k.cast("string"), 8, "0")), day("1940-01-01", 37, 18000), day("1999-01-01", 11, 3000)
    check = lambda x: F.concat(x, machine.check_digit(x))
    base = spread(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("doc_id"), check(number).alias("n"), check(birth).alias("b"), check(expiry).alias("e"))
    base = base.withColumns({"opt": F.rpad(F.lit(""), 15, "<"), "name": F.lit("DOE<<JANE<")})
    td1 = F.array(F.concat(F.lit("I<GBR"), "n", "opt"), F.concat("b", F.lit("F"), "e", F.lit("GBR"), F.rpad(F.lit(""), 11, "<"), machine.check_digit(F.concat("n", "opt", "b", "e", F.rpad(F.lit(""), 11, "<")))), F.rpad("name", 30, "<"))
    td2 = F.array(F.rpad(F.concat(F.lit("I<GBR"), "name"), 36, "<"), F.concat("n", F.lit("GBR"), "b", F.lit("F"), "e", F.lit("<<<<<<<"), machine.check_digit(F.concat("n", "b", "e", F.lit("<<<<<<<")))))
    td3 = F.array(F.rpad(F.concat(F.lit("P<GBR"), "name"), 44, "<"), F.concat("n", F.lit("GBR"), "b", F.lit("F"), "e", F.lit("<<<<<<<<<<<<<<0"), machine.check_digit(F.concat("n", "b", "e", F.lit("<<<<<<<<<<<<<<0")))))
    id = F.col("doc_id")
    base = base.select("doc_id", F.when(id % 3 == 0, td1).when(id % 3 == 1, td2).otherwise(td3).alias("zone"))
    zone = F.col("zone")
    at = F.when(id % 3 == 0, 9).otherwise(22)  # where the expiry stands in the second line
    changed = lambda new: F.transform(zone, lambda x, i: F.when(i == 1, F.concat(x.substr(F.lit(1), at), new(x.substr(at + 1, F.lit(1))), x.substr(at + 2, F.length(x)))).otherwise(x))
    spoiled = F.when(id % 7 == 0, changed(lambda c: F.when(c == "0", "O").when(c == "1", "I").when(c == "5", "S").otherwise(c))).when(id % 11 == 0, changed(lambda c: ((c.cast("int") + 1) % 10).cast("string"))).otherwise(zone)
    base = base.select("doc_id", spoiled.alias("zone"))
    spaced = F.transform("zone", lambda x: F.when(id % 5 == 0, F.translate(x, "<", "c")).otherwise(x))
    lines = F.when(id % 13 == 0, F.array(F.lit("no zone"), F.lit("here"))).otherwise(F.concat(F.array(F.lit("UNITED KINGDOM"), F.lit("a page with a zone")), spaced))
    rows = base.select("doc_id", lines.alias("lines")).select("doc_id", machine.band(F.col("lines")).alias("band"))
    rows = rows.withColumns({"reports": machine.check_reports(F.col("band.format"), F.col("band.lines")), "fields": machine.zone_fields(F.col("band.format"), F.col("band.lines"))})
    failed = F.filter("reports", lambda r: ~r["valid"])
    sound = F.col("band").isNotNull() & (F.size(failed) == 0)
    rows = rows.withColumns({"failed": failed, "birth": F.when(sound, dates.mrz_date(F.col("fields.birth"), F.lit("DATE_OF_BIRTH"), as_of())), "expiry": F.when(sound, dates.mrz_date(F.col("fields.expiry"), F.lit("EXPIRY"), as_of()))})
    repair = F.when(F.size("failed") > 0, machine.repair_notes(F.col("band.format"), F.col("band.lines")))
    told = F.array_join(F.transform("failed", lambda r: F.concat(r["field"], F.lit("@"), r["line"].cast("string"), F.lit(":"), r["position"].cast("string"))), ";")
    anomalies = F.array_join(crosscheck.implausible(F.col("expiry"), F.lit(None).cast("date"), F.col("birth"), as_of()), ";")
    reason = F.when(F.col("band").isNull(), "NO_MACHINE_READABLE_REGION").when(F.size("failed") > 0, "CHECKSUM_FAILED").when(F.col("expiry").isNull(), "NO_DATES_FOUND")
    return rows.select("doc_id", F.col("band.format").alias("format"), F.col("band.start").alias("start"), "fields.issuer", F.coalesce(told, F.lit("")).alias("failed"), repair.alias("repair"), _iso(F.col("birth")).alias("birth"), _iso(F.col("expiry")).alias("expiry"), anomalies.alias("anomalies"), reason.alias("reason"))


def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of pages with zones, barcodes, vocabulary, blank pages and bare shapes, by part."""
    k, v = F.col("p_partkey"), F.col("p_partkey") % 9
    words = ["account statement with opening balance and closing balance", "driver license of texas", "utility bill", "x", "", "hello there general", "СРОК ДЕЙСТВИЯ ПАСПОРТА", "passport of ohio passeport", "copay"]
    text = F.when(v != 8, pick(words, k % len(words))).otherwise(F.concat(pick(words, k % 7), F.lit(" from new york")))
    has_mrz, has_code = F.when(v == 1, True).when(k % 4 != 3, False), F.when(v == 2, True).when(k % 4 != 3, False)
    payload = F.when(k % 2 == 0, F.when(k % 3 == 0, "DCAD\nDCGUSA\n").when(k % 3 == 1, "DCAC\nDCGCAN\n").otherwise("DCANONE\n"))
    none = F.lit(None).cast("string")
    size = lambda a, b: (F.lit(a) + k * b % 1000).cast("int")
    rows = read(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text"), size(900, 37).alias("width"), size(700, 53).alias("height"), has_mrz.alias("mrz"), has_code.alias("code"), F.when(v == 1, pick(["TD1", "TD2", "TD3"], k % 3)).alias("format"), F.when(v == 1, "GBR").alias("zone_issuer"), payload.alias("payload"), F.when(k % 5 != 0, (k % 300).cast("double")).alias("blur"), F.when(k % 6 != 0, (k % 400).cast("double")).alias("dpi"), F.when(k % 10 != 0, (k % 20) / 100.0).alias("clip"))
    c = F.col
    kind = classify.classify(c("text"), c("width"), c("height"), c("mrz"), c("format"), c("zone_issuer"), c("code"), c("payload"), none, (c("doc_id") % 3).cast("int"), c("doc_id") % 8 == 0, c("doc_id") % 2 == 0, c("blur"), c("dpi"), c("clip"))
    r = rows.select("doc_id", kind.alias("k"))
    return r.select("doc_id", "k.class", "k.confidence", "k.side", "k.issuer", "k.inconclusive", F.array_join("k.hypotheses", ";").alias("hypotheses"), F.array_join("k.codes", ";").alias("codes"), "k.signal")


def cross_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine-read against printed dates of customers, either of which may be missing or implausible."""
    k = F.col("c_custkey")
    day = lambda start, step, span: F.date_add(F.lit(start).cast("date"), (k * step % span).cast("int"))
    expiry, issue, dob = day("1995-01-01", 13, 9000), day("1990-01-01", 7, 4000), day("1940-01-01", 37, 21000)
    triple = lambda e, i, b: F.struct(e.alias("expiry"), i.alias("issue"), b.alias("dob"))
    none = F.lit(None).cast("date")
    own = F.when(k % 8 != 0, triple(expiry, F.when(k % 3 != 0, issue).otherwise(none), dob))
    printed = F.when(k % 9 != 0, triple(F.when(k % 10 == 0, F.date_add(expiry, 1)).otherwise(expiry), F.when(k % 4 == 0, none).otherwise(issue), F.when(k % 14 == 0, F.date_add(dob, 365)).otherwise(dob)))
    found = crosscheck.cross_check(F.when(k % 2 == 0, "MRZ").otherwise("PDF417"), own, printed, as_of())
    r = read(spark, sf_dir, "customer").select(k.alias("doc_id"), found.alias("x"))
    return r.select("doc_id", F.array_join("x.anomalies", ";").alias("anomalies"), "x.agreement", "x.confidence", "x.force_review", F.size("x.comparisons").alias("compared"))


def turned_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no reader sees: why, with which verdict, and whether anything is delivered."""
    k = F.col("doc_id")
    kinds = ["EMPTY_FILE", "UNSUPPORTED_TYPE", "CORRUPT_FILE", "ENCRYPTED_PDF", "RESOLUTION_TOO_LOW", "RENDER_FAILED"]
    kind = F.when(k % 5 == 0, pick(kinds, k % 6))
    adm = respond.admission(k % 4 == 1, k % 4 == 2, F.col("hit").isNotNull() | (k % 7 == 0))
    rows = read(spark, sf_dir, "documents").withColumn("hit", classify.gate_hit(F.col("text"))).select("doc_id", kind.alias("kind"), adm.alias("a"))
    rows = rows.withColumn("r", respond.rejected(F.col("kind"), F.col("a.codes")))
    signals = F.array_join(F.transform("a.signals", lambda s: F.concat(s["signal"], F.lit(":"), s["outcome"])), ";")
    return rows.select("doc_id", "kind", F.col("a.decision").alias("admission"), signals.alias("signals"), F.col("a.spend_avoided_usd").alias("spend_avoided"), "r.verdict", "r.decision", "r.confidence", F.array_join("r.codes", ";").alias("codes"), "r.delivered")


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings taken as gray images: clipping and the codes of their quality."""
    k = F.col("vec_id")
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + x.cast("double") * 800).cast("double"))))
    e = read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", gray.alias("gray"))
    e = e.withColumns({"l": gate.luminance(F.col("gray")), "c": gate.clipping(F.col("gray")), "blur": gate.laplacian_variance(F.col("gray"), 8, 8)})
    codes = gate.quality_codes(F.col("blur"), F.col("c.highlight"), F.col("l.mean"), F.col("l.stddev"), (k % 40 - 20).cast("double"), k % 300)
    return e.select("vec_id", F.round("c.highlight", 6).alias("highlight"), F.round("c.shadow", 6).alias("shadow"), F.array_join(codes, ";").alias("codes"))


_LABELS = """['EXP', 'EXPIRES', 'EXPIRATION', 'EXPIRATION DATE', 'EXPIRY', 'EXPIRY DATE', 'DATE OF EXPIRY', 'DATE OF EXPIRATION', 'VALID THRU', 'VALID THROUGH', 'VALID UNTIL', 'VALID TO', 'ENDS ON', 'END DATE', 'BENEFIT PERIOD', 'COVERAGE PERIOD', 'GOOD THRU', 'GOOD THROUGH', 'NOT VALID AFTER', 'EXPIRE LE', 'FECHA DE VENCIMIENTO',
  'STATEMENT PERIOD', 'STATEMENT DATE', 'PERIOD ENDING', 'PERIOD END', 'CLOSING DATE', 'BILLING PERIOD', 'BILL DATE', 'INVOICE DATE', 'ISSUED ON', 'DATE OF ISSUE']"""
_SUM = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: (CASE WHEN substr({0}, i, 1) = '<' THEN 0 WHEN ascii(substr({0}, i, 1)) < 58 THEN ascii(substr({0}, i, 1)) - 48 ELSE ascii(substr({0}, i, 1)) - 55 END) * ([7, 3, 1])[(i - 1) % 3 + 1])) % 10"
_CHECKED = lambda x: f"{x} || CAST({_SUM.format(x)} AS VARCHAR)"

QUERIES = {f.__name__: f for f in (page_readings, page_lines, zone_readings, page_classes, cross_sources, turned_away, image_quality)}
ORACLES = {
    "page_readings": f"""WITH c AS (SELECT c_custkey k, CAST(DATE '1992-01-01' + CAST(c_custkey * 7 % 2400 AS INTEGER) AS DATE) d FROM customer),
      o AS (SELECT k, d, k % 15 v, CAST(d + CAST(k % 3000 + 1000 AS INTEGER) AS DATE) e, ({_LABELS})[CAST(k % 31 AS INTEGER) + 1] plain, k % 31 < 21 ends FROM c),
      n AS (SELECT *, k % 2 = 1 AND v IN (0, 2, 14) noisy, length(plain) - length(replace(plain, 'O', '')) os, length(plain) len FROM o),
      m AS (SELECT *, CASE WHEN noisy THEN 1 - os / CAST(len AS DOUBLE) ELSE 1.0 END score, NOT noisy OR os = 0 OR (len >= 5 AND 1 - os / CAST(len AS DOUBLE) >= 0.85) hit FROM n),
      r AS (SELECT *, CASE WHEN v IN (8, 12) THEN 'NO_DATES_FOUND' WHEN v = 9 THEN 'UNSUPPORTED_SCRIPT' WHEN v IN (5, 7, 11) OR NOT hit THEN 'NO_EXPIRY_SEMANTICS' WHEN v = 4 AND day(e) <= 12 THEN 'AMBIGUOUS_DATE_FORMAT' WHEN v = 6 THEN 'MULTIPLE_EXPIRY_CANDIDATES' END reason FROM m)
      SELECT k doc_id, reason, CASE WHEN reason IS NULL THEN strftime(CASE WHEN v = 3 THEN last_day(e) ELSE e END, '%Y-%m-%d') END iso,
        CASE WHEN reason IS NULL THEN CASE WHEN v IN (10, 13) OR ends THEN 'EXPIRY' ELSE 'STATEMENT_PERIOD_END' END END AS "role",
        CASE WHEN reason IS NULL THEN CASE WHEN v = 10 THEN 'EXPIRES' WHEN v = 13 THEN '4b' WHEN noisy THEN replace(plain, 'O', '0') ELSE plain END END "label",
        CASE WHEN reason IS NULL THEN CASE WHEN v = 1 THEN 'BELOW' ELSE 'RIGHT' END END relation,
        CASE WHEN reason IS NULL THEN round(least(0.9, CAST(CASE WHEN v = 13 THEN 0.88 ELSE 0.82 END AS DOUBLE) * score * CASE WHEN v = 14 THEN 60 ELSE 90 END / 100 * (1 - CAST(0.15 AS DOUBLE) * CASE WHEN v = 1 THEN CAST(0.4 AS DOUBLE) ELSE 1 / CAST(36 AS DOUBLE) END) + CASE WHEN v = 10 THEN 0.04 ELSE 0 END), 6) END confidence,
        CASE WHEN reason IS NULL THEN CASE WHEN v = 13 THEN 'EXPIRY;ISSUE;DATE_OF_BIRTH' WHEN v = 10 OR ends THEN 'EXPIRY' ELSE 'STATEMENT_PERIOD_END;STATEMENT_PERIOD_END' END END roles,
        CASE WHEN reason IS NOT NULL THEN reason WHEN v = 14 THEN 'LOW_TIER_CONFIDENCE' ELSE '' END codes FROM r""",
    "page_lines": """WITH w AS (SELECT DISTINCT l_orderkey doc_id, (l_linenumber - 1) % 3 line, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey ord, l_returnflag word, CAST((l_linenumber - 1) // 3 * 200 + 50 AS DOUBLE) x, CAST((l_linenumber - 1) % 3 * 60 + l_partkey % 7 AS DOUBLE) y FROM lineitem),
      g AS (SELECT doc_id, line, string_agg(word, ' ' ORDER BY x, ord, word) AS "text", min(x) x0, min(y) y0, max(x) + 90 x1, max(y) + 30 y1 FROM w GROUP BY ALL)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) line_ord, "text", round(x0 / 1000, 6) x0, round(y0 / 400, 6) y0, round(x1 / 1000, 6) x1, round(y1 / 400, 6) y1 FROM g""",
    "zone_readings": f"""WITH c AS (SELECT c_custkey k, 'L' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') n, CAST(DATE '1940-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS DATE) bd, CAST(DATE '1999-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) AS DATE) ed FROM customer),
      s AS (SELECT *, strftime(bd, '%y%m%d') b, strftime(ed, '%y%m%d') e, k % 13 = 0 gone, substr(strftime(ed, '%y%m%d'), CASE WHEN k % 3 = 0 THEN 2 ELSE 2 END, 1) c FROM c),
      t AS (SELECT *, NOT gone AND k % 7 = 0 AND c IN ('0', '1', '5') lettered, NOT gone AND k % 7 <> 0 AND k % 11 = 0 wrong FROM s)
      SELECT k doc_id, CASE WHEN NOT gone THEN 'TD' || CAST(k % 3 + 1 AS VARCHAR) END format, CASE WHEN NOT gone THEN 2 END AS "start", CASE WHEN NOT gone THEN 'GBR' END issuer,
        CASE WHEN lettered OR wrong THEN CASE k % 3 WHEN 0 THEN 'expirationDate@2:15;composite@2:30' WHEN 1 THEN 'expirationDate@2:28;composite@2:36' ELSE 'expirationDate@2:28;composite@2:44' END ELSE '' END failed,
        CASE WHEN lettered THEN CASE c WHEN '0' THEN 'O→0' WHEN '1' THEN 'I→1' ELSE 'S→5' END || ' at line 2 col ' || CASE WHEN k % 3 = 0 THEN '10' ELSE '23' END END repair,
        CASE WHEN NOT (gone OR lettered OR wrong) THEN strftime(bd, '%Y-%m-%d') END birth, CASE WHEN NOT (gone OR lettered OR wrong) THEN strftime(ed, '%Y-%m-%d') END expiry, '' anomalies,
        CASE WHEN gone THEN 'NO_MACHINE_READABLE_REGION' WHEN lettered OR wrong THEN 'CHECKSUM_FAILED' END reason FROM t""",
    "page_classes": """WITH q AS (SELECT p_partkey k, p_partkey % 9 v, (['account statement with opening balance and closing balance', 'driver license of texas', 'utility bill', 'x', '', 'hello there general', 'СРОК ДЕЙСТВИЯ ПАСПОРТА', 'passport of ohio passeport', 'copay'])[CAST(p_partkey % 9 AS INTEGER) + 1] w, CAST(900 + p_partkey * 37 % 1000 AS INTEGER) width, CAST(700 + p_partkey * 53 % 1000 AS INTEGER) height FROM part),
      z AS (SELECT *, CASE WHEN v <> 8 THEN w ELSE (['account statement with opening balance and closing balance', 'driver license of texas', 'utility bill', 'x', '', 'hello there general', 'СРОК ДЕЙСТВИЯ ПАСПОРТА'])[CAST(k % 7 AS INTEGER) + 1] || ' from new york' END t, CASE WHEN v = 1 OR (k % 4 = 3 AND v <> 1) THEN NULL ELSE 0 END m0 FROM q),
      f AS (SELECT *, v = 1 zone, v = 2 code, k % 4 <> 3 AND v NOT IN (1, 2) probed, greatest(CAST(0.6 AS DOUBLE), CAST(CASE WHEN k % 5 <> 0 AND k % 300 < 100 THEN 0.8 ELSE 1 END AS DOUBLE) * CASE WHEN k % 6 <> 0 AND k % 400 < 150 THEN 0.85 ELSE 1 END * CASE WHEN k % 10 <> 0 AND k % 20 > 15 THEN 0.9 ELSE 1 END) damp,
        length(regexp_replace(t, '[^a-z0-9]', '', 'g')) letters, greatest(width, height) / CAST(least(width, height) AS DOUBLE) a,
        CASE WHEN contains(t, 'account statement') THEN 'BANK_STATEMENT' WHEN contains(t, 'driver license') THEN 'US_DRIVERS_LICENSE' WHEN contains(t, 'utility') THEN 'UTILITY_BILL' WHEN contains(t, 'passport') THEN 'PASSPORT' WHEN contains(t, 'copay') THEN 'MEDICAL_INSURANCE_CARD' END kind,
        CAST(CASE WHEN contains(t, 'account statement') THEN 3 WHEN contains(t, 'driver license') THEN 1.4 WHEN contains(t, 'utility') THEN 1 WHEN contains(t, 'passport') THEN 3 WHEN contains(t, 'copay') THEN 1 END AS DOUBLE) score,
        CASE WHEN contains(t, 'new york') AND NOT contains(t, 'texas') THEN 'NY' WHEN contains(t, 'ohio') THEN 'OH' WHEN contains(t, 'texas') THEN CASE WHEN contains(t, 'new york') THEN 'NY' ELSE 'TX' END END st FROM z),
      g AS (SELECT *, least(CAST(1 AS DOUBLE), 0.55 + least(CAST(0.4 AS DOUBLE), score * CAST(0.08 AS DOUBLE)) + least(CAST(0.1 AS DOUBLE), score * CAST(0.05 AS DOUBLE))) * damp sure, score >= 2 OR (k % 2 = 0 AND score >= 1) OR score >= 1.4 strong,
        CASE WHEN abs(a - CAST(85.6 AS DOUBLE) / 54) <= CAST(0.14 AS DOUBLE) THEN 'ID1_CARD' WHEN a BETWEEN 1.25 AND 1.47 THEN 'PAPER' ELSE 'OTHER' END shape, regexp_matches(t, '[А-Я]') AND length(regexp_replace(t, '[^А-Я]', '', 'g')) >= 0.3 * length(regexp_replace(t, ' ', '', 'g')) AND letters > 0 odd FROM f),
      h AS (SELECT *, CASE WHEN zone THEN 'mrz' WHEN code THEN 'pdf417' WHEN letters >= 5 AND kind IS NOT NULL AND strong AND sure >= 0.6 THEN 'keywords' WHEN letters < 5 AND probed AND k % 5 <> 0 AND k % 300 >= 100 THEN 'text' ELSE 'shape' END signal FROM g)
      SELECT k doc_id, CASE signal WHEN 'mrz' THEN CASE WHEN k % 3 = 2 THEN 'PASSPORT' ELSE 'NATIONAL_ID_CARD' END WHEN 'pdf417' THEN CASE WHEN k % 2 <> 0 THEN 'US_DRIVERS_LICENSE' WHEN k % 3 = 0 THEN 'US_DRIVERS_LICENSE' WHEN k % 3 = 1 THEN 'NON_US_DRIVERS_LICENSE' ELSE 'US_STATE_ID' END WHEN 'keywords' THEN kind WHEN 'text' THEN 'NOT_A_DOCUMENT' ELSE 'OTHER_DOCUMENT' END AS "class",
        CAST(CASE signal WHEN 'mrz' THEN CASE k % 3 WHEN 2 THEN 0.97 WHEN 0 THEN 0.62 ELSE 0.6 END WHEN 'pdf417' THEN CASE WHEN k % 2 <> 0 THEN 0.75 WHEN k % 3 = 2 THEN 0.9 ELSE 0.96 END WHEN 'keywords' THEN round(sure, 2) WHEN 'text' THEN round(damp * CAST(0.6 AS DOUBLE), 2) ELSE round(damp * CAST(0.25 AS DOUBLE), 2) END AS DOUBLE) confidence,
        CASE signal WHEN 'mrz' THEN 'FRONT' WHEN 'pdf417' THEN 'BACK' WHEN 'keywords' THEN CASE WHEN kind IN ('BANK_STATEMENT', 'UTILITY_BILL') THEN 'N/A' ELSE 'UNKNOWN' END WHEN 'text' THEN 'N/A' ELSE 'UNKNOWN' END side,
        CASE signal WHEN 'mrz' THEN 'GBR' WHEN 'text' THEN NULL ELSE st END issuer,
        CASE signal WHEN 'mrz' THEN k % 3 <> 2 WHEN 'pdf417' THEN k % 2 <> 0 WHEN 'keywords' THEN sure < 0.85 ELSE true END inconclusive,
        CASE signal WHEN 'mrz' THEN CASE k % 3 WHEN 2 THEN '' WHEN 0 THEN 'NATIONAL_ID_CARD;RESIDENCE_PERMIT' ELSE 'NATIONAL_ID_CARD;PASSPORT;RESIDENCE_PERMIT' END WHEN 'pdf417' THEN CASE WHEN k % 2 <> 0 THEN 'US_DRIVERS_LICENSE;US_STATE_ID;NON_US_DRIVERS_LICENSE' ELSE '' END WHEN 'keywords' THEN CASE WHEN sure < 0.85 THEN kind ELSE '' END WHEN 'text' THEN 'NOT_A_DOCUMENT;OTHER_DOCUMENT'
          ELSE CASE shape WHEN 'ID1_CARD' THEN 'US_DRIVERS_LICENSE;US_STATE_ID;NATIONAL_ID_CARD;MEDICAL_INSURANCE_CARD' WHEN 'PAPER' THEN CASE WHEN k % 3 > 1 OR k % 8 = 0 THEN 'BANK_STATEMENT;EMPLOYMENT_LETTER;UTILITY_BILL' WHEN a BETWEEN 1.38 AND 1.47 THEN 'PASSPORT;RESIDENCE_PERMIT;UTILITY_BILL;EMPLOYMENT_LETTER' ELSE 'UTILITY_BILL;EMPLOYMENT_LETTER;BANK_STATEMENT' END ELSE 'OTHER_DOCUMENT;NOT_A_DOCUMENT' END END hypotheses,
        concat_ws(';', CASE WHEN odd THEN 'UNSUPPORTED_SCRIPT' END, CASE WHEN signal = 'text' THEN 'CLASS_UNRECOGNIZED' WHEN signal = 'shape' AND shape = 'ID1_CARD' AND probed THEN 'NO_MACHINE_READABLE_REGION' END) codes, signal FROM h""",
    "cross_sources": """WITH c AS (SELECT c_custkey k, CAST(DATE '1995-01-01' + CAST(c_custkey * 13 % 9000 AS INTEGER) AS DATE) e, CAST(DATE '1990-01-01' + CAST(c_custkey * 7 % 4000 AS INTEGER) AS DATE) i, CAST(DATE '1940-01-01' + CAST(c_custkey * 37 % 21000 AS INTEGER) AS DATE) b FROM customer),
      m AS (SELECT k, CASE WHEN k % 8 <> 0 THEN e END me, CASE WHEN k % 8 <> 0 AND k % 3 <> 0 THEN i END mi, CASE WHEN k % 8 <> 0 THEN b END mb, CASE WHEN k % 9 <> 0 THEN e + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END END pe, CASE WHEN k % 9 <> 0 AND k % 4 <> 0 THEN i END pi, CASE WHEN k % 9 <> 0 THEN b + CASE WHEN k % 14 = 0 THEN 365 ELSE 0 END END pb FROM c),
      x AS (SELECT *, [CASE WHEN me < mi THEN 'EXPIRY_BEFORE_ISSUE' END, CASE WHEN me > CAST(mi + to_years(20) AS DATE) THEN 'IMPLAUSIBLE_VALIDITY_PERIOD' END, CASE WHEN me < mb THEN 'DOB_AFTER_EXPIRY' END, CASE WHEN mi > DATE '1998-08-02' THEN 'FUTURE_DATED_ISSUE' END, CASE WHEN pe < pi THEN 'EXPIRY_BEFORE_ISSUE' END, CASE WHEN pe > CAST(pi + to_years(20) AS DATE) THEN 'IMPLAUSIBLE_VALIDITY_PERIOD' END, CASE WHEN pe < pb THEN 'DOB_AFTER_EXPIRY' END, CASE WHEN pi > DATE '1998-08-02' THEN 'FUTURE_DATED_ISSUE' END,
          CASE WHEN me <> pe OR mi <> pi OR mb <> pb THEN CASE WHEN k % 2 = 0 THEN 'MRZ_VIZ_MISMATCH' ELSE 'BARCODE_PRINT_MISMATCH' END END] raised,
        list_filter([CASE WHEN me IS NOT NULL AND pe IS NOT NULL THEN 'EXPIRY' END, CASE WHEN mi IS NOT NULL AND pi IS NOT NULL THEN 'ISSUE' END, CASE WHEN mb IS NOT NULL AND pb IS NOT NULL THEN 'DATE_OF_BIRTH' END], lambda r: r IS NOT NULL) met,
        list_filter([CASE WHEN me <> pe THEN 'EXPIRY' END, CASE WHEN mi <> pi THEN 'ISSUE' END, CASE WHEN mb <> pb THEN 'DATE_OF_BIRTH' END], lambda r: r IS NOT NULL) bad FROM m),
      y AS (SELECT *, list_transform(list_filter(range(1, 10), lambda n: raised[n] IS NOT NULL AND list_position(raised, raised[n]) = n), lambda n: raised[n]) anomalies FROM x)
      SELECT k doc_id, array_to_string(anomalies, ';') anomalies, CASE WHEN len(met) > 0 THEN CASE WHEN k % 2 = 0 THEN 'MRZ' ELSE 'PDF417' END || CASE WHEN len(bad) = 0 THEN ' agrees with the printed values on ' || array_to_string(met, ', ') ELSE ' disagrees with the printed values on ' || array_to_string(bad, ', ') END END agreement,
        CAST(CASE WHEN len(bad) > 0 THEN 0.5 WHEN len(met) > 0 THEN 0.995 ELSE 0.99 END AS DOUBLE) confidence, len(anomalies) > 0 force_review, CAST(len(met) AS INTEGER) compared FROM y""",
    "turned_away": f"""WITH d AS (SELECT doc_id k, CASE WHEN doc_id % 5 = 0 THEN (['EMPTY_FILE', 'UNSUPPORTED_TYPE', 'CORRUPT_FILE', 'ENCRYPTED_PDF', 'RESOLUTION_TOO_LOW', 'RENDER_FAILED'])[CAST(doc_id % 6 AS INTEGER) + 1] END kind, doc_id % 4 = 1 likeness, doc_id % 4 = 2 screen, doc_id % 7 = 0 OR coalesce(len(list_filter({evidence._LIST}, lambda t: contains(lower(text), t))), 0) > 0 positive FROM documents)
      SELECT k doc_id, kind, CASE WHEN likeness OR screen THEN 'REJECT' WHEN positive THEN 'ADMIT_FULL' ELSE 'ADMIT_LIMITED' END admission,
        CASE WHEN likeness THEN 'DOCUMENT_LIKENESS:CONFIDENT_NEGATIVE' ELSE 'DOCUMENT_LIKENESS:UNCERTAIN;SCREEN_CAPTURE:' || CASE WHEN screen THEN 'CONFIDENT_NEGATIVE' ELSE 'UNCERTAIN;POSITIVE_DOMAIN_SIGNAL:' || CASE WHEN positive THEN 'CONFIDENT_POSITIVE' ELSE 'NOT_FOUND' END END END signals,
        CAST(CASE WHEN likeness OR screen THEN 0.08 WHEN NOT positive THEN 0 END AS DOUBLE) spend_avoided,
        CASE WHEN kind IN ('EMPTY_FILE', 'UNSUPPORTED_TYPE') THEN 'NOT_APPLICABLE' WHEN kind IS NOT NULL THEN 'INDETERMINATE' WHEN likeness OR screen THEN 'NOT_APPLICABLE' END verdict,
        CASE WHEN kind IN ('EMPTY_FILE', 'UNSUPPORTED_TYPE') THEN 'REJECTED' WHEN kind IS NOT NULL THEN 'REVIEW' WHEN likeness OR screen THEN 'REJECTED' END decision,
        CAST(CASE WHEN kind IN ('EMPTY_FILE', 'UNSUPPORTED_TYPE') THEN 1 WHEN kind IS NOT NULL THEN 0 WHEN likeness OR screen THEN 0.9 END AS DOUBLE) confidence,
        CASE WHEN kind IN ('EMPTY_FILE', 'RENDER_FAILED') THEN 'CLASS_UNRECOGNIZED' WHEN kind IS NOT NULL THEN kind WHEN likeness THEN 'OUT_OF_DOMAIN;NOT_A_DOCUMENT_IMAGE' WHEN screen THEN 'OUT_OF_DOMAIN;SCREEN_CAPTURE_NOT_DOCUMENT' END codes,
        CASE WHEN kind IN ('EMPTY_FILE', 'UNSUPPORTED_TYPE') THEN false WHEN kind IS NOT NULL THEN true WHEN likeness OR screen THEN false END delivered FROM d""",
    "image_quality": """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0.0, least(255.0, floor(128 + CAST(x AS DOUBLE) * 800)))) g FROM embeddings WHERE len(embedding) = 64),
      l AS (SELECT *, list_sum(g) / 64 m, sqrt(greatest(list_sum(list_transform(g, lambda x: x * x)) / 64 - (list_sum(g) / 64) * (list_sum(g) / 64), 0)) s, len(list_filter(g, lambda x: x >= 250)) / CAST(64 AS DOUBLE) hi, len(list_filter(g, lambda x: x <= 5)) / CAST(64 AS DOUBLE) lo,
        list_transform(list_filter(range(0, 64), lambda i: i % 8 BETWEEN 1 AND 6 AND i BETWEEN 8 AND 55), lambda i: g[i] + g[i + 2] + g[i - 7] + g[i + 9] - 4 * g[i + 1]) lap FROM g),
      b AS (SELECT *, list_sum(list_transform(lap, lambda x: x * x)) / 36 - (list_sum(lap) / 36) * (list_sum(lap) / 36) blur FROM l)
      SELECT vec_id, round(hi, 6) highlight, round(lo, 6) shadow, concat_ws(';', CASE WHEN blur < 100 THEN 'IMAGE_TOO_BLURRY' END, CASE WHEN hi > 0.08 THEN 'GLARE_OBSCURES_FIELD' END, CASE WHEN m < 60 OR s < 25 THEN 'POOR_CONTRAST' END, CASE WHEN abs(vec_id % 40 - 20) > 15 THEN 'EXTREME_SKEW' END, CASE WHEN vec_id % 300 < 150 THEN 'RESOLUTION_TOO_LOW' END) codes FROM b""",
}
