"""Readings of printed and machine-readable values, over inputs derived from orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.functions import dates, labels, machine, text
from veridate.plans.orders import as_of, pick, read

def free_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in nine ways and read back under three conventions."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms = ["MM/dd/yyyy", "dd.MM.yyyy", "dd MMM yyyy", "MMMM dd, yyyy", "yyyy-MM-dd", "MM/yyyy", "yyyyMMdd", "dd-MM-yy"]
    printed = F.element_at(F.array(*(F.date_format(d, f) for f in forms), F.lit("see reverse")), (k % 9 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select(k.alias("doc_id"), printed.alias("raw"), F.when(k % 3 == 0, "US").when(k % 3 == 1, "DMY").alias("convention"))
    r = rows.withColumn("r", dates.free_text_date(F.col("raw"), F.col("convention"), F.lit("EXPIRY"), as_of()))
    return r.select("doc_id", "raw", F.date_format("r.iso", "yyyy-MM-dd").alias("iso"), F.col("r.ambiguous").alias("ambiguous"), F.array_join(F.transform("r.alternatives", lambda x: F.date_format(x, "yyyy-MM-dd")), ";").alias("alternatives"))


def coverage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges printed with different marks, split into start and end."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    mark = pick([" – ", " TO ", " thru ", "--", ", "], k % 5)
    rows = read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.date_format(d, "MM/yyyy"), mark, F.date_format(F.add_months(d, 24), "MM/yyyy")).alias("raw"))
    r = rows.withColumn("r", dates.date_range(F.col("raw"), F.lit("US"), F.lit("COVERAGE_END"), as_of()))
    return r.select("doc_id", "raw", F.date_format("r.start", "yyyy-MM-dd").alias("start_iso"), F.date_format("r.end", "yyyy-MM-dd").alias("end_iso"))


def aamva_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode payloads of customers: version, elements and the expiry that their declared order allows."""
    k = F.col("c_custkey")
    expiry = F.date_add(F.lit("2001-01-01").cast("date"), (k * 13 % 3000).cast("int"))
    order = F.when((k % 2 == 0) == (k % 10 != 0), "MMddyyyy").otherwise("yyyyMMdd")
    value = F.when(order == "MMddyyyy", F.date_format(expiry, "MMddyyyy")).otherwise(F.date_format(expiry, "yyyyMMdd"))
    version, country = F.when(k % 4 == 0, 1).otherwise(10), F.when(k % 2 == 0, "USA").otherwise("CAN")
    payload = F.concat(F.lit("@\n\x1e\rANSI 636014"), F.lpad(version.cast("string"), 2, "0"), F.lit("0001DL00310100DLDAQ"), k.cast("string"), F.lit("\nDBA"), value, F.lit("\nDBA01012099\nDAC\nDCG"), country, F.lit("\r"))
    rows = read(spark, sf_dir, "customer").select(k.alias("doc_id"), payload.alias("payload"))
    e = rows.withColumns({"version": machine.aamva_version(F.col("payload")), "elements": machine.aamva_elements(F.col("payload"))})
    r = e.withColumn("r", machine.aamva_resolved(F.col("elements")["DBA"], F.col("elements")["DCG"], F.col("version")))
    return r.select("doc_id", "version", F.col("elements")["DCG"].alias("country"), F.col("elements")["DAQ"].alias("licence"), F.size("elements").alias("n_elements"), F.date_format("r.iso", "yyyy-MM-dd").alias("expiry"), F.col("r.conflict").alias("conflict"))


def mrz_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passport lines built from customers, one in seven damaged: failed check digits, and dates where all hold."""
    k = F.col("c_custkey")
    with_digit = lambda c: F.concat(c, machine.check_digit(c))
    number = with_digit(F.concat(F.lit("L"), F.lpad(k.cast("string"), 8, "0")))
    born = with_digit(F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), (k * 37 % 18000).cast("int")), "yyMMdd"))
    ends = with_digit(F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (k * 11 % 3000).cast("int")), "yyMMdd"))
    body = read(spark, sf_dir, "customer").select(k.alias("doc_id"), number.alias("n"), born.alias("b"), ends.alias("e"), F.lit("<<<<<<<<<<<<<<0").alias("p"))
    whole = machine.check_digit(F.concat("n", "b", "e", "p"))
    lines = body.withColumn("line", F.concat("n", F.lit("GBR"), "b", F.lit("F"), "e", "p", whole))
    damaged = F.concat(F.substring("line", 1, 27), ((F.substring("line", 28, 1).cast("int") + 1) % 10).cast("string"), F.substring("line", 29, 16))
    lines = lines.withColumn("line", F.when(F.col("doc_id") % 7 == 0, damaged).otherwise(F.col("line"))).withColumn("failed", machine.td3_failures(F.col("line")))
    sound = F.size("failed") == 0
    date = lambda a, role: F.when(sound, F.date_format(dates.mrz_date(F.substring("line", a, 6), F.lit(role), as_of()), "yyyy-MM-dd"))
    return lines.select("doc_id", "line", F.array_join("failed", ";").alias("failed"), date(14, "DATE_OF_BIRTH").alias("birth"), date(22, "EXPIRY").alias("expiry"))


def confusable_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single-digit misreading of each customer key."""
    keys = read(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("digits"))
    return keys.select("c_custkey", F.explode(dates.confusable_variants(F.col("digits"))).alias("variant"))


def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy label phrases matched to the lexicon: exact first, then by edit distance, longer labels on ties; field codes exactly only."""
    k = F.col("p_partkey")
    names = [x for x, _, _ in labels.LEXICON]
    label = pick(names, k % len(names))
    noisy = F.when(k % 5 == 0, F.concat(label, F.lit(":"))).when(k % 5 == 1, F.translate(label, "IO", "10")).when(k % 5 == 2, F.lower(label)).when(k % 5 == 3, F.col("p_type")).otherwise(F.concat(F.substring(label, 1, 3), F.lit("X"), label.substr(F.lit(5), F.length(label))))
    phrases = read(spark, sf_dir, "part").select(k.alias("doc_id"), noisy.alias("phrase")).withColumn("form", text.label_form(F.col("phrase")))
    # Each distinct phrase is matched once.
    best = phrases.select("form").distinct().withColumn("m", labels.match(F.col("form")))
    return phrases.join(best, "form", "left").select("doc_id", "phrase", "m.canonical", "m.role", "m.exact", F.round("m.score", 6).alias("score"), text.is_sentinel(F.col("phrase")).alias("sentinel"))


_T = "TRY_CAST(printf('%04d-%02d-%02d', year(d), day(d), month(d)) AS DATE)"
_DIGIT = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: (CASE WHEN substr({0}, i, 1) = '<' THEN 0 WHEN ascii(substr({0}, i, 1)) < 58 THEN ascii(substr({0}, i, 1)) - 48 ELSE ascii(substr({0}, i, 1)) - 55 END) * ([7, 3, 1])[(i - 1) % 3 + 1])) % 10"
_LEXICON = """(0, 'EXP', 'EXPIRY', false), (1, 'EXPIRES', 'EXPIRY', false), (2, 'EXPIRATION', 'EXPIRY', false), (3, 'EXPIRATION DATE', 'EXPIRY', false), (4, 'EXPIRY', 'EXPIRY', false), (5, 'EXPIRY DATE', 'EXPIRY', false), (6, 'DATE OF EXPIRY', 'EXPIRY', false), (7, 'DATE OF EXPIRATION', 'EXPIRY', false),
  (8, 'VALID THRU', 'EXPIRY', false), (9, 'VALID THROUGH', 'EXPIRY', false), (10, 'VALID UNTIL', 'EXPIRY', false), (11, 'VALID TO', 'EXPIRY', false), (12, 'ENDS ON', 'EXPIRY', false), (13, 'END DATE', 'EXPIRY', false), (14, 'BENEFIT PERIOD', 'EXPIRY', false), (15, 'COVERAGE PERIOD', 'EXPIRY', false),
  (16, 'GOOD THRU', 'EXPIRY', false), (17, 'GOOD THROUGH', 'EXPIRY', false), (18, 'NOT VALID AFTER', 'EXPIRY', false), (19, 'EXPIRE LE', 'EXPIRY', false), (20, 'FECHA DE VENCIMIENTO', 'EXPIRY', false), (21, 'STATEMENT PERIOD', 'STATEMENT_PERIOD_END', false), (22, 'STATEMENT DATE', 'STATEMENT_PERIOD_END', false),
  (23, 'PERIOD ENDING', 'STATEMENT_PERIOD_END', false), (24, 'PERIOD END', 'STATEMENT_PERIOD_END', false), (25, 'CLOSING DATE', 'STATEMENT_PERIOD_END', false), (26, 'BILLING PERIOD', 'STATEMENT_PERIOD_END', false), (27, 'BILL DATE', 'STATEMENT_PERIOD_END', false), (28, 'INVOICE DATE', 'STATEMENT_PERIOD_END', false),
  (29, 'ISSUED ON', 'STATEMENT_PERIOD_END', false), (30, 'DATE OF ISSUE', 'STATEMENT_PERIOD_END', false), (31, '4A', 'ISSUE', true), (32, '4B', 'EXPIRY', true), (33, '3', 'DATE_OF_BIRTH', true)"""
_SENTINELS = "'NONE', 'N A', 'NA', 'NIL', 'INDEFINITE', 'INDEFINITELY', 'NON EXPIRING', 'NONEXPIRING', 'DOES NOT EXPIRE', 'NO EXPIRATION', 'NO EXPIRY', 'PERMANENT', 'UNLIMITED'"

QUERIES = {f.__name__: f for f in (free_text_dates, coverage_ranges, aamva_payloads, mrz_lines, confusable_digits, label_matches)}
ORACLES = {
    "free_text_dates": f"""WITH o AS (SELECT o_orderkey doc_id, CAST(o_orderdate AS DATE) d, o_orderkey % 9 f, CASE o_orderkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'DMY' END cv FROM orders),
      s AS (SELECT *, day(d) <= 12 AND f IN (0, 1, 7) two, {_T} swapped FROM o)
      SELECT doc_id, CASE f WHEN 0 THEN strftime(d, '%m/%d/%Y') WHEN 1 THEN strftime(d, '%d.%m.%Y') WHEN 2 THEN strftime(d, '%d %b %Y') WHEN 3 THEN strftime(d, '%B %d, %Y') WHEN 4 THEN strftime(d, '%Y-%m-%d') WHEN 5 THEN strftime(d, '%m/%Y') WHEN 6 THEN strftime(d, '%Y%m%d') WHEN 7 THEN strftime(d, '%d-%m-%y') ELSE 'see reverse' END raw,
        strftime(CASE WHEN f = 8 THEN NULL WHEN f = 5 THEN last_day(d) WHEN NOT two THEN d WHEN cv IS NULL THEN NULL WHEN (f = 0) = (cv = 'US') THEN d ELSE swapped END, '%Y-%m-%d') iso,
        two AND cv IS NULL ambiguous, CASE WHEN two AND cv IS NULL THEN CASE WHEN f = 0 THEN strftime(d, '%Y-%m-%d') || ';' || strftime(swapped, '%Y-%m-%d') ELSE strftime(swapped, '%Y-%m-%d') || ';' || strftime(d, '%Y-%m-%d') END ELSE '' END alternatives FROM s""",
    "coverage_ranges": """WITH o AS (SELECT o_orderkey doc_id, CAST(o_orderdate AS DATE) d, CAST(CAST(o_orderdate AS DATE) + to_months(24) AS DATE) e, o_orderkey % 5 f FROM orders)
      SELECT doc_id, strftime(d, '%m/%Y') || ([' – ', ' TO ', ' thru ', '--', ', '])[CAST(f AS INTEGER) + 1] || strftime(e, '%m/%Y') raw, CASE WHEN f < 4 THEN strftime(last_day(d), '%Y-%m-%d') END start_iso, CASE WHEN f < 4 THEN strftime(last_day(e), '%Y-%m-%d') END end_iso FROM o""",
    "aamva_payloads": """WITH c AS (SELECT c_custkey doc_id, CAST(DATE '2001-01-01' + CAST(c_custkey * 13 % 3000 AS INTEGER) AS DATE) x, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 10 END version, c_custkey % 2 = 0 usa, (c_custkey % 2 = 0) = (c_custkey % 10 <> 0) mdy FROM customer),
      v AS (SELECT *, CASE WHEN mdy THEN strftime(x, '%m%d%Y') ELSE strftime(x, '%Y%m%d') END s FROM c),
      r AS (SELECT *, TRY_CAST(substr(s, 5, 4) || '-' || substr(s, 1, 2) || '-' || substr(s, 3, 2) AS DATE) a, TRY_CAST(substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2) AS DATE) b FROM v),
      w AS (SELECT *, CASE WHEN year(a) BETWEEN 1900 AND 2200 THEN a END u, CASE WHEN year(b) BETWEEN 1900 AND 2200 THEN b END k FROM r)
      SELECT doc_id, version, CASE WHEN usa THEN 'USA' ELSE 'CAN' END country, CAST(doc_id AS VARCHAR) licence, 3 n_elements,
        strftime(CASE WHEN version > 1 THEN CASE WHEN usa THEN u ELSE k END WHEN u IS NULL THEN k WHEN k IS NULL THEN u END, '%Y-%m-%d') expiry,
        version > 1 AND CASE WHEN usa THEN u IS NULL AND k IS NOT NULL ELSE k IS NULL AND u IS NOT NULL END conflict FROM w""",
    "mrz_lines": f"""WITH c AS (SELECT c_custkey doc_id, 'L' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') n, CAST(DATE '1940-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS DATE) bd, CAST(DATE '1996-01-01' + CAST(c_custkey * 11 % 3000 AS INTEGER) AS DATE) ed FROM customer),
      s AS (SELECT *, strftime(bd, '%y%m%d') b, strftime(ed, '%y%m%d') e FROM c),
      g AS (SELECT *, n || CAST({_DIGIT.format('n')} AS VARCHAR) n1, b || CAST({_DIGIT.format('b')} AS VARCHAR) b1, e || CAST({_DIGIT.format('e')} AS VARCHAR) e1, '<<<<<<<<<<<<<<0' p FROM s),
      h AS (SELECT *, n1 || b1 || e1 || p w FROM g), l AS (SELECT *, CAST({_DIGIT.format('w')} AS VARCHAR) z FROM h)
      SELECT doc_id, n1 || 'GBR' || b1 || 'F' || CASE WHEN doc_id % 7 = 0 THEN e || CAST((CAST(substr(e1, 7, 1) AS INTEGER) + 1) % 10 AS VARCHAR) ELSE e1 END || p || z line,
        CASE WHEN doc_id % 7 = 0 THEN 'expiry_date;composite' ELSE '' END failed, CASE WHEN doc_id % 7 <> 0 THEN strftime(bd, '%Y-%m-%d') END birth, CASE WHEN doc_id % 7 <> 0 THEN strftime(ed, '%Y-%m-%d') END expiry FROM l""",
    "confusable_digits": """WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') s FROM customer), p AS (SELECT c_custkey, s, unnest(range(1, 7)) i FROM k)
      SELECT c_custkey, substr(s, 1, i - 1) || translate(substr(s, i, 1), '08175639', '80716593') || substr(s, i + 1) variant FROM p WHERE substr(s, i, 1) NOT IN ('2', '4')""",
    "label_matches": f"""WITH lex(o, canonical, "role", code) AS (VALUES {_LEXICON}),
      p AS (SELECT p_partkey doc_id, p_type, canonical lb FROM part JOIN lex ON o = p_partkey % 34),
      q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lb || ':' WHEN 1 THEN translate(lb, 'IO', '10') WHEN 2 THEN lower(lb) WHEN 3 THEN p_type ELSE substr(lb, 1, 3) || 'X' || substr(lb, 5) END phrase FROM p),
      f AS (SELECT *, trim(regexp_replace(upper(phrase), '[^A-Z0-9]+', ' ', 'g')) form FROM q),
      m AS (SELECT doc_id, phrase, form, o, code, canonical, "role", form = canonical "exact", 1 - levenshtein(form, canonical) / CAST(greatest(length(form), length(canonical)) AS DOUBLE) score FROM f JOIN lex ON abs(length(form) - length(canonical)) <= 3),
      b AS (SELECT * FROM m WHERE "exact" OR (NOT code AND length(canonical) >= 5 AND score >= 0.85) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "exact" DESC, score DESC, length(canonical) DESC, o) = 1)
      SELECT f.doc_id, f.phrase, canonical, "role", "exact", round(score, 6) score, f.form IN ({_SENTINELS}) sentinel FROM f LEFT JOIN b USING (doc_id)""",
}
