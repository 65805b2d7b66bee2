"""Class evidence from keywords, shape and image figures, as Columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import phrases, sql
from veridate.functions import text as texts
from veridate.functions.dates import let

#: Class, weight, terms that speak for it.
KEYWORDS = [
    ("BANK_STATEMENT", 1.0, ["statement period", "account statement", "account holder", "account number", "transaction history", "statement of account", "opening balance", "closing balance", "available balance", "account summary", "sort code", "routing number", "iban", "withdrawals", "deposits"]),
    ("UTILITY_BILL", 1.0, ["meter reading", "utility", "bill date", "total due", "supply address", "kwh", "tariff", "amount due", "billing period", "council tax", "electricity supply", "gas supply", "water services", "service address"]),
    ("EMPLOYMENT_LETTER", 1.0, ["to whom it may concern", "confirmation of employment", "employment history", "letter confirms", "employment status", "employment verification", "is employed", "date of joining", "annual salary", "per annum", "human resources", "hereby certify", "job title", "designation"]),
    ("MEDICAL_INSURANCE_CARD", 1.0, ["member id", "insurance", "coverage", "plan name", "benefits", "group number", "rx bin", "rx pcn", "copay", "subscriber", "health plan", "policy number", "coverage period", "effective date"]),
    ("PASSPORT", 1.5, ["passport", "passeport", "pasaporte", "reisepass"]),
    ("US_DRIVERS_LICENSE", 1.4, ["driver license", "driver's license", "driving licence", "dl no", "dln", "department of licensing", "department of motor vehicles"]),
    ("US_DRIVERS_LICENSE", 1.2, ["endorsements", "restrictions"]),
    ("US_STATE_ID", 1.2, ["identification card", "state id", "non-driver"]),
    ("RESIDENCE_PERMIT", 1.4, ["residence permit", "titre de sejour", "aufenthaltstitel", "aufenthaltserlaubnis", "permesso di soggiorno"]),
    ("NATIONAL_ID_CARD", 1.2, ["identity card", "national id", "carte nationale", "personalausweis"]),
]
#: Sizes of common screens.
SCREENS = [(1920, 1080), (2560, 1440), (3840, 2160), (1366, 768), (1536, 864), (1440, 900), (1280, 720), (1600, 900), (1280, 800), (1170, 2532), (1179, 2556), (1284, 2778), (1290, 2796), (1080, 1920), (1080, 2340), (1080, 2400), (1080, 2280), (828, 1792), (750, 1334), (640, 1136), (1440, 3040), (1440, 3200)]


#: Terms too general for the gate.
EXCLUDED = ["restrictions", "endorsements", "bill date", "total due", "amount due", "effective date"]
GATE_TERMS = [(c, t) for c, _, ts in KEYWORDS for t in ts if t not in EXCLUDED]
#: All terms in order, as phrases of one automaton.
TERMS = [t for _, _, terms in KEYWORDS for t in terms]


def keyword_hits(text: Column) -> Column:
    """Indexes of the TERMS, and after them the STATES, that stand anywhere in the lower-case text."""
    return phrases.hits(F.lower(text), [*TERMS, *STATES])


def gate_hit(text: Column) -> Column:
    """Struct (term, class) of the first term, in listed order, that speaks for a document of this domain; null if there is none."""
    terms = ", ".join(f"named_struct('term', {sql.text(t)}, 'class', '{c}')" for c, t in GATE_TERMS)
    return sql.bind(f"get(array({terms}), get(p.found, 0))", found=phrases.hits(F.lower(text), [t for _, t in GATE_TERMS]))


def keyword_scores(found: Column) -> Column:
    """Array of (less, class_ord, class) of the classes with a hit among keyword_hits(), best first, listed order on ties."""
    scores: dict[str, str] = {}
    at = 0
    for name, weight, terms in KEYWORDS:
        part = f"size(filter(p.found, h -> h between {at} and {at + len(terms) - 1})) * {weight}D"
        scores[name] = f"{scores[name]} + {part}" if name in scores else part
        at += len(terms)
    rows = ", ".join(f"named_struct('less', -round({s}, 6), 'class_ord', {i}, 'class', '{name}')" for i, (name, s) in enumerate(scores.items()))
    return sql.bind(f"array_sort(filter(array({rows}), c -> c.less < 0))", found=found)


def aspect(width: Column, height: Column) -> Column:
    """Long over short edge, 0 for an empty one."""
    return F.when((width > 0) & (height > 0), F.greatest(width, height) / F.least(width, height)).otherwise(0.0)


def shape(width: Column, height: Column) -> Column:
    a = aspect(width, height)
    return F.when(a == 0, "UNUSUAL").when(F.abs(a - 85.6 / 54) <= 0.14, "ID1_CARD").when(a.between(1.25, 1.47), "PAPER").when(a < 1.1, "SQUARE").otherwise("UNUSUAL")


def effective_dpi(width: Column, height: Column) -> Column:
    """Pixels an inch if the page has the standard size that its shape suggests."""
    long, a = F.greatest(width, height), F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))
    return F.floor(long / F.when(a.between(1.45, 1.75), 3.37).when((a >= 1.3) & (a < 1.45), 4.92).otherwise(11.0) + 0.5).cast("int")


def too_low_resolution(width: Column, height: Column, size: Column) -> Column:
    return (size < 50 * 1024) & (effective_dpi(width, height) < 150)


def screen_sized(width: Column, height: Column) -> Column:
    """Within two pixels of a common screen, either way up."""
    near = lambda a, b, w, h: (F.abs(a - w) <= 2) & (F.abs(b - h) <= 2)
    return reduce(or_, (near(width, height, w, h) | near(height, width, w, h) for w, h in SCREENS))


#: Names of states and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
#: Confidence from which a class is settled, characters below which a text is blank, blur and resolution floors, clipping ceiling, aspects of a passport's page.
SETTLED, BLANK, BLUR, DPI, CLIPPED, PASSPORT_PAGE = 0.85, 5, 100, 150, 0.15, (1.38, 1.47)
PAPERS = ["BANK_STATEMENT", "UTILITY_BILL", "EMPLOYMENT_LETTER"]


def issuer(hint: Column, mrz_issuer: Column, found: Column) -> Column:
    """The issuer that was given, or read, or the first state whose name is among keyword_hits()."""
    codes = ", ".join(f"'{c}'" for c in STATES.values())
    state = sql.bind(f"get(array({codes}), get(filter(p.found, h -> h >= {len(TERMS)}), 0) - {len(TERMS)})", found=found)
    return F.coalesce(F.nullif(hint, F.lit("")), F.nullif(mrz_issuer, F.lit("")), state)


def damping(blur: Column, dpi: Column, clipping: Column) -> Column:
    """How far image quality lowers a class's confidence; a figure that is null does not."""
    factor = F.when(blur < BLUR, 0.8).otherwise(1.0) * F.when(dpi < DPI, 0.85).otherwise(1.0) * F.when(clipping > CLIPPED, 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.6), factor)


def just_blurry(blur: Column) -> Column:
    return F.coalesce(blur < BLUR, F.lit(True))


def shape_hypotheses(width: Column, height: Column, pages: Column, pdf: Column) -> Column:
    """Classes that a page's shape leaves open."""
    a, kind = aspect(width, height), shape(width, height)
    names = lambda *x: F.array(*map(F.lit, x))
    paper = F.when((F.coalesce(pages, F.lit(1)) > 1) | F.coalesce(pdf, F.lit(False)), names("BANK_STATEMENT", "EMPLOYMENT_LETTER", "UTILITY_BILL")).when(a.between(*PASSPORT_PAGE), names("PASSPORT", "RESIDENCE_PERMIT", "UTILITY_BILL", "EMPLOYMENT_LETTER")).otherwise(names("UTILITY_BILL", "EMPLOYMENT_LETTER", "BANK_STATEMENT"))
    return F.when(kind == "ID1_CARD", names("US_DRIVERS_LICENSE", "US_STATE_ID", "NATIONAL_ID_CARD", "MEDICAL_INSURANCE_CARD")).when(kind == "PAPER", paper).otherwise(names("OTHER_DOCUMENT", "NOT_A_DOCUMENT"))


def _result(name: Column | str, confidence: Column | float, side: Column | str, by: Column, open_: Column | bool, hypotheses: Column, codes: Column, signal: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(name).alias("class"), lit(confidence).cast("double").alias("confidence"), lit(side).alias("side"), by.alias("issuer"), lit(open_).alias("inconclusive"), hypotheses.alias("hypotheses"), codes.alias("codes"), F.lit(signal).alias("signal"))


def from_zone(format: Column, by: Column, codes: Column) -> Column:
    """Class by the format of a machine-readable zone."""
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return (
        F.when(format == "TD3", _result("PASSPORT", 0.97, "FRONT", by, False, names(), codes, "mrz"))
        .when(format == "TD1", _result("NATIONAL_ID_CARD", 0.62, "FRONT", by, True, names("NATIONAL_ID_CARD", "RESIDENCE_PERMIT"), codes, "mrz"))
        .otherwise(_result("NATIONAL_ID_CARD", 0.6, "FRONT", by, True, names("NATIONAL_ID_CARD", "PASSPORT", "RESIDENCE_PERMIT"), codes, "mrz"))
    )


def from_barcode(payload: Column, by: Column, codes: Column) -> Column:
    """Class by a barcode's vehicle class and country; a barcode that could not be read leaves three classes open."""
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    part = lambda code: F.when(payload.rlike(code), F.trim(F.regexp_extract(payload, code + r"([^\r\n]*)", 1)))
    vehicle, country = part("DCA"), F.upper(part("DCG"))
    us = F.coalesce(country == "USA", F.lit(True))
    licence = F.coalesce((vehicle != "") & (F.upper(vehicle) != "NONE"), F.lit(False))
    return (
        F.when(F.coalesce(payload, F.lit("")) == "", _result("US_DRIVERS_LICENSE", 0.75, "BACK", by, True, names("US_DRIVERS_LICENSE", "US_STATE_ID", "NON_US_DRIVERS_LICENSE"), codes, "pdf417"))
        .when(licence, _result(F.when(us, "US_DRIVERS_LICENSE").otherwise("NON_US_DRIVERS_LICENSE"), 0.96, "BACK", by, False, names(), codes, "pdf417"))
        .otherwise(_result("US_STATE_ID", 0.9, "BACK", by, False, names(), codes, "pdf417"))
    )


def classify(text: Column, width: Column, height: Column, has_mrz: Column, mrz_format: Column, mrz_issuer: Column, has_barcode: Column, payload: Column, hint: Column, pages: Column, pdf: Column, exact_text: Column, blur: Column, dpi: Column, clipping: Column) -> Column:
    """Struct (class, confidence, side, issuer, inconclusive, hypotheses, codes, signal): machine-readable regions first, then vocabulary, then a blank page, then shape."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")

    def body(x: Column) -> Column:
        by = issuer(hint, mrz_issuer, x["found"])
        foreign = text.isNotNull() & (x["letters"] > 0) & texts.non_latin_dominant(text)
        codes = F.when(foreign, names("UNSUPPORTED_SCRIPT")).otherwise(names())
        damped = damping(blur, dpi, clipping)
        best, margin = -F.get(x["scored"], F.lit(0))["less"], F.get(x["scored"], F.lit(0))["less"] * -1 + F.coalesce(F.get(x["scored"], F.lit(1))["less"], F.lit(0.0))
        strong = F.when(exact_text, (best >= 2) | (best >= 1) & (margin >= 1)).otherwise((best >= 2) | (best >= 1.4) & (margin >= 1))
        sure = F.least(F.lit(1.0), F.lit(0.55) + F.least(F.lit(0.4), best * 0.08) + F.least(F.lit(0.1), margin * 0.05)) * damped
        kind = F.get(x["scored"], F.lit(0))["class"]
        side = F.when(kind.isin(PAPERS), "N/A").when(has_barcode, "BACK").when(has_mrz, "FRONT").otherwise("UNKNOWN")
        worded = text.isNotNull() & (x["letters"] >= BLANK) & (F.size(x["scored"]) > 0) & strong & (sure >= 0.6)
        probed = F.coalesce(~has_mrz & ~has_barcode, F.lit(False))
        blank = text.isNotNull() & (x["letters"] < BLANK) & probed & ~just_blurry(blur)
        bare = F.concat(codes, F.when((shape(width, height) == "ID1_CARD") & probed, names("NO_MACHINE_READABLE_REGION")).otherwise(names()))
        return (
            F.when(F.coalesce(has_mrz & mrz_format.isNotNull(), F.lit(False)), from_zone(mrz_format, F.coalesce(mrz_issuer, hint), codes))
            .when(F.coalesce(has_barcode, F.lit(False)), from_barcode(payload, by, codes))
            .when(F.coalesce(worded, F.lit(False)), _result(kind, F.round(sure, 2), side, by, sure < SETTLED, F.when(sure < SETTLED, F.transform(F.slice(x["scored"], 1, 3), lambda s: s["class"])).otherwise(names()), codes, "keywords"))
            .when(blank, _result("NOT_A_DOCUMENT", F.round(damped * 0.6, 2), "N/A", F.lit(None).cast("string"), True, names("NOT_A_DOCUMENT", "OTHER_DOCUMENT"), F.concat(codes, names("CLASS_UNRECOGNIZED")), "text"))
            .otherwise(_result("OTHER_DOCUMENT", F.round(damped * 0.25, 2), "UNKNOWN", by, True, shape_hypotheses(width, height, pages, pdf), bare, "shape"))
        )

    letters = F.length(F.regexp_replace(low, "[^a-z0-9]", "")).alias("letters")
    seen = F.struct(letters, keyword_hits(low).alias("found"))
    return let(seen, lambda x: let(F.struct(x["letters"], x["found"], keyword_scores(x["found"]).alias("scored")), body))
