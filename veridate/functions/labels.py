"""Printed labels: the lexicon and how phrases match it, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import phrases, sql, text

#: Labels of a date that ends validity, of one that dates a statement, and field codes of licence cards.
EXPIRY_LABELS = [
    "EXP", "EXPIRES", "EXPIRATION", "EXPIRATION DATE", "EXPIRY", "EXPIRY DATE", "DATE OF EXPIRY", "DATE OF EXPIRATION", "VALID THRU", "VALID THROUGH", "VALID UNTIL",
    "VALID TO", "ENDS ON", "END DATE", "BENEFIT PERIOD", "COVERAGE PERIOD", "GOOD THRU", "GOOD THROUGH", "NOT VALID AFTER", "EXPIRE LE", "FECHA DE VENCIMIENTO",
]
RECENCY_LABELS = ["STATEMENT PERIOD", "STATEMENT DATE", "PERIOD ENDING", "PERIOD END", "CLOSING DATE", "BILLING PERIOD", "BILL DATE", "INVOICE DATE", "ISSUED ON", "DATE OF ISSUE"]
FIELD_CODES = [("4A", "ISSUE"), ("4B", "EXPIRY"), ("3", "DATE_OF_BIRTH")]
#: (canonical form, role, whether it is a field code), in order of precedence.
LEXICON = [*((x, "EXPIRY", False) for x in EXPIRY_LABELS), *((x, "STATEMENT_PERIOD_END", False) for x in RECENCY_LABELS), *((x, r, True) for x, r in FIELD_CODES)]
#: Codes that mark a licence card's layout, and words before a label that make its date one to come.
LAYOUT_CODES, FORWARD = ["4A", "4B", "4D"], ["NEXT", "UPCOMING", "FOLLOWING"]
MOST_WORDS, FUZZY, FUZZY_LENGTH, FUZZY_SLACK = 3, 0.85, 5, 3


def match_sql(form: str) -> str:
    """match() as SQL text."""
    entries = ", ".join(f"named_struct('canonical', {sql.text(c)}, 'role', '{r}', 'code', {str(k).lower()}, 'ord', {i})" for i, (c, r, k) in enumerate(LEXICON))
    like = f"cast(if(e.canonical = {form}, 1, 1 - levenshtein(e.canonical, {form}) / greatest(length(e.canonical), length({form}))) as double)"
    kept = f"e.canonical = {form} or not e.code and length(e.canonical) >= {FUZZY_LENGTH} and e.score >= {FUZZY}"
    near = f"transform(filter(array({entries}), e -> abs(length(e.canonical) - length({form})) <= {FUZZY_SLACK}), e -> struct({like} as score, length(e.canonical) as length, -e.ord as later, e.canonical, e.role, e.code))"
    return sql.let("b", f"array_max(filter({near}, e -> {kept}))", f"if(b is null, null, named_struct('canonical', b.canonical, 'role', b.role, 'code', b.code, 'score', b.score, 'exact', b.canonical = {form}, 'ord', -b.later))")


def match(form: Column) -> Column:
    """Struct (canonical, role, code, score, exact, ord) of the best label for a phrase in label form; null if none is near enough.

    An exact label wins; field codes and short labels match exactly only; else the nearest one, longer ones on ties, then the first.
    """
    return sql.bind(match_sql("p.form"), form=form)


#: A code of digits alone looks like any number on the page.
BARE = "^[0-9]+$"


#: Phrases by which a document says that it has no end.
NON_EXPIRING = ["NON-EXPIRING", "NON EXPIRING", "NONEXPIRING", "INDEFINITE", "DOES NOT EXPIRE", "NO EXPIRATION", "NO EXPIRY", "PERMANENT", "COVERAGE CONTINUOUS", "CONTINUOUS COVERAGE", "NO TERMINATION DATE"]


def declares_no_expiry(words: Column) -> Column:
    """Whether a text says in words, anywhere and in either case, that there is no end; false for null."""
    return F.coalesce(F.size(phrases.hits(F.upper(words), NON_EXPIRING)) > 0, F.lit(False))
