"""Calendar and date-reading functions as Columns.

Dates are never guessed: a reading that stays ambiguous is null with its
alternatives beside it, and `as_of` is always given, never the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import sql

#: Month names by number, in five languages.
MONTHS = {
    1: "JAN JANUARY ENE ENERO JANVIER JANUAR GEN", 2: "FEB FEBRUARY FEBRERO FEVRIER FÉVRIER FEBRUAR", 3: "MAR MARCH MARZO MARS MARZ MÄRZ", 4: "APR APRIL ABR ABRIL AVR AVRIL",
    5: "MAY MAI MAYO MAGGIO", 6: "JUN JUNE JUNIO JUIN JUNI GIUGNO", 7: "JUL JULY JULIO JUIL JUILLET JULI LUGLIO", 8: "AUG AUGUST AGO AGOSTO AOU AOUT AOÛT",
    9: "SEP SEPT SEPTEMBER SEPTIEMBRE SEPTEMBRE", 10: "OCT OCTOBER OCTUBRE OCTOBRE OKT OKTOBER", 11: "NOV NOVEMBER NOVIEMBRE NOVEMBRE", 12: "DEC DECEMBER DIC DICIEMBRE DECEMBRE DEZ DEZEMBER",
}
SEP = r"[/\-.\s]"
RANGE = r"(?i)\s*(?:–|—|-{1,2}|\bTO\b|\bTHRU\b|\bTHROUGH\b)\s*"


def ymd_sql(year: str, month: str, day: str) -> str:
    """ymd() as SQL text: looked up in the calendar, as a failed parse would cost an exception."""
    there = "o.y between 1900 and 2200 and o.m between 1 and 12 and o.d between 1 and day(last_day(make_date(o.y, o.m, 1)))"
    return sql.let("o", f"named_struct('y', {year}, 'm', {month}, 'd', {day})", f"if({there}, make_date(o.y, o.m, o.d), null)")


def ymd(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if the calendar lacks it or the year is outside 1900 to 2200."""
    return sql.bind(ymd_sql("p.year", "p.month", "p.day"), year=year, month=month, day=day)


def years_after(date: Column, years: int) -> Column:
    """The anniversary; 29 February becomes the 28th where needed."""
    return F.add_months(date, 12 * years)


def exceeds_anniversary(start: Column, date: Column, years: int) -> Column:
    return date > years_after(start, years)


def precedes_anniversary(start: Column, date: Column, years: int) -> Column:
    return date < years_after(start, years)


def span_years(start: Column, end: Column) -> Column:
    """Average years of 365.2425 days."""
    return F.datediff(end, start) / F.lit(365.2425)


def full_year(yy: Column, role: Column, as_of: Column) -> Column:
    """Century of a two-digit year: a birth is never in the future, all else lies nearest, the earlier century on a tie."""
    now = F.year(as_of)
    century = now - now % 100
    born = F.when(century + yy > now, century + yy - 100).otherwise(century + yy)
    choices = F.array(*(F.struct(F.abs(century + k + yy - now).alias("far"), (century + k + yy).alias("year")) for k in (-100, 0, 100)))
    return F.when(role == "DATE_OF_BIRTH", born).otherwise(F.array_min(choices)["year"])


def aamva_date(value: Column, country: Column) -> Column:
    """Eight digits, year first for CAN, month first for USA."""
    v = F.trim(value)
    part = lambda a, n: F.substring(v, a, n).try_cast("int")
    return F.when(v.rlike(r"^\d{8}$"), F.when(country == "CAN", ymd(part(1, 4), part(5, 2), part(7, 2))).otherwise(ymd(part(5, 4), part(1, 2), part(3, 2))))


def mrz_date(value: Column, role: Column, as_of: Column) -> Column:
    """Six digits, year first."""
    v = F.trim(value)
    part = lambda a: F.substring(v, a, 2).try_cast("int")
    return F.when(v.rlike(r"^\d{6}$"), ymd(full_year(part(1), role, as_of), part(3), part(5)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with `value` computed once and bound, where a deep expression would repeat it."""
    return F.transform(F.array(value), body)[0]


def _full_year_sql(yy: str, role: str, as_of: str) -> str:
    """full_year() as SQL text."""
    century = "(cy.now - cy.now % 100 + cy.yy)"
    nearest = ", ".join(f"struct(abs({century} + {k} - cy.now), {century} + {k} as year)" for k in (-100, 0, 100))
    return sql.let("cy", f"named_struct('yy', {yy}, 'now', year({as_of}))", f"if({role} = 'DATE_OF_BIRTH', if({century} > cy.now, {century} - 100, {century}), array_min(array({nearest})).year)")


def _read_sql(iso: str, rule: str, ambiguous: str = "false", alternatives: str = "cast(array() as array<date>)") -> str:
    return f"named_struct('iso', cast({iso} as date), 'ambiguous', {ambiguous}, 'alternatives', {alternatives}, 'rule', '{rule}')"


def _whole_sql(date: str, rule: str, invalid: str = "numeric_invalid") -> str:
    return sql.let("w", date, f"if(w is null, {_read_sql('null', invalid)}, {_read_sql('w', rule)})")


def _triple_sql(first: str, second: str, year: str, convention: str) -> str:
    """Three numbers: whichever order the calendar allows, else the issuer's convention, else ambiguous."""
    decide = f"""case when d.mdy is not null and d.dmy is null then {_read_sql("d.mdy", "numeric_mdy_only")} when d.dmy is not null and d.mdy is null then {_read_sql("d.dmy", "numeric_dmy_only")}
        when d.mdy is null then {_read_sql("null", "numeric_invalid")} when {convention} = 'US' then {_read_sql("d.mdy", "numeric_us_issuer")} when {convention} = 'DMY' then {_read_sql("d.dmy", "numeric_dmy_issuer")}
        else {_read_sql("null", "numeric_ambiguous", "true", "array(d.mdy, d.dmy)")} end"""
    both = f"named_struct('mdy', {ymd_sql('n.y', 'n.a', 'n.b')}, 'dmy', {ymd_sql('n.y', 'n.b', 'n.a')})"
    return sql.let("n", f"named_struct('a', try_cast({first} as int), 'b', try_cast({second} as int), 'y', {year})", sql.let("d", both, decide))


def _named_sql(month: str, numbers: str, role: str, as_of: str) -> str:
    """A month name with a year, and a day if there is one."""
    parts = f"named_struct('one', try_element_at({numbers}, 1), 'two', try_element_at({numbers}, 2), 'large', try_element_at(filter({numbers}, v -> v >= 1000), 1))"
    year = f"case when a.large is not null then a.large else {_full_year_sql('if(a.two is null, a.one, greatest(a.one, a.two))', role, as_of)} end"
    day = f"case when a.large is not null then try_element_at(filter({numbers}, v -> v <> a.large), 1) when a.two is not null then least(a.one, a.two) end"
    read = f"if(e.d is null, {_read_sql('last_day(' + ymd_sql('e.y', 'e.m', '1') + ')', 'month_year')}, {_whole_sql(ymd_sql('e.y', 'e.m', 'e.d'), 'month_name', 'month_name_invalid')})"
    return sql.let("a", parts, sql.let("e", f"named_struct('y', {year}, 'm', {month}, 'd', {day})", read))


def free_text_sql(raw: str, convention: str, role: str, as_of: str) -> str:
    """free_text_date() as SQL text."""
    iso, my, triple = (sql.text(x) for x in (rf"^(\d{{4}}){SEP}(\d{{1,2}}){SEP}(\d{{1,2}})$", rf"^(\d{{1,2}}){SEP}(\d{{4}}|\d{{2}})$", rf"^(\d{{1,2}}){SEP}(\d{{1,2}}){SEP}(\d{{4}}|\d{{2}})$"))
    part = lambda pattern, i: f"regexp_extract(t, {pattern}, {i})"
    number = lambda pattern, i: f"try_cast({part(pattern, i)} as int)"
    year = lambda token: f"if(length({token}) = 4, try_cast({token} as int), {_full_year_sql(f'try_cast({token} as int)', role, as_of)})"
    piece = lambda a, n: f"try_cast(substring(t, {a}, {n}) as int)"
    month = "case " + " ".join(f"when m in ({sql.names(names.split())}) then {i}" for i, names in MONTHS.items()) + " end"
    worded = sql.let("k", f"split(t, {sql.text(SEP)})", f"named_struct('m', try_element_at(filter(transform(k, m -> {month}), m -> m is not null), 1), 'n', transform(filter(k, v -> v rlike {sql.text(r'^[0-9]{1,4}$')}), v -> try_cast(v as int)))")
    digits = sql.let("w", ymd_sql(piece(1, 4), piece(5, 2), piece(7, 2)), f"if(w is not null, {_read_sql('w', 'compact_ymd')}, {_triple_sql('substring(t, 1, 2)', 'substring(t, 3, 2)', piece(5, 4), convention)})")
    body = f"""case when q.m is not null and size(q.n) > 0 then {_named_sql("q.m", "q.n", role, as_of)}
        when t rlike {iso} then {_whole_sql(ymd_sql(number(iso, 1), number(iso, 2), number(iso, 3)), "iso_order")}
        when t rlike {my} and {number(my, 1)} between 1 and 12 then {_read_sql("last_day(" + ymd_sql(year(part(my, 2)), number(my, 1), "1") + ")", "month_year")}
        when t rlike {triple} then {_triple_sql(part(triple, 1), part(triple, 2), year(part(triple, 3)), convention)}
        when t rlike {sql.text(r"^[0-9]{8}$")} then {digits} else {_read_sql("null", "unrecognised")} end"""
    return sql.let("t", rf"trim(regexp_replace(replace(upper(trim({raw})), ',', ' '), r'\s+', ' '))", sql.let("q", f"if(t rlike '[A-Z]', {worded}, null)", body))


def free_text_date(raw: Column, convention: Column, role: Column, as_of: Column) -> Column:
    """Struct (iso, ambiguous, alternatives, rule): month names, ISO order, month and year, three numbers, eight digits, in this order."""
    return sql.bind(free_text_sql("p.raw", "p.convention", "p.role", "p.as_of"), raw=raw, convention=convention, role=role, as_of=as_of)


def range_sql(raw: str, convention: str, role: str, as_of: str) -> str:
    """date_range() as SQL text."""
    end = lambda i, role: f"{free_text_sql(f'try_element_at(g, {i})', convention, role, as_of)}.iso"
    both = sql.let("h", f"""named_struct('start', {end(1, "'COVERAGE_START'")}, 'end', {end(2, role)})""", "if(h.start is not null or h.end is not null, h, null)")
    return sql.let("g", f"filter(transform(split({raw}, {sql.text(RANGE)}), v -> trim(v)), v -> v <> '')", f"if(size(g) = 2, {both}, null)")


def date_range(raw: Column, convention: Column, role: Column, as_of: Column) -> Column:
    """Struct (start, end) of two dates around a range mark; null unless there are two parts of which one is a date."""
    return sql.bind(range_sql("p.raw", "p.convention", "p.role", "p.as_of"), raw=raw, convention=convention, role=role, as_of=as_of)


def confusable_variants(digits: Column) -> Column:
    """All strings with one digit changed to one that optical readers take it for (0-8, 1-7, 5-6, 3-9), in order of place."""
    pairs = {"0": "8", "8": "0", "1": "7", "7": "1", "5": "6", "6": "5", "3": "9", "9": "3"}
    other = lambda c: reduce(lambda acc, k: acc.when(c == k, pairs[k]), pairs, F)
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits))).otherwise(F.array().cast("array<int>"))
    changed = F.transform(at, lambda i: F.when(other(F.substring(digits, i, F.lit(1))).isNotNull(), F.concat(F.substring(digits, F.lit(1), i - 1), other(F.substring(digits, i, F.lit(1))), F.substring(digits, i + 1, F.length(digits)))))
    return F.filter(changed, lambda v: v.isNotNull())


def probable_misread(raw: Column, satisfies: Callable[[Column], Column]) -> Column:
    """Whether a text of six digits or more would satisfy a condition if an optical reader had taken one of its digits for another; the text itself is never changed."""
    return (F.length(F.regexp_replace(raw, "[^0-9]", "")) >= 6) & F.exists(confusable_variants(raw), satisfies)
