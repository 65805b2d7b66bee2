"""Date-shaped text among the words of a page, as Columns and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column

from veridate.functions import dates, sql

_MARK = r"[/.\-\s]"
#: Fixed values: (pattern, parts of a date, whether it is all numbers), in order.
SHAPES = [
    (rf"^\d{{1,2}}{_MARK}\d{{1,2}}{_MARK}\d{{2,4}}$", 3, True), (rf"^\d{{4}}{_MARK}\d{{1,2}}{_MARK}\d{{1,2}}$", 3, True), (r"^\d{8}$", 3, True), (rf"^\d{{1,2}}{_MARK}(?:\d{{2}}|\d{{4}})$", 2, True),
    (r"^\d{1,2}[ .\-]+[A-Z]{3,12}[ .\-]+\d{2,4}$", 3, False), (r"^[A-Z]{3,12}[ .\-]+\d{1,2}[ .\-]+\d{2,4}$", 3, False), (r"^[A-Z]{3,12}[ .\-]+\d{2,4}$", 2, False),
]
RANGE_STRENGTH = 4


def shape_sql(raw: str) -> str:
    """How many parts of a date a text has the shape of; 0 for none.  Numbers need a mark between them, or to be eight digits."""
    marked = rf"(s rlike {sql.text('[/.-]')} or s rlike {sql.text('^[0-9]{8}$')})"
    cases = " ".join(f"when s rlike {sql.text(pattern)}{' and ' + marked if numeric else ''} then {parts}" for pattern, parts, numeric in SHAPES)
    return sql.let("s", rf"trim(regexp_replace(replace(upper(trim({raw})), ',', ' '), r'\s+', ' '))", f"case {cases} else 0 end")


def parts_sql(raw: str) -> str:
    return f"transform(split({raw}, {sql.text(dates.RANGE)}), v -> trim(v))"


def strength_sql(raw: str) -> str:
    """Parts of a date, or RANGE_STRENGTH for two date shapes around a range mark."""
    return sql.let("g", parts_sql(raw), f"if(size(g) = 2 and forall(g, v -> {shape_sql('v')} > 0), {RANGE_STRENGTH}, {shape_sql(raw)})")


def strength(raw: Column) -> Column:
    return sql.bind(strength_sql("p.raw"), raw=raw)


def reading_sql(raw: str, is_range: str, convention: str, role: str, as_of: str) -> str:
    """Struct (iso, ambiguous) of a date token, null if it reads as no date; a range is read as its end."""
    read = dates.free_text_sql(f"if({is_range}, try_element_at({parts_sql(raw)}, 2), {raw})", convention, role, as_of)
    return sql.let("f", read, "if(f.iso is not null or f.ambiguous, named_struct('iso', f.iso, 'ambiguous', f.ambiguous), null)")
