"""Machine-readable zones and barcode payloads as Columns (public ICAO 9303 and AAMVA layouts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import dates, sql

#: Fixed values (ICAO 9303, TD3 second line): field, first character (from 1), length, place of its check digit.
TD3 = (("document_number", 1, 9, 10), ("birth_date", 14, 6, 20), ("expiry_date", 22, 6, 28), ("personal_number", 29, 14, 43))


def check_digit_sql(text: str) -> str:
    """check_digit() as SQL text."""
    weight = "case i % 3 when 0 then 7 when 1 then 3 else 1 end"
    value = "case when ascii(c) = 60 then 0 when ascii(c) between 48 and 57 then ascii(c) - 48 when ascii(c) between 65 and 90 then ascii(c) - 55 end"
    return f"aggregate(transform(filter(split({text}, ''), c -> c <> ''), (c, i) -> {value} * {weight}), 0, (a, v) -> a + v, a -> cast(a % 10 as string))"


def check_digit(text: Column) -> Column:
    """Weights 7, 3, 1 in turn over 0 for the filler, digits as they are and A to Z as 10 to 35, modulo 10; null if a character has no value."""
    return sql.bind(check_digit_sql("p.text"), text=text)


def td3_failures(line: Column) -> Column:
    """Names of the fields of a 44-character line whose check digit is wrong, in order, `composite` last."""
    wrong = [F.when(~check_digit(F.substring(line, a, n)).eqNullSafe(F.substring(line, d, 1)), name) for name, a, n, d in TD3]
    whole = F.concat(F.substring(line, 1, 10), F.substring(line, 14, 7), F.substring(line, 22, 22))
    wrong.append(F.when(~check_digit(whole).eqNullSafe(F.substring(line, 44, 1)), "composite"))
    return F.array_compact(F.array(*wrong))


def alphabet_ratio(line: Column) -> Column:
    """Share of non-blank characters that a machine-readable zone can hold; 0 for none."""
    seen = F.upper(F.regexp_replace(line, r"\s", ""))
    return F.when(F.length(seen) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(seen, "[^A-Z0-9<]", "")) / F.length(seen))


def aamva_payload(payload: Column) -> Column:
    """Struct (iin, version, types, elements) of a barcode payload; null without a compliance header.

    Records are found by their own codes, not by the header's offsets: after as many subfile designators as it
    counts, or else from the first mark of a subfile on.  Records end with LF, CR or RS; the first of a code wins,
    empty values drop out.
    """
    header = r"(ANSI |AAMVA)([0-9]{6})([0-9]{2})"
    after = "substring(p.payload, regexp_instr(p.payload, h) + 13)"
    plain = sql.let("n", "coalesce(try_cast(substring(t, 1, 2) as int), 0)", "regexp_extract(substring(t, 3), concat('^((?:[A-Z]{2}[0-9]{8}){0,', n, '})'), 1)")
    types = "if(d = '', array('DL', 'ID'), transform(sequence(1, int(length(d) / 10)), i -> substring(d, 10 * i - 9, 2)))"
    body = "if(d <> '', substring(t, 3 + length(d)), substring(t, 2 + greatest(1, regexp_instr(substring(t, 3), '(?:DL|ID|EN)[A-Z]{3}'))))"
    bare = "if(exists(y, k -> startswith(s, k) and substring(s, 3, 3) rlike '^[A-Z]{3}'), substring(s, 3), s)"
    pair = "named_struct('code', substring(s, 1, 3), 'value', regexp_replace(substring(s, 4), r'^\\s+|\\s+$', ''))"
    pairs = f"filter(transform(filter(transform(split({body}, r'[\\n\\r\\x1e]+'), s -> {bare}), s -> s rlike '^[A-Z]{{3}}'), s -> {pair}), v -> v.value <> '')"
    elements = sql.let("r", pairs, "map_from_entries(filter(r, (v, i) -> not exists(slice(r, 1, i), u -> u.code = v.code)))")
    found = sql.let("d", plain, sql.let("y", types, f"named_struct('iin', regexp_extract(p.payload, h, 2), 'version', int(regexp_extract(p.payload, h, 3)), 'types', y, 'elements', {elements})"))
    tail = f"if(regexp_extract(p.payload, h, 3) >= '02', substring({after}, 3), {after})"
    return sql.bind(sql.let("h", sql.text(header), f"if(p.payload rlike h, {sql.let('t', tail, found)}, null)"), payload=payload)


def aamva_elements(payload: Column) -> Column:
    """Map of element codes to values."""
    return aamva_payload(payload)["elements"]


def aamva_version(payload: Column) -> Column:
    return F.regexp_extract(payload, r"ANSI \d{6}(\d{2})", 1).try_cast("int")


def aamva_resolved(value: Column, country: Column, version: Column) -> Column:
    """Struct (iso, conflict): the order that version and country declare; if only the other order is a date, a conflict and no date; undeclared, the one order that is a date."""
    usa, can = dates.aamva_date(value, F.lit("USA")), dates.aamva_date(value, F.lit("CAN"))
    declared = F.when(version <= 1, None).otherwise(country)
    own, other = F.when(declared == "CAN", can).when(declared == "USA", usa), F.when(declared == "CAN", usa).when(declared == "USA", can)
    iso = F.when(declared.isin("CAN", "USA"), own).when(usa.isNull(), can).when(can.isNull(), usa)
    return F.struct(iso.alias("iso"), (F.coalesce(declared.isin("CAN", "USA"), F.lit(False)) & own.isNull() & other.isNotNull()).alias("conflict"))


#: Fixed values (ICAO 9303): format, characters of a line, lines.
LAYOUTS = [("TD1", 30, 3), ("TD2", 36, 2), ("TD3", 44, 2)]
#: Fixed values (ICAO 9303): for each format the check digits as (field, line, place, covered parts as (line, first, length)), lines and places from 1.
CHECKS = {
    "TD1": [("documentNumber", 1, 15, [(1, 6, 9)]), ("birthDate", 2, 7, [(2, 1, 6)]), ("expirationDate", 2, 15, [(2, 9, 6)]), ("composite", 2, 30, [(1, 6, 25), (2, 1, 7), (2, 9, 7), (2, 19, 11)])],
    "TD2": [("documentNumber", 2, 10, [(2, 1, 9)]), ("birthDate", 2, 20, [(2, 14, 6)]), ("expirationDate", 2, 28, [(2, 22, 6)]), ("composite", 2, 36, [(2, 1, 10), (2, 14, 7), (2, 22, 14)])],
    "TD3": [("documentNumber", 2, 10, [(2, 1, 9)]), ("birthDate", 2, 20, [(2, 14, 6)]), ("expirationDate", 2, 28, [(2, 22, 6)]), ("personalNumber", 2, 43, [(2, 29, 14)]), ("composite", 2, 44, [(2, 1, 10), (2, 14, 7), (2, 22, 22)])],
}
#: Letters that optical readers put for digits, and the digits; digits that they put for letters, and the letters.
_LETTERS, _DIGITS, _READ, _MEANT = "OQDILZSGB", "000112568", "012568", "OIZSGB"
#: Fixed values (ICAO 9303): what stands at each place of a line, as runs: A letters, N digits, X either.
FORMS = {"TD1": ["5A 9X 1N 15X", "7N 1A 7N 3A 11X 1N", "30A"], "TD2": ["36A", "9X 1N 3A 7N 1A 7N 7X 1N"], "TD3": ["44A", "9X 1N 3A 7N 1A 7N 14X 2N"]}
_BAND = "struct<score:double,ord:int,format:string,start:int,lines:array<string>>"


def sanitized(line: Column) -> Column:
    """A scanned line in the alphabet of the zone: guillemets and a small c stand for the filler, the rest goes."""
    filled = F.regexp_replace(F.regexp_replace(line, "«", "<<"), "[‹\u200cc]", "<")
    return F.regexp_replace(F.upper(filled), "[^A-Z0-9<]", "")


def band(lines: Column, top: float = 0.7) -> Column:
    """Struct (format, start, lines) of the machine-readable zone among a page's lines: as many lines as a format has, all of its length and alphabet, one with a filler, the lowest on the page; null if there is none."""
    clean = F.transform(lines, lambda x: F.struct(sanitized(x).alias("text"), alphabet_ratio(x).alias("ratio")))

    def found(rows: Column) -> Column:
        last = F.size(rows) - 1

        def of_layout(ord: int, name: str, length: int, many: int) -> Column:
            def option(i: Column) -> Column:
                own = F.slice(rows, i + 1, many)
                fits = F.forall(own, lambda x: (F.length(x["text"]) == length) & (x["ratio"] >= 0.8)) & F.exists(own, lambda x: F.contains(x["text"], F.lit("<")))
                at = F.when(last > 0, i / F.greatest(last, F.lit(1))).otherwise(1.0)
                return F.when(fits, F.struct((at + F.when(at >= top, 1.0).otherwise(0.0)).alias("score"), (-i - 1000 * ord).alias("ord"), F.lit(name).alias("format"), i.alias("start"), F.transform(own, lambda x: x["text"]).alias("lines")).cast(_BAND))

            return F.transform(F.when(F.size(rows) >= many, F.sequence(F.lit(0), F.size(rows) - many)).otherwise(F.array().cast("array<int>")), option)

        options = [of_layout(ord, *layout) for ord, layout in enumerate(LAYOUTS)]
        return F.array_max(F.filter(F.concat(*options), lambda o: o.isNotNull()))

    return dates.let(clean, found)


def _reports_sql(format: str, lines: str) -> str:
    def report(field: str, line: int, place: int, parts: list[tuple[int, int, int]]) -> str:
        covered = ", ".join(f"substring({lines}[{n - 1}], {a}, {size})" for n, a, size in parts)
        digits = f"named_struct('found', nullif(substring({lines}[{line - 1}], {place}, 1), ''), 'expected', {check_digit_sql(f'concat({covered})')})"
        return sql.let("r", digits, f"named_struct('field', '{field}', 'line', {line}, 'position', {place}, 'found', r.found, 'expected', r.expected, 'valid', coalesce(r.found = r.expected, false))")

    cases = " ".join(f"when '{name}' then array({', '.join(report(*c) for c in checks)})" for name, checks in CHECKS.items())
    return f"case {format} {cases} else cast(array() as array<struct<field:string,line:int,position:int,found:string,expected:string,valid:boolean>>) end"


def check_reports(format: Column, lines: Column) -> Column:
    """Array of (field, line, position, found, expected, valid), one for each check digit of the format."""
    return sql.bind(_reports_sql("p.format", "p.lines"), format=format, lines=lines)


def _repaired_sql(format: str, lines: str) -> str:
    def mended(text: str, runs: str) -> str:
        out, at = [], 1
        for run in runs.split():
            size, kind = int(run[:-1]), run[-1]
            part = f"substring({text}, {at}, {size})"
            out.append({"N": f"translate({part}, '{_LETTERS}', '{_DIGITS}')", "A": f"translate({part}, '{_READ}', '{_MEANT}')", "X": part}[kind])
            at += size
        return f"concat({', '.join(out)}, substring({text}, {at}))"

    cases = " ".join(f"when '{name}' then array({', '.join(mended(f'{lines}[{i}]', runs) for i, runs in enumerate(forms))})" for name, forms in FORMS.items())
    return f"case {format} {cases} end"


def repair_notes(format: Column, lines: Column) -> Column:
    """Which letters changed to digits where only digits stand, and digits to letters where only letters do, would make every check digit valid, as `O→0 at line 2 col 14`; null if none would."""
    place = "concat(substring(z.a, k, 1), '→', substring(z.b, k, 1), ' at line ', i + 1, ' col ', k)"
    notes = f"flatten(transform(zip_with(p.lines, n, (u, v) -> struct(u as a, v as b)), (z, i) -> transform(filter(sequence(1, length(z.a)), k -> substring(z.a, k, 1) <> substring(z.b, k, 1)), k -> {place})))"
    sound = f"forall({_reports_sql('p.format', 'n')}, c -> c.valid)"
    told = sql.let("o", notes, "if(size(o) > 0, array_join(o, ', '), null)")
    return sql.bind(sql.let("n", _repaired_sql("p.format", "p.lines"), f"if({sound}, {told}, null)"), format=format, lines=lines)


def zone_fields(format: Column, lines: Column) -> Column:
    """Struct (issuer, birth, expiry) as they stand in a zone's lines."""
    at = lambda line, a, n: F.substring(F.get(lines, F.lit(line - 1)), a, n)
    td1 = format == "TD1"
    birth, expiry = F.when(td1, at(2, 1, 6)).otherwise(at(2, 14, 6)), F.when(td1, at(2, 9, 6)).otherwise(at(2, 22, 6))
    return F.struct(F.nullif(F.replace(at(1, 3, 3), F.lit("<"), F.lit("")), F.lit("")).alias("issuer"), birth.alias("birth"), expiry.alias("expiry"))
