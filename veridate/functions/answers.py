"""Answers of models as JSON text: taken whole and strictly, or not at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import sql
from veridate.operators.verdict import BASIS

#: What a date can stand for.
ROLES = ["EXPIRY", "ISSUE", "DATE_OF_BIRTH", "STATEMENT_PERIOD_START", "STATEMENT_PERIOD_END", "COVERAGE_START", "COVERAGE_END", "EMPLOYMENT_START", "EMPLOYMENT_END", "APPRAISAL", "PRINT_DATE", "TRANSACTION", "UNKNOWN"]
_TEXT = "(STRING|VOID)"
#: Schemas as Spark names them, fields by name: no field may be missing, of another type, or one too many.
_HUNTER = f"^OBJECT<expiry_raw: {_TEXT}, label_verbatim: {_TEXT}, neighbouring_text: {_TEXT}, reasoning: STRING>$"
_MAPPER = rf"^OBJECT<contains_instruction_like_text: BOOLEAN, dates: ARRAY<.*>, document_type: {_TEXT}, issuing_authority: {_TEXT}>$"
_DATE = f"^OBJECT<illegible: BOOLEAN, inferred_role: STRING, label_verbatim: {_TEXT}, neighbouring_text: {_TEXT}, raw: STRING>$"


def latin_text(content: Column) -> Column:
    """Bytes as text, a character each."""
    return F.decode(content, "ISO-8859-1")


def _fields(of: str, **fields: str) -> str:
    return ", ".join(f"'{name}', variant_get({of}, '$.{field}', 'string')" for name, field in fields.items())


def hunter_answer(body: Column) -> Column:
    """Struct (expiry_raw, label, snippet, reasoning) of an answer about the expiry; null if the text is no JSON or not exactly of that form."""
    found = f"named_struct({_fields('v', expiry_raw='expiry_raw', label='label_verbatim', snippet='neighbouring_text', reasoning='reasoning')})"
    return sql.bind(sql.let("v", "try_parse_json(p.said)", f"if(v is not null and schema_of_variant(v) rlike {sql.text(_HUNTER)}, {found}, null)"), said=body)


def mapper_answer(body: Column) -> Column:
    """Struct (dates, kind, issuer, injected) of an inventory of dates (raw, role, illegible, label, snippet); null if the text is no JSON or not exactly of that form, down to every date's role."""
    entry = f"named_struct({_fields('d', raw='raw', role='inferred_role')}, 'illegible', variant_get(d, '$.illegible', 'boolean'), {_fields('d', label='label_verbatim', snippet='neighbouring_text')})"
    sound = f"forall(ds, d -> schema_of_variant(d) rlike {sql.text(_DATE)} and variant_get(d, '$.inferred_role', 'string') in ({sql.names(ROLES)}))"
    kind = "variant_get(v, '$.document_type', 'string')"
    known = f"({kind} is null or {kind} in ({sql.names(list(BASIS))}))"
    found = f"named_struct('dates', transform(ds, d -> {entry}), {_fields('v', kind='document_type', issuer='issuing_authority')}, 'injected', variant_get(v, '$.contains_instruction_like_text', 'boolean'))"
    whole = sql.let("ds", "variant_get(v, '$.dates', 'array<variant>')", f"if({sound} and {known}, {found}, null)")
    return sql.bind(sql.let("v", "try_parse_json(p.said)", f"if(v is not null and schema_of_variant(v) rlike {sql.text(_MAPPER)}, {whole}, null)"), said=body)
