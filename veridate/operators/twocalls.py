"""What two model calls say about a page: one asked for the expiry (hunter), one for every date (mapper), merged as Columns.

The hunter's value never wins by itself: it raises the mapper's date that it agrees
with, or stays beside the others with little confidence and a code that says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import dates, sql

#: Confidence of a date that both calls report, of the mapper's expiry and other dates, of an ambiguous one, of the hunter's alone against the mapper or without it, and the factor of an illegible value.
BOTH, EXPIRY, OTHER, AMBIGUOUS, AGAINST, ALONE, ILLEGIBLE = 0.85, 0.6, 0.5, 0.3, 0.15, 0.5, 0.5
#: Classes that may have no expiry, roles that bear one.
WITHOUT, BEARING = ["EMPLOYMENT_LETTER", "OTHER_DOCUMENT", "NOT_A_DOCUMENT"], ["EXPIRY", "COVERAGE_END"]
CANDIDATE = "struct<raw:string,iso:date,role:string,confidence:double,ambiguous:boolean,illegible:boolean,keys:array<string>,label:string,snippet:string>"


def keys_sql(raw: str, iso: str) -> str:
    return sql.let("k", f"regexp_replace(upper({raw}), '[^A-Z0-9]', '')", f"array_compact(array(concat('iso:', cast({iso} as string)), if(k <> '', concat('raw:', k), null)))")


def match_keys(raw: Column, iso: Column) -> Column:
    """What two reports of one value have in common: its date, or its letters and digits."""
    return sql.bind(keys_sql("p.raw", "p.iso"), raw=raw, iso=iso)


def mapper_sql(entry: str, printed: bool) -> str:
    """SQL of a candidate from an entry (raw, role, illegible, and label and snippet if printed): a range counts by its end."""
    role = f"if(x.ends is not null and {entry}.role in ('UNKNOWN', 'COVERAGE_START'), 'COVERAGE_END', {entry}.role)"
    iso, unclear = "coalesce(x.ends, x.one.iso)", "(x.ends is null and x.one.ambiguous)"
    beside = lambda name: f"{entry}.{name}" if printed else "cast(null as string)"
    base = f"if(y.role in ({sql.names(BEARING)}), {EXPIRY}D, {OTHER}D) * if({entry}.illegible, {ILLEGIBLE}D, 1.0D)"
    built = f"named_struct('raw', trim({entry}.raw), 'iso', y.iso, 'role', y.role, 'confidence', if(y.unclear or y.iso is null, least({base}, {AMBIGUOUS}D), {base}), 'ambiguous', y.unclear, 'illegible', {entry}.illegible, 'keys', {keys_sql(f'trim({entry}.raw)', 'y.iso')}, 'label', {beside('label')}, 'snippet', {beside('snippet')})"
    read = sql.let("y", f"named_struct('role', {role}, 'iso', {iso}, 'unclear', {unclear})", built)
    given = f"named_struct('ends', {dates.range_sql(f'trim({entry}.raw)', 'p.convention', chr(39) + 'COVERAGE_END' + chr(39), 'p.as_of')}.end, 'one', {dates.free_text_sql(f'trim({entry}.raw)', 'p.convention', f'{entry}.role', 'p.as_of')})"
    return sql.let("x", given, read)


#: Codes of a failed call.
FAILURES = ["RATE_LIMITED", "TIMEOUT", "MODEL_UNAVAILABLE"]


def merge(hunter: Column, hunter_ok: Column, mapper: Column, mapper_ok: Column, document_class: Column, injected: Column, convention: Column, as_of: Column, failures: Column | None = None, printed: tuple[Column, Column] | None = None) -> Column:
    """Struct (candidates, codes, abstained): hunter is a raw value or null, mapper an array of (raw, role, illegible); a call that failed has its flag false.

    failures: codes of the calls that failed, as `attempts` gives them; MODEL_UNAVAILABLE if not given.
    printed: label and neighbouring text of the hunter's value; the mapper's entries then have label and snippet too.
    """
    empty = f"cast(array() as array<{CANDIDATE}>)"
    ceiling = f"if(c.ambiguous or c.iso is null, {AMBIGUOUS}D, if(c.illegible, {BOTH * ILLEGIBLE}D, {BOTH}D))"
    raised = f"named_struct('raw', c.raw, 'iso', c.iso, 'role', if(c.role = 'UNKNOWN', 'EXPIRY', c.role), 'confidence', greatest(c.confidence, {ceiling}), 'ambiguous', c.ambiguous, 'illegible', c.illegible, 'keys', c.keys, 'label', coalesce(nullif(c.label, ''), nullif(p.label, ''), c.label), 'snippet', coalesce(nullif(c.snippet, ''), nullif(p.snippet, ''), c.snippet))"
    alone = f"named_struct('raw', h.said, 'iso', h.read.iso, 'role', 'EXPIRY', 'confidence', if(p.mapper_ok, {AGAINST}D, {ALONE}D), 'ambiguous', h.read.ambiguous, 'illegible', false, 'keys', h.keys, 'label', p.label, 'snippet', p.snippet)"
    found = f"concat(transform(b, (c, i) -> if(at > 0 and i + 1 = at, {raised}, c)), if(h.said is not null and at = 0, array({alone}), {empty}))"
    beside = "(h.said is not null and at = 0)"
    codes = f"""array_distinct(concat(if(p.hunter_ok and p.mapper_ok, cast(array() as array<string>), p.failures), array_compact(array(
        if(p.injected and p.mapper_ok, 'PROMPT_INJECTION_SUSPECTED', null), if(exists(f, c -> c.ambiguous), 'AMBIGUOUS_DATE_FORMAT', null), if({beside} and p.mapper_ok, 'HUNTER_MAPPER_DISAGREE', null),
        if({beside} and not p.mapper_ok, 'LOW_TIER_CONFIDENCE', null), if((p.hunter_ok or p.mapper_ok) and size(f) = 0, if(p.class in ({sql.names(WITHOUT)}), 'NO_EXPIRY_SEMANTICS', 'NO_DATES_FOUND'), null)))))"""
    said = sql.let("said", "if(p.hunter_ok, nullif(trim(p.hunter), ''), null)", sql.let("read", dates.free_text_sql("said", "p.convention", "'EXPIRY'", "p.as_of"), f"named_struct('said', said, 'read', read, 'keys', {keys_sql('said', 'read.iso')})"))
    at = "if(h.said is null, 0, int(array_position(transform(b, c -> arrays_overlap(c.keys, h.keys)), true)))"
    body = sql.let("b", f"if(p.mapper_ok, transform(p.mapper, e -> {mapper_sql('e', printed is not None)}), {empty})", sql.let("h", said, sql.let("at", at, sql.let("f", found, f"named_struct('candidates', f, 'codes', {codes}, 'abstained', size(f) = 0)"))))
    given = F.array(F.lit("MODEL_UNAVAILABLE")) if failures is None else failures
    label, snippet = printed or (F.lit(None).cast("string"), F.lit(None).cast("string"))
    return sql.bind(body, hunter=hunter, hunter_ok=hunter_ok, mapper=mapper, mapper_ok=mapper_ok, injected=injected, convention=convention, as_of=as_of, failures=given, label=label, snippet=snippet, **{"class": document_class})


def agreed(winner_raw: Column, hunter: Column, mapper: Column) -> Column:
    """Whether both calls report the winner (true), the hunter alone (false), or neither says (null); hunter and mapper are arrays of raw values."""
    form = lambda x: F.upper(F.regexp_replace(x, "[^0-9A-Za-z]", ""))
    has = lambda values: F.exists(values, lambda v: form(v) == form(winner_raw))
    return F.when(has(hunter), has(mapper))


def backoff_ms(attempt: Column) -> Column:
    """Wait before the next attempt after a rate limit (fixed value: 500 ms, doubled each time)."""
    return (F.lit(500) * F.pow(F.lit(2.0), attempt)).cast("long")


def attempts(errors: Column, most: int = 2) -> Column:
    """Struct (outcome, waited_ms, tries) of a call that met these errors in turn (null: an answer): rate limits are tried again, all else ends it."""
    step = lambda s, e: F.when(s["outcome"].isNotNull(), s).otherwise(
        F.struct(
            F.when(e.isNull(), "OK").when((e == "rate_limit") & (s["tries"] + 1 < most), F.lit(None).cast("string")).when(e == "rate_limit", "RATE_LIMITED").when(e.isin("timeout", "aborted"), "TIMEOUT").otherwise("MODEL_UNAVAILABLE").alias("outcome"),
            (s["waited_ms"] + F.when((e == "rate_limit") & (s["tries"] + 1 < most), backoff_ms(s["tries"])).otherwise(F.lit(0).cast("long"))).alias("waited_ms"),
            (s["tries"] + 1).alias("tries"),
        )
    )
    start = F.struct(F.lit(None).cast("string").alias("outcome"), F.lit(0).cast("long").alias("waited_ms"), F.lit(0).alias("tries"))
    return F.aggregate(F.slice(errors, 1, most), start, step)


def error_kind(status: Column, name: Column) -> Column:
    """Kind of a failed call by its status and error name."""
    return F.when(status == 429, "rate_limit").when((status == 408) | name.rlike("(?i)timeout"), "timeout").when(name.rlike("(?i)abort"), "aborted").otherwise("unavailable")


def within_budget(spent_usd: Column, call_usd: Column, budget_usd: Column) -> Column:
    """Whether a call may still be made; a missing budget allows all."""
    return F.coalesce(spent_usd + call_usd <= budget_usd, F.lit(True))
