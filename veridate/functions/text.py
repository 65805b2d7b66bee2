"""Text functions as Columns: label forms, similarity, grounding, scripts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions import sql

#: Letters with marks, and the letters that are left when the marks go.
_PLAIN = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1}
#: What stands where a date would, to say that there is none.
SENTINELS = ["NONE", "N A", "NA", "NIL", "INDEFINITE", "INDEFINITELY", "NON EXPIRING", "NONEXPIRING", "DOES NOT EXPIRE", "NO EXPIRATION", "NO EXPIRY", "PERMANENT", "UNLIMITED"]
#: Ranges of code points of letters that are not Latin: Greek, Cyrillic and its supplement, Armenian, Hebrew, Arabic, Syriac, Arabic supplement,
#: Devanagari, Bengali to Sinhala, Thai, Hangul Jamo, Hiragana and Katakana, CJK extension A, CJK, Hangul syllables.
OTHER_SCRIPTS = [("0370", "03ff"), ("0400", "052f"), ("0530", "058f"), ("0590", "05ff"), ("0600", "06ff"), ("0700", "074f"), ("0750", "077f"), ("0900", "097f"), ("0980", "0dff"), ("0e00", "0e7f"), ("1100", "11ff"), ("3040", "30ff"), ("3400", "4dbf"), ("4e00", "9fff"), ("ac00", "d7af")]


def label_form(text: Column) -> Column:
    """Upper case without accents; runs of anything but letters and digits become one blank."""
    bare = F.translate(F.regexp_replace(text, "[\u0300-\u036f]", ""), "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.trim(F.regexp_replace(F.upper(bare), "[^A-Z0-9]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def is_sentinel(text: Column) -> Column:
    return label_form(text).isin(SENTINELS)


def same_value(a: Column, b: Column) -> Column:
    """Equality that ignores case and anything but letters and digits."""
    form = lambda c: F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return form(a) == form(b)


def grounded(raw: Column, page: Column) -> Column:
    """Whether the digits of a value stand among the digits of the page; never for a value without digits."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return (digits(raw) != "") & F.contains(digits(page), digits(raw))


def latin_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z\u00c0-\u024f]", ""))


def other_letters(text: Column) -> Column:
    """Letters of scripts other than Latin, by OTHER_SCRIPTS."""
    return F.length(F.regexp_replace(text, "[^" + "".join(rf"\u{a}-\u{b}" for a, b in OTHER_SCRIPTS) + "]", ""))


def unsupported_script(latin: Column, other: Column) -> Column:
    """At least three letters, of which three in ten are of other scripts."""
    return (latin + other >= 3) & (other / F.greatest(latin + other, F.lit(1)) >= 0.3)


def non_latin_dominant(text: Column) -> Column:
    """Whether three in ten characters from 0 on in the code table, without those between Latin and Greek, are beyond Latin."""
    other = F.length(F.regexp_replace(text, r"[\x{0000}-\x{036f}]", ""))
    latin = F.length(F.regexp_replace(text, "[^0-\u024f]", ""))
    return (latin + other > 0) & (other / F.greatest(latin + other, F.lit(1)) >= 0.3)


def join_sql(words: str) -> str:
    """join_words() as SQL text."""
    return f"""aggregate({words}, '', (a, v) -> case when a = '' then v when a rlike {sql.text("[/.–—-]$")} or v rlike {sql.text("^[/.–—-]")} then concat(a, v) else concat(a, ' ', v) end)"""


def join_words(words: Column) -> Column:
    """Words of a line as one text; no blank where a word ends or begins with a mark that joins dates."""
    return sql.bind(join_sql("p.words"), words=words)


def client_ip(forwarded: Column, real: Column) -> Column:
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(real), F.lit("")), F.lit("unknown"))
