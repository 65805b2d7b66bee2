"""Expressions as SQL text over bound values.

Spark parses such a text in one step; built Column by Column the same tree takes
thousands of calls from Python, seconds before a job even starts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(body: str, **values: Column) -> Column:
    """The value of body, SQL text over p.<name>, with each value computed once."""
    row = F.struct(*(v.alias(n) for n, v in values.items()))
    return F.call_function("transform", F.array(row), F.expr(f"p -> {body}"))[0]


def let(name: str, value: str, body: str) -> str:
    """SQL of body with `value` computed once and named, where a deep expression would repeat it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def text(value: str) -> str:
    """A string literal without escapes."""
    return "r'" + value + "'" if "'" not in value else 'r"' + value + '"'


def names(values: list[str]) -> str:
    return ", ".join(map(text, values))
