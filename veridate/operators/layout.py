"""Where a value belongs beside a printed label, as a spatial join.

Boxes are structs (x0, y0, x1, y1); distances count label text heights, so that
they mean the same at any resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridate.functions import sql

#: Reach to the right and below, least line overlap, left alignment.
RIGHT, BELOW, OVERLAP, ALIGN = 12.0, 2.5, 0.35, 2.0


def height(box: Column) -> Column:
    return F.greatest(box["y1"] - box["y0"], F.lit(1.0))


def vertical_overlap(a: Column, b: Column) -> Column:
    shared = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    return shared / F.least(height(a), height(b))


def height_sql(box: str) -> str:
    return f"greatest({box}.y1 - {box}.y0, 1.0D)"


def across_sql(a: str, b: str) -> str:
    """Whether box b lies below box a as far as its sides go."""
    return f"({b}.x0 <= {a}.x1 and {b}.x1 >= {a}.x0 or abs({b}.x0 - {a}.x0) <= {ALIGN}D * {height_sql(a)})"


def place_sql(label: str, value: str) -> str:
    """place() as SQL text."""
    h = height_sql(label)
    gap = lambda axis: f"greatest({value}.{axis}0 - {label}.{axis}1, 0.0D) / {h}"
    overlap = f"greatest(least({label}.y1, {value}.y1) - greatest({label}.y0, {value}.y0), 0.0D) / least({h}, {height_sql(value)})"
    beside = f"{overlap} >= {OVERLAP}D and {value}.x0 >= {label}.x1 - 0.25D * {h} and {gap('x')} <= {RIGHT}D"
    under = f"{value}.y0 >= {label}.y1 - 0.25D * {h} and {across_sql(label, value)} and {gap('y')} <= {BELOW}D"
    option = lambda ok, distance, i, name, bound: f"if({ok}, named_struct('distance', {distance}, 'relation_ord', {i}, 'relation', '{name}', 'bound', {bound}D), null)"
    return f"array_min(array_compact(array({option(beside, gap('x'), 0, 'RIGHT', RIGHT)}, {option(under, gap('y'), 1, 'BELOW', BELOW)})))"


def place(label: Column, value: Column) -> Column:
    """Struct (distance, relation_ord, relation, bound) of the nearer admissible placement, right first on a tie; null if there is none."""
    return sql.bind(place_sql("p.label", "p.value"), label=label, value=value)


def bind(labels: DataFrame, values: DataFrame) -> DataFrame:
    """The nearest admissible value of each label: labels (doc_id, label_ord, label), values (doc_id, value_ord, value, confidence). The join is an equi-join on doc_id."""
    met = labels.join(values, "doc_id").withColumn("p", place(F.col("label"), F.col("value"))).where("p is not null")
    nearest = Window.partitionBy("doc_id", "label_ord").orderBy(F.col("p.distance") / F.col("p.bound"), F.col("confidence").desc(), "value_ord")
    return met.withColumn("n", F.row_number().over(nearest)).where("n = 1").select("doc_id", "label_ord", "value_ord", "p.relation", "p.distance")
