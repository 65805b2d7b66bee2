"""All queries of the validity engine, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridate.plans import evaluation, evidence, intake, ladder, orders, pages, rasters, readings, signals, streams

FLAGSHIP = "verdict_per_order"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _plan in (orders, readings, signals, evidence, pages, evaluation, streams, ladder, rasters, intake):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
