"""Quality and cost figures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)


def by_group(verdicts: DataFrame, group: str) -> DataFrame:
    """Documents, share, mean confidence and review rate of each group; sums run over whole ten-thousandths, so that order does not matter."""
    sums = verdicts.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.round(F.col("confidence") * 10000).cast("long")).alias("points"), F.count_if(F.col("decision") == "REVIEW").alias("reviews"))
    total = F.sum("documents").over(Window.partitionBy())
    return sums.select(group, "documents", F.round(F.col("documents") / total, 6).alias("share"), F.round(F.col("points") / 10000.0 / F.col("documents"), 6).alias("mean_confidence"), F.round(F.col("reviews") / F.col("documents"), 6).alias("review_rate"))


def accuracy_at_coverage(results: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Coverage, accuracy (1 where nothing is answered) and confident errors at each threshold, from (confidence, correct); one pass, each row adds to the thresholds it reaches."""
    sums = results.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("confidence") >= t).alias(f"a{i}") for i, t in enumerate(thresholds)), *(F.count_if((F.col("confidence") >= t) & F.col("correct")).alias(f"c{i}") for i, t in enumerate(thresholds)))
    points = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"a{i}").alias("answered"), F.col(f"c{i}").alias("right")) for i, t in enumerate(thresholds))))
    p = sums.select("n", points.alias("p")).select("n", "p.*")
    return p.select("threshold", "answered", F.round(F.when(F.col("n") > 0, F.col("answered") / F.col("n")).otherwise(0.0), 6).alias("coverage"), F.round(F.when(F.col("answered") > 0, F.col("right") / F.col("answered")).otherwise(1.0), 6).alias("accuracy"), (F.col("answered") - F.col("right")).alias("confident_wrong"))


def point_at_coverage(curve: DataFrame, target: float = 0.8) -> DataFrame:
    """The highest threshold that still covers the target."""
    return curve.where(F.col("coverage") >= target).agg(F.max_by(F.struct(*curve.columns), "threshold").alias("p")).where("p is not null").select("p.*")


def cost_usd(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column, in_price: Column, out_price: Column) -> Column:
    """Dollars from token counts and prices a million tokens; writes to a cache cost 1.25 times, reads a tenth; a missing count is none."""
    n = [F.coalesce(x, F.lit(0)) for x in (input_tokens, output_tokens, cache_write, cache_read)]
    return (n[0] * in_price + n[1] * out_price + n[2] * in_price * 1.25 + n[3] * in_price * 0.1) / 1e6
