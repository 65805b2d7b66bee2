"""Answers held against expectations, and the figures by which the engine judges itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes that should never have been sent, and minutes of work a day over documents a reviewer does in it.
ADVERSARIAL, DAY_MINUTES, SLOW, FAST = ["NOT_A_DOCUMENT", "OTHER_DOCUMENT"], 480, 20, 30


def is_adversarial(expected_class: Column) -> Column:
    return expected_class.isin(ADVERSARIAL)


def score(outcomes: DataFrame) -> DataFrame:
    """Adds committed, correct and miss to rows (expected_verdict, expected_basis, expected_date, decision, basis, date, verdict).

    A degraded document is right when it is left to a person; without an expected date neither date nor another basis may be given.
    """
    c = F.col
    committed = c("decision") != "REVIEW"
    basis, date, verdict = c("basis") == c("expected_basis"), c("date").eqNullSafe(c("expected_date")), c("verdict") == c("expected_verdict")
    correct = F.when(c("expected_verdict") == "INDETERMINATE", ~committed).when(c("expected_date").isNull(), c("date").isNull() & basis).otherwise(date & basis & verdict)
    wrong = F.concat_ws(";", F.when(~date, "date"), F.when(~basis, "basis"), F.when(~verdict & c("expected_date").isNotNull(), "verdict"))
    miss = F.when(c("expected_verdict") == "INDETERMINATE", "committed").otherwise(wrong)
    return outcomes.withColumns({"committed": committed, "correct": correct}).withColumn("miss", F.when(~F.col("correct"), miss))


def summary(scored: DataFrame) -> DataFrame:
    """One row of counts over scored rows with expected_class, decision and cost_usd (ten-thousandths, so that order does not matter)."""
    adversarial, rejected = is_adversarial(F.col("expected_class")), F.col("decision") == "REJECTED"
    n = lambda condition: F.count_if(condition)
    sums = scored.agg(
        F.count(F.lit(1)).alias("documents"), n(F.col("correct")).alias("correct"), n(F.col("committed")).alias("answered"), n(F.col("committed") & F.col("correct")).alias("right"),
        n(F.col("committed") & ~F.col("correct")).alias("confidently_wrong"), n(adversarial).alias("adversarial"), n(adversarial & rejected).alias("turned_away"), n(adversarial & (F.col("cost") == 0)).alias("contained"),
        n(~adversarial & rejected).alias("false_rejects"), F.sum("cost").alias("cost"),
    )
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    minutes = lambda per_day: F.round(F.col("turned_away") * DAY_MINUTES / F.lit(float(per_day)), 4)
    return sums.select("documents", share("answered", "documents").alias("coverage"), share("right", "answered").alias("accuracy"), share("correct", "documents").alias("overall"), "confidently_wrong", "adversarial", "turned_away", "contained", "false_rejects", F.round(F.col("cost") / 10000.0, 4).alias("usd"), minutes(FAST).alias("minutes_low"), minutes(SLOW).alias("minutes_high"))


def by_tier(scored: DataFrame) -> DataFrame:
    """Documents, share, mean latency and mean cost of each tier, largest first by tier_rank."""
    sums = scored.groupBy("tier").agg(F.count(F.lit(1)).alias("documents"), F.sum("ms").alias("ms"), F.sum("cost").alias("cost"))
    # A row for each of five tiers.
    return sums.select("tier", "documents", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 6).alias("share"), F.round(F.col("ms") / F.col("documents"), 4).alias("mean_ms"), F.round(F.col("cost") / 10000.0 / F.col("documents"), 6).alias("mean_usd"), F.row_number().over(Window.orderBy(F.col("documents").desc(), "tier")).alias("tier_rank"))


def minutes_to_dollars(minutes: Column, hourly: Column) -> Column:
    return F.round(minutes / 60 * hourly, 4)
