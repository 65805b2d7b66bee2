"""Union of what several readers found, by authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_authority(candidates: DataFrame) -> DataFrame:
    """One row for each date (or raw text) and role of a document: the first by tier_rank, then cand_ord; `readers` counts the tiers that agree."""
    same = ["doc_id", F.coalesce(F.col("iso").cast("string"), F.col("raw")), "role"]
    first = Window.partitionBy(*same).orderBy("tier_rank", "cand_ord")
    whole = Window.partitionBy(*same)
    return candidates.withColumn("n", F.row_number().over(first)).withColumn("readers", F.size(F.collect_set("tier_rank").over(whole))).where("n = 1").drop("n")


def issuer_convention(issuer: Column, document_class: Column) -> Column:
    """US, DMY or null, from the issuer's name or else the class."""
    up = F.upper(issuer)
    named = F.when((up == "USA") | issuer.rlike("^[A-Z]{2}$") | up.rlike(r"\bUNITED STATES\b"), "US").when((F.length(up) <= 60) & up.rlike("[A-Z]"), "DMY")
    return F.coalesce(named, F.when(document_class.isin("NON_US_DRIVERS_LICENSE", "NATIONAL_ID_CARD"), "DMY"))
