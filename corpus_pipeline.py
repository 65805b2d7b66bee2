"""A corpus pipeline of five stages over `documents`; each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.llm import dartminhash, decontaminate, language, linededup, packing
from veridate.llm.common import drop, read, table

#: No SQL: compression, edit distance, hashing by darts, and tokenisation are outside it; tests hold each stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is clear; those without letters or with a tie between languages go."""
    return language.keep_identified(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat an earlier line; a document of which nothing is left goes.  n_chars follows the text."""
    done = linededup.dedup(docs.withColumnsRenamed(_hidden(docs)))
    cut = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _shown(done.where("not all_removed"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the one with the smallest doc_id."""
    classes = dartminhash.classes(docs)
    # Rows that go, by key; a repeated row (equal in doc_id and text) of which one copy stays has both kinds.
    gone = table(classes.groupBy("key").agg((F.sum(F.col("kept").cast("int")) > 0).alias("once"), F.min("kept").alias("all")).where("not all").select(F.col("key").alias("__key"), "once"))
    own = docs.withColumnsRenamed(_hidden(docs)).withColumn("__key", F.xxhash64("doc_id", "text"))
    kept = _without(own, gone)
    repeated = gone.where("once")
    if repeated.isEmpty():
        return _shown(kept, docs)
    once = own.join(repeated.select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return _shown(kept.unionByName(once.select(kept.columns)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    found = table(decontaminate.matches(docs, read(spark, sf_dir, "benchmark")).select(F.col("key").alias("__key")).distinct())
    own = docs.withColumnsRenamed(_hidden(docs)).withColumn("__key", F.xxhash64("doc_id", "text"))
    return _shown(_without(own, found), docs)


#: Keys of rows to drop up to which they are broadcast to the documents (16 bytes each).
FEW_KEYS = 1_000_000


def _without(own: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of own whose __key is not in gone."""
    keys = gone.select("__key")
    if keys.count() <= FEW_KEYS:
        return own.join(F.broadcast(keys), "__key", "left_anti")
    return own.join(keys, "__key", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def _hidden(docs: DataFrame) -> dict[str, str]:
    """Other names for columns that a stage does not use, so that they clash with none of its own."""
    return {c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "text", "n_chars")}


def _shown(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.withColumnsRenamed({v: k for k, v in _hidden(docs).items()}).select(docs.columns)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, table(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
