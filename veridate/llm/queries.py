"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridate.llm import dartminhash, decontaminate, gnat, language, linededup, neighbours, packing, quality, runs, secrets, simhash, simple8b, suffixes
from veridate.llm.common import id_remainder, read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, as it is or with other numbers and names."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; four fifths of the ids teach, the rest are held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(id_remainder(F.col("doc_id"), 5) != 0))
    return quality.score(docs, model).withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of fifty words or more that another document has."""
    return suffixes.repeats(read(spark, sf_dir, "documents"))


def op4_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five-word windows, similarity of 0.8 or more."""
    return dartminhash.classes(read(spark, sf_dir, "documents")).drop("key")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by pattern and by inferred format."""
    return secrets.find(read(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; two thirds of the ids teach, the rest are held out."""
    docs = read(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held))
    return language.identify(docs, model).withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum as read back from Simple-8b token files."""
    return simple8b.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line within two edits."""
    return linededup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which get one by their id, and checksums of what is left without them."""
    return runs.digests(runs.find(runs.planted(read(spark, sf_dir, "documents"))))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: three-word shingles, at most three differing bits."""
    return simhash.shown(simhash.components(read(spark, sf_dir, "documents")))


def op13_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in sixteen parts with 64 entries, and their errors."""
    return gnat.digests(gnat.compress(read(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_suffixes": op3_suffixes,
    "op4_dartminhash": op4_dartminhash,
    "op5_secrets": op5_secrets,
    "op6_neighbours": op6_neighbours,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_simhash": op12_simhash,
    "op13_gnat_codes": op13_gnat_codes,
}

_NEAREST = """a{i} as materialized (  -- each part's nearest entry: its squared distance and index in one number
    select x.row, x.p, min(64 * ((x.c1 - b.c1) ** 2 + (x.c2 - b.c2) ** 2 + (x.c3 - b.c3) ** 2 + (x.c4 - b.c4) ** 2)::bigint + b.e) as m
    from parts x join b{i} b on x.p = b.p group by x.row, x.p)"""
_ROUND = """s{i} as (
    select x.p, a.m % 64 as e, count(*)::bigint as n, sum(c1)::bigint as s1, sum(c2)::bigint as s2, sum(c3)::bigint as s3, sum(c4)::bigint as s4
    from parts x join a{i} a on x.row = a.row and x.p = a.p group by x.p, a.m % 64),
b{j} as materialized (
    select b.p, b.e, coalesce((s1 - (s1 % n + n) % n) // n, c1) as c1, coalesce((s2 - (s2 % n + n) % n) // n, c2) as c2,
        coalesce((s3 - (s3 % n + n) % n) // n, c3) as c3, coalesce((s4 - (s4 % n + n) % n) // n, c4) as c4
    from b{i} b left join s{i} s on b.p = s.p and b.e = s.e)"""
_CODES = """
with kept as (
    select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v, row_number() over (order by vec_id) - 1 as row
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (
    select row, p, v[4 * p + 1] as c1, v[4 * p + 2] as c2, v[4 * p + 3] as c3, v[4 * p + 4] as c4 from kept, (select unnest(range(16)) as p)),
b0 as materialized (select p, row as e, c1, c2, c3, c4 from parts where row < 64),
""" + ",\n".join([_NEAREST.format(i=0), _ROUND.format(i=0, j=1), _NEAREST.format(i=1), _ROUND.format(i=1, j=2), _NEAREST.format(i=2)]) + """,
coded as (select row, string_agg(printf('%02x', m % 64), '' order by p) as code, sum(m // 64)::bigint as error from a2 group by row),
name as (select sha256(string_agg(concat_ws(',', c1, c2, c3, c4), ',' order by p, e)) as codebooks_sha256 from b2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join coded on kept.row = coded.row, name
"""

#: DuckDB SQL for the queries that SQL can express, over vectors of 64 components.
ORACLES: dict[str, str] = {"op13_gnat_codes": _CODES}
