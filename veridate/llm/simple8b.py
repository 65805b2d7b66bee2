"""Word-aligned integer coding of token ids, and the token files made of it.

Format of one coded run of ids (little endian)::

    magic "S8T1" | ids: u32 | ids a block: u32 | blocks: u32
    word offset of each block: u32 * (blocks + 1), padded to a multiple of 8 bytes
    words: u64 * last offset
    escaped ids: u64 *

A word holds a 4-bit selector in its top bits and 60 bits of ids, lowest first.
Selector 0 is an escape for an id of over 60 bits: its word holds the id's place
among the escaped ones.  Any block can be decoded alone through its offset, and
all words of one selector decode together in whole-array operations.

Token files are Parquet rows of such runs (``spark.write.parquet``: any store that
Spark reaches, committed task by task), each a group of whole documents in
ascending order of doc_id, with their ids and lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridate.llm.common import map_batches, scratch
from veridate.llm.tokens import encoder

#: (ids a word, bits an id) of selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 1024
_MAGIC = b"S8T1"


def _takes(ids: np.ndarray, block: int) -> np.ndarray:
    """At each position the selector that packs most of the ids that follow in its block, 0 where only the escape can."""
    n = len(ids)
    best = np.zeros(n, np.int8)
    at = np.arange(n)
    room = (np.minimum((at // block + 1) * block, n) - at).astype(np.int32)
    for s in range(len(SELECTORS), 0, -1):  # the fullest fitting word is set last
        count, bits = SELECTORS[s - 1]
        fits = ids < np.uint64(1 << bits)  # whether the next 1, 2, 4, ... and at last `count` ids fit
        span = 1
        while span < count and fits.any():
            step = min(span, count - span)
            fits[:-step] &= fits[step:]
            span += step
        fits &= room >= count
        best[fits] = s
    return best


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Code a run of non-negative ids (up to 64 bits each)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    counts = [1, *(c for c, _ in SELECTORS)]
    best = _takes(ids, block)
    steps, chain, i = best.tolist(), [], 0
    while i < len(steps):
        chain.append(i)
        i += counts[steps[i]]
    first = np.array(chain, np.int64)
    chosen = best[first].astype(np.int64)
    words = np.zeros(len(first), np.uint64)
    escaped = ids[first[chosen == 0]]
    words[chosen == 0] = np.arange(len(escaped), dtype=np.uint64)
    for s in np.unique(chosen[chosen > 0]).tolist():
        count, bits = SELECTORS[s - 1]
        shifts = (np.arange(count) * bits).astype(np.uint64)
        words[chosen == s] = np.bitwise_or.reduce(ids[first[chosen == s][:, None] + np.arange(count)] << shifts, axis=1) | np.uint64(s << 60)
    offsets = np.append(np.searchsorted(first, np.arange(0, len(ids), block)), len(words))
    head = _MAGIC + struct.pack("<III", len(ids), block, len(offsets) - 1) + offsets.astype("<u4").tobytes()
    return head + b"\0" * (-len(head) % 8) + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()


def decode(data: bytes, blocks: tuple[int, int] | None = None) -> np.ndarray:
    """The ids, or those of blocks [first, last) only."""
    if data[:4] != _MAGIC:
        raise ValueError("not a coded run of ids")
    _, _, many = struct.unpack_from("<III", data, 4)
    offsets = np.frombuffer(data, "<u4", many + 1, 16).astype(np.int64)
    body = 16 + 4 * (many + 1)
    body += -body % 8
    lo, hi = blocks or (0, many)
    words = np.frombuffer(data, "<u8", int(offsets[hi] - offsets[lo]), body + 8 * int(offsets[lo])).astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.array([1, *(c for c, _ in SELECTORS)])[selector])]).astype(np.int64)
    ids = np.zeros(int(at[-1]), np.uint64)
    for s in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == s)
        if s == 0:
            ids[at[rows]] = np.frombuffer(data, "<u8", offset=body + 8 * int(offsets[-1]))[words[rows].astype(np.int64)]
            continue
        count, bits = SELECTORS[s - 1]
        ids[at[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> (np.arange(count) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, group_ids: int = 1 << 17) -> None:
    """Token files of docs (doc_id, text) in ascending doc_id order under `path`.

    Rows: shard (files follow each other by it), shard_start (ids of the shard
    before the row), doc_ids, lengths (ids of each document, end id included), data.
    A null text counts as empty; null ids come first; rows of one doc_id are
    ordered by text.  A document is never split between rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, "bytes")
        before = 0
        for part in parts:
            texts = part["text"]
            size = np.array([len(t) + 1 for t in texts])
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(size) // (4 * group_ids))) + 1):
                ids, at = enc.encode([texts[i] for i in rows])
                ends = np.insert(ids, at[1:], end_id)
                lengths = np.diff(at) + 1
                own = [part["doc_id"][i] for i in rows]
                yield pd.DataFrame({"shard": [part["shard"][0]], "shard_start": [before], "doc_ids": [own], "lengths": [lengths.tolist()], "data": [encode(ends)]})
                before += len(ends)

    map_batches(ordered, run, f"shard int, shard_start long, doc_ids array<{kind}>, lengths array<long>, data binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # One row for each shard, of which there are as many as shuffle partitions.
    ends = files.groupBy("shard").agg(F.max(F.col("shard_start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    bases = ends.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start, doc_ids, lengths, data in zip(part["start"], part["doc_ids"], part["lengths"], part["data"], strict=True):
                raw = decode(data).astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.Series(doc_ids, dtype="object"), "start": start + at[:-1], "n_tokens": lengths, "ids_crc32": crc})

    rows = files.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "doc_ids", "lengths", "data")
    return map_batches(rows, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the token files to the shared folder and read the documents back from them."""
    path = scratch(docs.sparkSession)
    write(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
