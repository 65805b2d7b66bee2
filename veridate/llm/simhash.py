"""Near-duplicates by SimHash: fingerprints, a table of distances to reference fingerprints, and components.

Bit i of a fingerprint is 1 if bit i is set in more than half of the hashes (XXH64) of
a text's shingles.  Two fingerprints link if at most `RADIUS` bits differ.

Equal fingerprints are one row before anything meets.  For each the Hamming distances
to `REFERENCES` fixed fingerprints are computed once and packed, seven to a number: the
pivot table.  By the triangle inequality two fingerprints that link differ by at most
RADIUS in every coordinate, so that a pair with a larger difference is discarded; one
addition and one subtraction compare seven coordinates.  Survivors are verified by
counting the bits that differ.

Distances to one reference lie close around 32 and discard only half of all pairs, so
that the table alone would have to look at every pair.  Pairs therefore meet where they
can link at all: of six blocks of bits three at least are equal.  Keys that many
fingerprints share are led, split by three of six parts of the other bits, and dealt
in blocks (`links.link`), so that no key ends in one task and none is skipped.

Nulls and edge cases: a null or empty text, or one without words, has fingerprint zero
and links like any other.  Fewer words than a shingle has are one shingle.  Repeated
rows each get their component; a row without an id links but names no component (null
if its component has no id).  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridate.llm import links
from veridate.llm.common import drop, map_batches, table

SEED, RADIUS = 42, 3
#: Reference fingerprints, and how many of their distances (a byte each) go into one number, whose top byte stays free.
REFERENCES, PACKED = 21, 7
#: Pairs between components for each member, up to which all of a key's pairs are compared at once.
PAIRS_A_MEMBER = 64
#: Hashes of a text whose bits are counted at a time.
COUNTED = 1 << 16


def references(n: int = REFERENCES) -> list[int]:
    """Fixed fingerprints, as signed numbers."""
    return [int(x) for x in np.array([xxhash.xxh64_intdigest(f"reference {i}", 7) for i in range(n)], np.uint64).view(np.int64)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Fingerprint of a text as an unsigned number."""
    spoken = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not spoken:
        return 0
    n, line = min(words, len(spoken)), b" ".join(spoken)
    ends = list(accumulate(len(w) + 1 for w in spoken))
    starts = [0, *ends[: len(spoken) - n]]
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for lo in range(0, count, COUNTED):
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[lo : lo + COUNTED], ends[lo + n - 1 :])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of each document, fp as a signed number."""

    def work(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = np.array([fingerprint(t, words) for t in part["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pd.Series(part["doc_id"], dtype=object), "fp": found})

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(bits: list[int], blocks: int = 6) -> list[int]:
    """Masks of half of the blocks that `bits` are cut into, every choice: values that differ in RADIUS of the bits at most agree under one."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - RADIUS)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """(id, sketch): each fingerprint with its packed distances to all references."""
    refs = references()
    far = lambda r: F.bit_count(F.col("id").bitwiseXOR(F.lit(r)))
    packs = [refs[i : i + PACKED] for i in range(0, len(refs), PACKED)]
    packed = [sum((F.shiftleft(far(r).cast("long"), 8 * i) for i, r in enumerate(pack)), F.lit(0).cast("long")) for pack in packs]
    return fps.select("id", F.struct(*(p.alias(f"p{i}") for i, p in enumerate(packed))).alias("sketch"))


def near_in_table(x: Column, y: Column) -> Column:
    """Whether no coordinate of two rows of the pivot table differs by more than RADIUS."""
    ones = sum(1 << 8 * i for i in range(PACKED))
    rise, tops = F.lit(ones * (128 + RADIUS)), F.lit(ones * 128)  # a byte keeps its top bit unless the other is larger by more than RADIUS
    held = F.lit(True)
    for i in range(-(-REFERENCES // PACKED)):
        a, b = x.getField(f"p{i}"), y.getField(f"p{i}")
        held = held & ((a + rise - b).bitwiseAND(b + rise - a).bitwiseAND(tops) == tops)
    return held


def _keyed(rows: DataFrame, masks: list[int], fine: bool = False) -> DataFrame:
    """(key, id, sketch): a row for each mask, or for each two of a mask and a part of the bits it leaves out."""
    under = lambda m: F.col("id").bitwiseAND(F.lit(_signed(m)))
    out = rows.select("id", "sketch", F.explode(F.array(*(F.xxhash64(F.lit(i), under(m)) for i, m in enumerate(masks)))).alias("key"))
    return out.select("key", "id", "sketch")


def linked(fps: DataFrame) -> DataFrame:
    """(id, component) of all distinct fingerprints (id) that link to another; component: the smallest linked fingerprint."""
    bits = list(range(64))
    masks = block_masks(bits)
    finer = [m | f for m in masks for f in block_masks([b for b in bits if not m >> b & 1])]
    rows = table(pivot_table(fps))
    members = table(links.repeated(_keyed(rows, masks)))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)

    def split(ids: DataFrame) -> DataFrame:
        return _keyed(rows.join(ids, "id", "left_semi"), finer)

    found = links.link(members, verify, split, near_in_table, lambda m: verify(links.sketched(m, near_in_table)), PAIRS_A_MEMBER, weight=F.lit(1.0))
    drop(members, rows)
    return found


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of each document; component_id: smallest doc_id that links reach, its own included."""
    prints = table(fingerprints(docs, words))
    fps = table(prints.groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    named = linked(fps.select("id"))
    roots = fps.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = roots.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    small = table(roots.select("id", "component").join(least, "component").select(F.col("id").alias("fp"), "component_id"))
    return prints.join(small, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def shown(found: DataFrame) -> DataFrame:
    """components()'s rows with the fingerprint as 16 hexadecimal digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
