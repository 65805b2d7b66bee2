"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units of measure turn into typed
placeholders, other words stay, in lower case.  Windows of `n` template words of
documents and benchmark items meet in a hash join.  The windows that agree along
one alignment of a document with an item then have to fill their slots
consistently: equal values of the item stand against equal values of the document
and different ones against different ones, which holds for copies and for questions
with new numbers or names, and rarely by chance.

A *number* starts with a digit or is a number word, a *unit* is in UNITS, a *name*
is a capitalised word within a sentence, an *opener* one that starts a sentence, where
names and other words look alike.  Windows with fewer than
`literals` words that are not placeholders meet by all their words as they are, so
that verbatim copies are found whatever they are made of.  An item of fewer
than `n` words is one window; items of fewer than `shortest` are left out.

Nulls and edge cases: null texts and texts without words match nothing; a null
doc_id or item_id is a value like any other.  Documents equal in doc_id and text
give one row, as do items equal in item_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import map_batches, table
from veridate.llm.words import CAPITAL, DIGIT, END, Words, batches, mix, words

NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years mph kph hz khz mhz ghz w kw kwh j kj v volt volts amp amps celsius fahrenheit kelvin degree degrees percent dollar dollars cent cents euro euros usd eur"
_U = np.uint64
#: Windows of the benchmark up to which the scan of the documents filters by a list of them; beyond, by a map of BITS bits that their hashes set.
FILTER_LIMIT, BITS = 250_000, 1 << 28


def _hashes(listed: str) -> np.ndarray:
    return np.sort(words([listed]).hash)


def _within(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def template(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Template word and slot value (0 for a word that stays) of every word."""
    number = ((w.flags & DIGIT) > 0) | _within(w.hash, _hashes(NUMBERS))
    unit = ~number & _within(w.hash, _hashes(UNITS))
    name = ~number & ~unit & ((w.flags & CAPITAL) > 0)
    kinds = np.where(number, 1, np.where(unit, 2, np.where(name, np.where((w.flags & END) > 0, 4, 3), 0)))
    return np.where(kinds > 0, mix(kinds.astype(np.uint64)), w.hash), np.where(kinds > 0, w.hash, _U(0))


def _windows(texts: list[str], sizes: list[int], n: int, literals: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the texts, places, hashes, slots and word counts of the windows; sizes under n only with all words of a text, or any of a document."""
    w = words(texts)
    plain, slot = template(w)
    count = np.diff(w.first)
    fixed = np.concatenate([[0], np.cumsum(slot == 0)])
    for size in sizes:
        h, at = w.windows(size, plain)
        rich = fixed[at + size] - fixed[at] >= min(literals, (size + 1) // 2)
        h = mix(np.where(rich, h, ~w.windows(size)[0]) + _U(size))
        doc = w.doc[at]
        yield size, doc, at - w.first[doc], h, slot[at[:, None] + np.arange(size)], count[doc]


def item_windows(items: DataFrame, n: int, literals: int, shortest: int) -> DataFrame:
    """(hash, item_id, item, item_pos, item_words, size, item_slots) of the benchmark's windows."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, keys, texts = part["item_id"], np.array(part["item"], np.int64), part["text"]
            for base, few in batches(texts):
                for size, doc, pos, h, slots, count in _windows(few, list(range(1, n + 1)), n, literals):
                    use = (size == n) | ((count == size) & (size >= shortest))
                    rows = np.flatnonzero(use)
                    if len(rows):
                        yield pd.DataFrame({"hash": h[rows].view(np.int64), "item_id": pd.Series([ids[base + d] for d in doc[rows].tolist()], dtype="object"), "item": keys[base + doc[rows]], "item_pos": pos[rows], "item_words": count[rows], "size": size, "item_slots": list(slots[rows].view(np.int64))})

    own = items.where("text is not null").select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").distinct()
    return map_batches(own, run, f"hash long, item_id {kind}, item long, item_pos int, item_words int, size int, item_slots array<long>")


def _filter(hashes: DataFrame) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The sorted hashes, or where they are too many the words of a map of BITS bits that they set; both are of bounded size."""
    if hashes.count() <= FILTER_LIMIT:
        return np.sort(np.array([r.hash for r in hashes.collect()], np.int64)), None
    place = F.pmod("hash", F.lit(BITS))
    words = hashes.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return None, bits


def matches(docs: DataFrame, items: DataFrame, n: int = 8, literals: int = 4, least: int = 13, shortest: int = 5, verbatim: int = 20) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, exact, key) of each contaminated document and item.

    Contaminated: along one alignment, matching windows cover at least `least`
    words (or the whole of a shorter item) and fill their slots consistently; or
    windows with the same values one after the other cover `verbatim` words,
    whatever the slots elsewhere are.  exact: all slot values are the same.
    key: hash of doc_id and text.
    """
    spark = docs.sparkSession
    bench = table(item_windows(items, n, literals, shortest))
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())
    known = spark.sparkContext.broadcast(_filter(bench.select("hash").distinct()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        wanted, bits = known.value
        for part in parts:
            ids, keys, texts = part["doc_id"], np.array(part["key"], np.int64), part["text"]
            for base, some in batches(texts):
                for _, doc, pos, h, slots, _ in _windows(some, sizes, n, literals):
                    at = h & _U(BITS - 1)
                    rows = np.flatnonzero(_within(h.view(np.int64), wanted) if bits is None else bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1))
                    if len(rows):
                        yield pd.DataFrame({"hash": h[rows].view(np.int64), "doc_id": pd.Series([ids[base + d] for d in doc[rows].tolist()], dtype="object"), "key": keys[base + doc[rows]], "doc_pos": pos[rows], "doc_slots": list(slots[rows].view(np.int64))})

    own = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    found = map_batches(own, scan, f"hash long, doc_id {kind}, key long, doc_pos int, doc_slots array<long>")
    pairs = F.filter(F.arrays_zip("item_slots", "doc_slots"), lambda x: x["item_slots"] != 0)
    met = found.join(bench, "hash").select("doc_id", "key", "item_id", "item", "item_words", "size", "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("shift"), pairs.alias("pairs"))
    same = F.forall("pairs", lambda x: x["item_slots"] == x["doc_slots"])
    runs = met.groupBy("doc_id", "key", "item_id", "item", "item_words", "size", "shift").agg(F.array_sort(F.collect_set("item_pos")).alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.array_sort(F.collect_set(F.when(same, F.col("item_pos")))).alias("same"))
    covered = F.aggregate(F.expr("transform(at, (p, i) -> if(i = 0, size, least(size, p - at[i - 1])))"), F.lit(0), lambda a, x: a + x)
    different = [F.size(F.array_distinct(F.col(f"pairs.{side}"))) for side in ("item_slots", "doc_slots")]
    # Words of the longest stretch of windows that hold the same values, each a word after the one before.
    stretch = F.expr("aggregate(same, named_struct('last', -2, 'now', 0, 'most', 0), (s, p) -> named_struct('last', p, 'now', if(p = s.last + 1, s.now + 1, 1), 'most', greatest(s.most, if(p = s.last + 1, s.now + 1, 1))), s -> if(s.most = 0, 0, s.most + size - 1))")
    consistent = (F.size("pairs") == different[0]) & (F.size("pairs") == different[1]) & (F.col("matched_words") >= F.least(F.lit(least), "item_words"))
    judged = runs.withColumn("matched_words", covered).where(consistent | (stretch >= verbatim))
    exact = F.forall("pairs", lambda x: x["item_slots"] == x["doc_slots"])
    best = judged.groupBy("doc_id", "key", "item_id", "item", "item_words").agg(F.max(F.struct("matched_words", exact.alias("exact"))).alias("best"))
    return best.select("doc_id", "item_id", "best.matched_words", "item_words", "best.exact", "key")
