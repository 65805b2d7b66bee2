"""Periodic runs of words by internal pattern matching, and texts without their repetitions.

A *word* is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``.  A
*run* is a stretch of words with smallest period q (words q apart are equal), at least
``times`` periods and ``least`` words long, that no neighbouring word extends.

Documents of a batch are laid end to end without common words.  Doubling names every
block of 1, 2, 4, ... words by the place of its class in suffix order.  A run of period
q, with m <= q < 2m for a power m of two, holds a block of m words at one of the places
that `_progressions` looks at, and that block occurs again q words later.  The window
of such places is shorter than two blocks, so that the block's occurrences there are
an arithmetic progression: first and last come from range successor queries in a
wavelet tree over the suffix array, and every member is a candidate period, which
longest common extensions both ways turn into a run or discard.  Only a task's batches
are in memory; nothing is shuffled.

Nulls and edge cases: a null or empty text, or one without words, has no run and
collapses to an empty text.  Repeated rows give repeated rows; an id may be null.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import map_batches
from veridate.llm.words import batches

#: Candidates whose extensions are compared at a time.
CANDIDATES = 1 << 18


class Wavelet:
    """Wavelet tree over whole numbers below 2**bits, in matrix form; queries are arrays."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(bits)):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(values) - int(before[-1])))
            up = ones.astype(bool)
            values = np.concatenate([values[~up], values[up]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places low..high-1 are under x."""
        count = np.zeros(len(x), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[low], before[high]
            up = ((x >> bit) & 1).astype(bool)
            count += np.where(up, (high - low) - (b - a), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value, from 0, in places low..high-1; after `below` the successor of a value."""
        found = np.zeros(len(n), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[low], before[high]
            fewer = (high - low) - (b - a)
            up = n >= fewer
            n = np.where(up, n - fewer, n)
            found |= up.astype(np.int64) << bit
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return found


def suffix_classes(ids: np.ndarray, ends: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For blocks of 1, 2, 4, ... words up to `most`, the first place of each position's class in suffix order; and the positions in that order.

    ids: word numbers.  ends: where the document of each position ends.  A block that passes its document's end is a class of its own.
    """
    n = len(ids)
    order = np.argsort(ids)
    ranked = ids[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    found, step = [rank], 1
    while step * 2 <= most:
        live = np.flatnonzero(np.bincount(rank, minlength=n)[rank[order]] > 1)
        if not len(live):
            break
        at = order[live]
        after = at + step
        key = rank[at] * (n + 1) + np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        order[live] = at
        rank = rank.copy()
        rank[at] = live[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        found.append(rank)
        step *= 2
    return found, order


def _progressions(classes: list[np.ndarray], order: np.ndarray, ends: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block start, first candidate period, step between candidates, how many) of the blocks that occur again in their window."""
    n, tree = len(order), None
    for level, rank in enumerate(classes):
        m = 1 << level
        at = np.arange(0, n, 2 * m if times > 3 else m)
        size = np.bincount(rank, minlength=n)
        at = at[(size[rank[at]] >= times - 1) & (at + 2 * m <= n)]
        at = at[rank[at + 1] == rank[at]] if m == 1 else at  # the window of one word is one place
        if not len(at):
            continue
        if m == 1:
            yield at, np.ones(len(at), np.int64), np.ones(len(at), np.int64), np.ones(len(at), np.int64)
            continue
        tree = tree or Wavelet(order, n.bit_length())
        low = rank[at]
        high = low + size[low]
        under, upto = tree.below(low, high, at + m), tree.below(low, high, np.minimum(at + 2 * m, n))
        some = np.flatnonzero(upto > under)
        if len(some):
            at, low, high, under, upto = at[some], low[some], high[some], under[some], upto[some]
            first, last, count = tree.nth(low, high, under), tree.nth(low, high, upto - 1), upto - under
            yield at, first - at, (last - first) // np.maximum(count - 1, 1), count


def _agreement(classes: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many words from x and y on agree, or before them if back; x < y.  classes end with a place that equals no other."""
    far = np.zeros(len(x), np.int64)
    for level in reversed(range(len(classes))):
        m, rank = 1 << level, classes[level]
        while True:
            if back:
                same = (x - far >= m) & (rank[x - far - m] == rank[y - far - m])
            else:
                same = rank[x + far] == rank[y + far]
            far += m * same
            if level < len(classes) - 1 or not same.any():
                break
    return far


def find_runs(ids: np.ndarray, starts: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period, in texts laid end to end; starts: of the texts, and one more entry. No two texts share an id."""
    none = np.zeros(0, np.int64)
    if times < 3:
        raise ValueError("a run has three periods at least")
    if len(ids) < least:
        return none, none, none
    ends = np.repeat(starts[1:], np.diff(starts))
    classes, order = suffix_classes(ids, ends, max(1, int(np.diff(starts).max()) // times))
    padded = [np.append(c, -1) for c in classes]
    found = []
    for at, first, step, count in _progressions(classes, order, ends, times):
        upto = np.cumsum(count)
        for lo in range(0, int(upto[-1]), CANDIDATES):
            j = np.arange(lo, min(lo + CANDIDATES, int(upto[-1])))
            own = np.searchsorted(upto, j, "right")
            b, q = at[own], first[own] + step[own] * (j - (upto - count)[own])
            start, end = b - _agreement(padded, b, b + q, True), b + q + _agreement(padded, b, b + q, False)
            keep = end - start >= np.maximum(least, times * q)
            found.append(np.stack([start[keep], end[keep], q[keep]]))
    if not found:
        return none, none, none
    start, end, q = np.concatenate(found, axis=1)
    by = np.lexsort((q, end, start))  # of periods with one extent the smallest divides the others
    start, end, q = start[by], end[by], q[by]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(by) else np.zeros(0, bool)
    start, end, q = start[new], end[new], q[new]
    by = np.lexsort((q, start))
    return start[by], end[by], q[by]


def runs_of(texts: list[str | None], least: int, times: int) -> tuple[list[list[dict]], list[str]]:
    """Runs of each text, and its words outside repeated periods, joined by a space."""
    spoken = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at ASCII white space alone
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in spoken], out=starts[1:])
    ids, known = np.empty(starts[-1], np.int64), 0
    for s, lo, hi in zip(spoken, starts, starts[1:]):
        seen: dict[bytes, int] = {}
        ids[lo:hi] = [seen.setdefault(word, len(seen)) for word in s]
        ids[lo:hi] += known
        known += len(seen)
    start, end, period = find_runs(ids, starts, least, times)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge)[:-1] == 0
    doc = np.searchsorted(starts, start, "right") - 1
    found: list[list[dict]] = [[] for _ in texts]
    for d, s, e, q in zip(doc.tolist(), (start - starts[doc]).tolist(), (end - starts[doc]).tolist(), period.tolist()):
        found[d].append({"start": s, "length": e - s, "period": q})
    left = [s if not f else [w for w, keep in zip(s, kept[lo:hi].tolist()) if keep] for s, f, lo, hi in zip(spoken, found, starts, starts[1:])]
    return found, [b" ".join(s).decode("utf-8", "surrogatepass") for s in left]


def find(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed) of each document: runs array of (start, length, period) in words, by start and period; collapsed: its words without those that repeat earlier periods of a run."""

    def work(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for base, texts in batches([t or "" for t in part["text"]]):
                found, left = runs_of(texts, least, times)
                yield pd.DataFrame({"doc_id": pd.Series(part["doc_id"][base : base + len(texts)], dtype=object), "runs": found, "collapsed": left})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the crc32 of the id makes every tenth text periodic from some word on; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("__g"), F.when(h % 10 == 0, words).alias("__words")).withColumn("__n", F.size("__words"))
    some = some.withColumn("__a", F.expr("if(__n > 0, __g % __n, null)")).withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    again = F.expr("concat_ws(' ', transform(__words, (w, i) -> if(i < __a, w, __words[cast(__a + (i - __a) % __p as int)])))")
    return some.select("doc_id", F.when(F.col("__a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Figures of find()'s rows: number of runs, the run with most periods, and checksums of all runs and of the collapsed text."""
    better = "(b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b)"  # by start and period: the first of equals stays
    best = found.withColumn("best", F.expr(f"aggregate(runs, cast(null as struct<start:long,length:long,period:long>), {better})"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr(r"sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
