"""Passages that repeat across documents, found with a sparse suffix array.

Of each text only the suffixes at minimiser positions are kept: words at which a
window of `SPAN` successive word k-grams has its smallest hash.  Any passage of
`least` words holds such a position, chosen by its content alone, so that its copies
choose the same one.  Suffixes whose first k words occur in several texts are
grouped by their surroundings and sorted over the cluster; the longest match to the
right of each is with a neighbour in that order, and the longest match to the left
with a neighbour in the order of what stands before (a range of the order ends at a
row that is taken to match in full).  Where both together reach `least` words, the
windows of `least` words in between are checked exactly for a second text.

A word is repeated if it lies in a window of `least` words that occurs in two
documents.  Nulls and edge cases: null texts and texts of fewer words have no
passages; equal texts repeat as a whole.  Rows without repeats are left out; rows
that repeat a doc_id each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import check_of, drop, map_batches, map_frames, table
from veridate.llm.words import batches, words

K = 10
#: Repeated k-grams up to which the second scan filters by a shared sorted list; beyond, a join does.
FILTER_LIMIT = 2_000_000


def _slide(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over all windows of `width` successive values."""
    out, done = h, 1
    while done * 2 <= width:
        out, done = pick(out[: len(out) - done], out[done:]), done * 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def minimisers(h: np.ndarray, span: int) -> np.ndarray:
    """Positions of k-gram hashes that are smallest in some window of `span`; of a run of one k-gram the first, the last, and one in `span` // 2 from the first on.

    The ends of a run are places that its copies share, however long the run is elsewhere.
    """
    if len(h) < span:
        return np.zeros(0, np.int64)
    at = np.arange(len(h))
    same = np.concatenate([[False], h[1:] == h[:-1]])
    since = at - np.maximum.accumulate(np.where(same, 0, at))
    inner = same & np.concatenate([h[1:] == h[:-1], [False]])
    keyed = np.where(inner & (since % (span // 2) != 0), np.uint64(0xFFFFFFFFFFFFFFFF), h)
    low = _slide(keyed, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, low, edge]), span, np.maximum) == keyed)


def _anchors(texts: list[str], span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with enough words its index, number of words, k-gram hashes and positions at its minimisers, and word hashes."""
    for base, part in batches(texts):
        w = words(part)
        h, at = w.windows(K)
        cut = np.searchsorted(w.doc[at], np.arange(len(part) + 1))
        for i in range(len(part)):
            own = h[cut[i] : cut[i + 1]]
            pos = minimisers(own, span)
            if len(pos):
                yield base + i, int(w.first[i + 1] - w.first[i]), own[pos], pos, w.hash[w.first[i] : w.first[i + 1]]


def _longest(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the longest common prefix of `column` with any other row of the k-gram, from the neighbours in the order of (kgram, column); the first and last row of a task get the whole length."""
    ordered = rows.repartitionByRange("kgram", column, "ctx").sortWithinPartitions("kgram", column, "ctx")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        before: np.ndarray | None = None  # matches of the held rows' first one with the row before
        for part in parts:
            for at in range(0, len(part), 4096):
                few = part.iloc[at : at + 4096]
                if held is not None:
                    few = pd.concat([held, few], ignore_index=True)
                done, before = _judged(few, column, name, before)
                yield done
                held = few.iloc[-1:]
        if held is not None:
            yield held.assign(**{name: held[column].map(len).to_numpy(np.int32)})

    return map_frames(ordered, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {name} int")


def _judged(rows: pd.DataFrame, column: str, name: str, before: np.ndarray | None) -> tuple[pd.DataFrame, np.ndarray]:
    """All rows but the last with their longest match, given the first one's match with the row before (None: taken as whole), and the last one's match with the row before it."""
    size = rows[column].map(len).to_numpy(np.int64)
    flat = np.full((len(rows), int(size.max(initial=0)) + 1), -1, np.int64)
    inside = np.arange(flat.shape[1]) < size[:, None]
    if inside.any():
        flat[inside] = np.concatenate(rows[column].tolist())
    kgram = rows["kgram"].to_numpy(np.int64)
    differ = flat[1:] != flat[:-1]
    differ[:, -1] = True
    match = np.minimum(np.argmax(differ, axis=1), np.minimum(size[1:], size[:-1])) * (kgram[1:] == kgram[:-1])
    first = size[:1] if before is None else before
    up = np.concatenate([first, match])[: len(rows) - 1]
    return rows.iloc[:-1].assign(**{name: np.maximum(up, match).astype(np.int32)}), match[-1:] if len(match) else first


def repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, repeated_words, n_words, spans) of each row of docs (doc_id, text) with a passage of `least` words that another document has.

    spans: array of (first word, word after the last), merged and in order.
    """
    span, reach = least - K, least - K
    own = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("id"))

    def first(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(part["id"][i], n, h.view(np.int64)) for i, n, h, _, _ in _anchors(part["text"], span)]
            yield pd.DataFrame(rows, columns=["id", "n_words", "kgrams"])

    anchors = table(map_batches(own.select("id", "text"), first, "id long, n_words int, kgrams array<long>"))
    shared = anchors.select("id", F.explode("kgrams").alias("kgram")).groupBy("kgram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("kgram")
    shared = table(shared)
    few = shared.count() <= FILTER_LIMIT
    known = docs.sparkSession.sparkContext.broadcast(np.sort(shared.toPandas()["kgram"].to_numpy(np.int64)) if few else None)

    def second(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        wanted = known.value
        columns = ["id", "pos", "kgram", "right", "left"]
        for part in parts:
            rows = []
            for i, n, h, pos, hashes in _anchors(part["text"], span):
                g = h.view(np.int64)
                if wanted is not None:
                    use = wanted[np.minimum(np.searchsorted(wanted, g), max(len(wanted) - 1, 0))] == g if len(wanted) else np.zeros(len(g), bool)
                    g, pos = g[use], pos[use]
                short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for k, p in zip(g.tolist(), pos.tolist(), strict=True):
                    rows.append((part["id"][i], p, k, short[p : p + least], short[max(0, p - reach) : p][::-1]))
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    found = map_batches(own.select("id", "text"), second, "id long, pos int, kgram long, right array<int>, left array<int>")
    if not few:
        found = found.join(shared, "kgram", "left_semi")
    found = table(found.withColumn("ctx", F.xxhash64("kgram", "right", "left")))
    # Equal surroundings are one suffix from here on; in two texts, all their windows repeat.
    grouped = found.groupBy("ctx").agg(F.first("kgram").alias("kgram"), F.first("right").alias("right"), F.first("left").alias("left"), F.min("id").alias("low"), F.max("id").alias("high"))
    grouped = table(grouped)
    sure = grouped.where("low <> high").select("ctx", F.lit(reach).alias("j"), F.lit(least + reach).alias("width"))
    open_ = _longest(_longest(grouped, "right", "to_right"), "left", "to_left").where(f"to_left + to_right >= {least} and not (low <> high and size(left) + size(right) < {least})")
    starts = F.sequence(F.greatest(F.lit(0), least - F.least("to_right", F.size("right"))), F.least(F.lit(reach), "to_left", F.size("left")))
    enough = F.greatest(F.lit(0), least - F.least("to_right", F.size("right"))) <= F.least(F.lit(reach), "to_left", F.size("left"))
    windows = open_.where(enough).select("ctx", "low", "high", F.explode(starts).alias("j"), "left", "right").withColumn("words", F.concat(F.reverse(F.slice("left", F.lit(1), F.col("j"))), F.slice("right", F.lit(1), F.lit(least) - F.col("j")))).select("ctx", "low", "high", "j", F.xxhash64("words").alias("window"), check_of("words").alias("check"))
    windows = table(windows)
    twice = table(windows.groupBy("window", "check").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("window", "check"))
    proven = windows.where("low = high").join(twice, ["window", "check"], "left_semi").select("ctx", "j", F.lit(least).alias("width"))
    places = found.select("ctx", "id", "pos", F.size("left").alias("before"), F.size("right").alias("after"))
    spans = places.join(sure.unionByName(proven), "ctx").select("id", F.greatest(F.lit(0), F.col("pos") - F.least("j", "before")).alias("a"), F.least(F.col("pos") - F.col("j") + F.col("width"), F.col("pos") + F.col("after")).alias("b")).where(f"b - a >= {least}")
    copies = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(anchors.where(F.col("n_words") >= least).select("id", "n_words").distinct(), "id").select("id", F.lit(0).alias("a"), F.col("n_words").alias("b"))
    ordered = spans.unionByName(copies).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("parts"))
    merged = ordered.select("id", F.expr("""aggregate(parts, cast(array() as array<struct<a:int,b:int>>),
        (acc, x) -> if(size(acc) > 0 and x.a <= element_at(acc, -1).b,
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))),
            concat(acc, array(named_struct('a', x.a, 'b', x.b)))))""").alias("spans"))
    merged = merged.join(anchors.select("id", "n_words").distinct(), "id").withColumn("repeated_words", F.aggregate("spans", F.lit(0), lambda s, x: s + x["b"] - x["a"]))
    done = table(merged.select("id", "repeated_words", "n_words", "spans"))
    drop(anchors, shared, found, grouped, windows, twice)
    return own.drop("text").join(done, "id").select("doc_id", "repeated_words", "n_words", "spans")
