"""Removal of repeated and nearly repeated lines by a segment-partition edit join.

A line of length L is cut into threshold + 1 segments.  If two lines are within
`threshold` edits, the longer one holds some segment of the shorter one unchanged,
shifted by no more than the edits allow; so each line also offers the few
substrings that could be such a segment, for every length down to L - threshold
and only at the places that a segment's number and the length difference permit.
Segments and substrings are hashed in whole-array operations, gathered by hash in
packed rows, and pairs that meet are verified with a banded bit-parallel automaton.
Before that, a pair has to agree in a sketch: the parities of how often a line holds
the character pairs of each of 64 hash values, of which one edit turns four at most.
Lines of keys that many unlike lines share meet again by runs of characters that are
rare among them, at about the same place (see `rare_runs`).  Lines connected by pairs
within the threshold form a class; the first line of a class (by doc_id, then line
number) stays, the others go.

Lines are compared with blanks trimmed and runs of white space as one blank.  Lines
shorter than `least` characters always stay.  A null text stays null, an empty one
empty.  A null doc_id comes after all others.  Rows equal in doc_id and text count
as one document and give equal rows.  A line is known by 96 bits of its hash, and
links hold only for lines whose second hash is that of the text that was compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import drop, map_batches, map_frames, small_batches, table
from veridate.llm.links import Joined, blocks, in_blocks, link, rarest, repeated, sketched
from veridate.llm.words import Spans, batches, join, mix

_U = np.uint64
#: Keys of one packed bucket, on average, and keys that a task packs at a time.
BUCKET, PACKED = 1 << 20, 1 << 20
#: Rows, and bytes of lists of cut lines, up to which the other side of a join with the documents is broadcast.
FEW_ROWS, FEW_BYTES = 250_000, 32 << 20
#: Lines of one block, and their characters up to which they are compared in blocks.
BLOCK, LONG = 256, 2000
#: Pairs that the sketches of a key's lines decide for each line before finer keys come in.
PAIRS_A_LINE = 256
_UNEVEN = re.compile(r"[^\S\n ]|  |(?:^|\n) | (?:\n|$)")


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring that a line offers; difference 0 and shift 0 are its own segments."""
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1):
                out.append((less, i, shift))
    return out


def segment_keys(lines: list[str], threshold: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed segments and substrings of lines, and the line each belongs to."""
    cp, starts = join(lines)
    spans, size = Spans(cp), np.diff(starts) - 1
    keys, owners = [], []
    for less, i, shift in probes(threshold):
        length = size - less
        base, extra = length // (threshold + 1), length % (threshold + 1)
        longer = np.maximum(0, i - (threshold + 1 - extra))  # the last `extra` segments have one character more
        begin = i * base + longer + shift
        width = base + (i >= threshold + 1 - extra)
        ok = np.flatnonzero((length >= least) & (begin >= 0) & (begin + width <= size))
        a = starts[ok] + begin[ok]
        keys.append(mix(spans.hash(a, a + width[ok]) + (length[ok] * (threshold + 1) + i).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        owners.append(ok)
    return np.concatenate(keys), np.concatenate(owners)


def grams(lines: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed runs of q characters of lines, the line each belongs to, and its place there."""
    cp, starts = join(lines)
    size = np.maximum(np.diff(starts) - q, 0)
    own = np.repeat(np.arange(len(lines)), size)
    place = np.arange(len(own)) - (np.cumsum(size) - size)[own]
    return Spans(cp).hash(place + starts[own], place + starts[own] + q), own, place


def sketches(lines: list[str]) -> np.ndarray:
    """64 parities of each line: bit b says whether an odd number of its pairs of characters hash to b."""
    h, own, _ = grams(lines, 2)
    out = np.zeros(len(lines), _U)
    np.bitwise_xor.at(out, own, _U(1) << (h & _U(63)))
    return out.view(np.int64)


def rare_runs(lines: list[str], counts: Callable[[np.ndarray], np.ndarray], threshold: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which two lines within `threshold` edits share one at least, and the line each belongs to.

    A line's runs of q characters are taken from the rarest on until `threshold` + 1 of them don't overlap, with all of
    the last one's rank: so many can't all be lost to `threshold` edits, and what is left of the
    line with the lower last rank is among the other's.  A key is a run and a stretch of places; a run within `threshold` of a stretch counts there too.
    """
    h, own, place = grams(lines, q)
    order = np.lexsort((h, counts(h), own))
    h, own, place = h[order], own[order], place[order]
    edge = np.searchsorted(own, np.arange(len(lines) + 1)).tolist()
    take = np.zeros(len(h), bool)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        n, places, rank = min(b, a + threshold + 1), place[a:b].tolist(), h[a:b].tolist()
        while n < b and _apart(places[: n - a], q) <= threshold:
            n += 1
        while n < b and rank[n - a] == rank[n - a - 1]:
            n += 1
        take[a:n] = True
    h, own, place = h[take], own[take], place[take]
    width = max(8, 2 * threshold + 1)
    low, high = (place - threshold) // width, (place + threshold) // width
    both = np.flatnonzero(low != high)
    stretch = np.concatenate([low, high[both]]).astype(np.int64).view(_U)
    return mix(np.concatenate([h, h[both]]) + stretch * _U(0x9E3779B97F4A7C15)), np.concatenate([own, own[both]])


def _apart(places: list[int], q: int) -> int:
    """How many runs of q characters at these places don't overlap, at most."""
    n, free = 0, -q
    for p in sorted(places):
        if p >= free:
            n, free = n + 1, p + q
    return n


def within(a: str, b: str, threshold: int) -> bool:
    """Whether at most `threshold` edits turn a into b.

    State d of the automaton holds, as bits around the diagonal, the places in a
    that the read part of b can have reached with d edits.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    lo, hi, most = 0, 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b) <= threshold
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    band = (1 << (2 * threshold + 1)) - 1
    state = [((1 << (d + 1)) - 1) << threshold & band for d in range(threshold + 1)]
    for j, c in enumerate(b):
        at = where.get(c, 0)
        match = (at >> (j - threshold) if j >= threshold else at << (threshold - j)) & band
        new = [state[0] & match]
        for d in range(1, threshold + 1):
            new.append(((state[d] & match) | state[d - 1] | state[d - 1] >> 1 | new[-1] << 1) & band)
        state = new
        if not state[-1]:
            return False
    return bool(state[-1] >> (len(a) - len(b) + threshold) & 1)


def joining(part: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links (a, b) between lines of one block (key, p, q) within `threshold` edits that join components: a forest, whatever the number of such pairs.

    part: id, component, line, sketch, first (one of each pair).  Only pairs that agree in sketches and are not joined yet are compared.
    """
    joined, links, unlike = Joined(), [], set()
    ids, names, lines = part["id"].tolist(), part["component"].tolist(), part["line"].tolist()
    sketch, component = part["sketch"].to_numpy(np.int64), part["component"].to_numpy(np.int64)
    for left, right in blocks(part):
        near = np.bitwise_count((sketch[left][:, None] ^ sketch[right][None, :]).view(_U)) <= 4 * threshold
        x, y = np.nonzero(near & (component[left][:, None] != component[right][None, :]))
        for i, j in zip(left[x].tolist(), right[y].tolist(), strict=True):
            if joined.find(names[i]) == joined.find(names[j]):
                continue
            pair = (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
            if pair in unlike:
                continue
            if within(lines[i], lines[j], threshold):
                joined.join(names[i], names[j])
                links.append(pair)
            else:
                unlike.add(pair)
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def compared(text: str, least: int) -> tuple[list[int], list[str]]:
    """Numbers and normal forms of the lines of a text that are compared."""
    lines = text.split("\n")
    if _UNEVEN.search(text):
        lines = [" ".join(x.split()) for x in lines]
    at = [i for i, x in enumerate(lines) if len(x) >= least]
    return at, [lines[i] for i in at]


def hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Identity of each line: 64 bits and 32 more."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<u8").reshape(-1, 2)
    return both[:, 0].astype(_U).view(np.int64), both[:, 1].astype(np.uint32).view(np.int32)


_SCANNED = ["key", "doc_id", "line_nos", "hashes", "checks", "bucket", "keys", "ids"]


def pack(keys: np.ndarray, own: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows of (bucket, keys, ids) in packed form; of the lines that share a key here one goes to the bucket, all are members right away (bucket -1)."""
    bucket, low = ((keys >> _U(32)) % _U(buckets)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((low, bucket))
    bucket, low, own = bucket[order], low[order], own[order]
    same = np.zeros(len(low), bool)
    same[1:] = (low[1:] == low[:-1]) & (bucket[1:] == bucket[:-1])
    shared = same.copy()
    shared[:-1] |= same[1:]
    b, k, o = bucket[~same], low[~same], own[~same]
    begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    rows = [(int(b[i]), k[i:j].tobytes(), o[i:j].tobytes()) for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(b)], strict=True)]
    if shared.any():
        rows.append((-1, (bucket[shared].astype(_U) << _U(32) | low[shared]).tobytes(), own[shared].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "keys", "ids"]).reindex(columns=_SCANNED).astype("object").where(lambda x: x.notna(), None)


def meet(part: pd.DataFrame) -> pd.DataFrame:
    """Members (key, id) of the keys of one bucket that two ids or more share."""
    bucket = _U(part["bucket"].iloc[0])
    low, own = np.frombuffer(b"".join(part["keys"]), np.uint32), np.frombuffer(b"".join(part["ids"]), np.int64)
    order = np.argsort(low, kind="stable")
    low, own = low[order], own[order]
    same = np.zeros(len(low), bool)
    same[1:] = low[1:] == low[:-1]
    same[:-1] |= same[1:]
    low, own = low[same], own[same]
    rows = pd.DataFrame({"key": (bucket << _U(32) | low.astype(_U)).view(np.int64), "id": own}).drop_duplicates()
    return rows[rows.groupby("key")["id"].transform("size") > 1]


def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for k, i in zip(part["keys"], part["ids"], strict=True):
            yield pd.DataFrame({"key": np.frombuffer(k, np.int64), "id": np.frombuffer(i, np.int64)}).drop_duplicates()


def _wanted_lines(own: DataFrame, places: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, check, line, sketch) of one line of each of ids: the documents that hold one are found by their keys, and only those are split."""
    at = table(places.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("key", "line_no")).alias("at")).groupBy("at.key").agg(F.collect_list("at.line_no").alias("line_nos")))
    few = at.count() <= FEW_ROWS

    def cut(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lines = [" ".join(x.split()) for x in part["line"]]
            if lines:
                h, check = hashes(lines)
                yield pd.DataFrame({"id": h, "check": check, "line": lines, "sketch": sketches(lines)})

    held = own.select("key", "text").join(F.broadcast(at) if few else at, "key").select(F.explode(F.expr("transform(line_nos, i -> element_at(split(text, '\n'), i + 1))")).alias("line"))
    return map_batches(held, cut, "id long, check int, line string, sketch long").dropDuplicates(["id"])


def line_classes(docs: DataFrame, threshold: int = 2, least: int = 24) -> tuple[DataFrame, DataFrame]:
    """Occurrences (key, doc_id, line_no, id, check) of all compared lines, and (id, check, component) of the lines that are linked to other lines."""
    own = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, size // 200 * len(probes(threshold)) // BUCKET)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in parts:
            for base, texts in batches(part["text"]):
                found = [compared(t, least) for t in texts]
                lines = [x for _, some in found for x in some]
                if not lines:
                    continue
                h, check = hashes(lines)
                cut = np.cumsum([0, *(len(at) for at, _ in found)]).tolist()
                rows = [i for i, (at, _) in enumerate(found) if at]
                yield pd.DataFrame({
                    "key": [part["key"][base + i] for i in rows],
                    "doc_id": pd.Series([part["doc_id"][base + i] for i in rows], dtype="object"),
                    "line_nos": [found[i][0] for i in rows],
                    "hashes": [h[cut[i] : cut[i + 1]] for i in rows],
                    "checks": [check[cut[i] : cut[i + 1]] for i in rows],
                    "bucket": None,
                    "keys": None,
                    "ids": None,
                })
                _, first = np.unique(h, return_index=True)
                keys, owner = segment_keys([lines[i] for i in first.tolist()], threshold, least)
                held.append((keys, h[first][owner]))
                if sum(len(k) for k, _ in held) >= PACKED:
                    yield pack(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held = []
        if held:
            yield pack(*map(np.concatenate, zip(*held, strict=True)), buckets)

    scanned = table(map_batches(own, scan, f"key long, doc_id {kind}, line_nos array<int>, hashes array<long>, checks array<int>, bucket int, keys binary, ids binary"))
    places = scanned.where("bucket is null").select("key", "doc_id", F.explode(F.arrays_zip("line_nos", "hashes", "checks")).alias("line")).select("key", "doc_id", F.col("line.line_nos").alias("line_no"), F.col("line.hashes").alias("id"), F.col("line.checks").alias("check"))
    packed = scanned.where("bucket is not null").select("bucket", "keys", "ids")
    small_batches(docs.sparkSession)
    met = packed.where("bucket >= 0").groupBy("bucket").applyInPandas(meet, "key long, id long")
    shared = table(repeated(met.unionByName(map_frames(packed.where("bucket < 0"), unpack, "key long, id long"))))
    texts = table(_wanted_lines(own, places, shared.select("id").distinct()))
    members = table(shared.join(texts.select("id", "sketch"), "id"))

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.loc[[within(x, y, threshold) for x, y in zip(part["la"], part["lb"], strict=True)], ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
        return map_frames(pairs.join(a, "a").join(b, "b").select("a", "b", "la", "lb"), near, "a long, b long")

    q = max(1, min(4, least // (threshold + 1)))

    def finer(ids: DataFrame) -> DataFrame:
        some = table(texts.join(ids, "id", "left_semi").select("id", F.col("line").alias("text"), "sketch"))
        out = rarest(some, lambda lines: grams(lines, q)[0], lambda lines, counts: rare_runs(lines, counts, threshold, q))
        drop(some)
        return out

    alike = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 4 * threshold
    # Long lines meet in pairs, so that no block is heavy; a pair within the threshold is wholly in one of both.
    long = texts.where(F.length("line") > LONG - threshold).select("id")
    some_long = not long.isEmpty()

    def across(some: DataFrame) -> DataFrame:
        found = in_blocks(some, texts.where(F.length("line") <= LONG).select("id", "line", "sketch"), lambda part: joining(part, threshold), BLOCK, float(BLOCK))
        return found.unionByName(verify(sketched(some.join(long, "id", "left_semi"), alike))) if some_long else found

    linked = link(members, verify, finer, alike, across, PAIRS_A_LINE, F.lit(1.0))
    out = table(linked.join(texts.select("id", "check"), "id"))
    drop(shared, texts, members, linked)
    return places, out


def dedup(docs: DataFrame, threshold: int = 2, least: int = 24) -> DataFrame:
    """docs (doc_id, text, any others) with the repeated lines cut from text, and n_lines, n_removed and all_removed (no line with text is left, but some went)."""
    places, linked = line_classes(docs, threshold, least)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "key")
    lines = places.groupBy("id", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).join(linked, ["id", "check"], "left").where("n > 1 or component is not null")
    # Lines without a link are classes of their own, told apart by both hashes.
    classed = table(lines.select("id", "check", F.coalesce("component", "id").alias("class"), F.when(F.col("component").isNull(), F.col("check")).alias("tag"), "first", "n"))
    firsts = classed.groupBy("class", "tag").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select(F.col("class").alias("c"), F.col("tag").alias("t"), "first")
    marks = table(classed.drop("first").join(firsts, (F.col("class") == F.col("c")) & F.col("tag").eqNullSafe(F.col("t"))).select("id", "check", "first"))
    if marks.count() <= FEW_ROWS:
        marks = F.broadcast(marks)
    gone = table(places.join(marks, ["id", "check"]).where(place != F.col("first")).groupBy("key").agg(F.collect_set("line_no").alias("removed")))
    if (gone.agg(F.sum(F.size("removed") * 4 + 32)).first()[0] or 0) <= FEW_BYTES:
        gone = F.broadcast(gone)
    names = {c: f"__{c}" for c in ("key", "removed", "kept") if c in docs.columns}
    own = docs.withColumnsRenamed(names).withColumn("key", F.xxhash64("doc_id", "text")).join(gone, "key", "left")
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.expr("array_join(filter(split(text, '\n'), (x, i) -> not array_contains(removed, i)), '\n')"))
    out = own.withColumn("kept", kept)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    found = {"text": F.col("kept"), "n_lines": F.coalesce(lines, F.lit(0)), "n_removed": F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))}
    found["all_removed"] = F.col("removed").isNotNull() & (F.trim(F.regexp_replace("kept", r"\s+", " ")) == "")
    return out.withColumns({f"_{k}": v for k, v in found.items()}).drop("key", "removed", "kept", *found).withColumnsRenamed({f"_{k}": k for k in found}).withColumnsRenamed({v: k for k, v in names.items()})
