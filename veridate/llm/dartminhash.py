"""Near-duplicate documents by dart-throwing weighted minwise hashing.

Every element (a word window of a text) owns an endless plane of random darts, one
a unit of area, the same wherever the element occurs: a dart has a place on the
weight axis, a rank, and a coordinate of the signature.  A text keeps the darts
that land below each element's weight and below a rank limit set so that about
k ln k + 2k darts remain however many elements there are; the earliest dart of each
coordinate is its signature.  Two texts agree on a coordinate with the probability
of their weighted Jaccard similarity.  An element weighs as often as it occurs.  Bands
of coordinates are join keys, and candidate pairs are verified exactly on their windows:
first those with the leaders of keys, then all others in blocks, where one matrix
product gives what each two texts share.

Nulls and edge cases: a null or empty text is alone in its class.  Texts of one to
four words are one window each; texts without any word are linked only if they are
equal.  Equal texts are one class without being paired.  Rows that repeat a doc_id
each get a row; class_id is the smallest non-null doc_id of the class.  Texts are known
by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import check_of, drop, map_frames, small_batches, table
from veridate.llm.links import Joined, blocks, in_blocks, link, rarest, repeated
from veridate.llm.words import batches, mix, shingles

_U = np.uint64
#: Pairs for each text of a key that are compared before finer keys come in; texts, and elements of texts, of one block; elements of one matrix product; characters sketched at a time.
PAIRS_A_TEXT, BLOCK, BLOCK_ELEMENTS, COLUMNS, SKETCHED = 512, 512, 500_000.0, 2048, 1_000_000
#: Pairs of a block up to which they are taken one by one, without a matrix product.
FEW_PAIRS = 64
#: Ids up to which they are broadcast to the texts, instead of moving all texts.
FEW_IDS = 1_000_000
_LOWEST = -8  #: the first rank cell is [0, 2**_LOWEST), each further one reaches twice as far


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    p, out, k = np.exp(-mean), [], 0
    while p > 1e-18 or k < mean:
        out.append(p)
        k += 1
        p *= mean / k
    return np.cumsum(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """(docs, k) identities of the earliest dart of each coordinate; 0 for documents without an element."""
    total = np.bincount(doc, weight, docs)
    out = np.zeros((docs, k), np.uint64)
    limit = np.divide(k * (np.log(k) + 2), total, out=np.zeros(docs), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        place = np.full(docs, -1)
        place[todo] = np.arange(len(todo))
        use = place[doc] >= 0
        e, d, x = element[use], doc[use], weight[use]
        ranks, names, slots = [], [], []
        for level in range(64):
            low, high = (0.0 if not level else 2.0 ** (_LOWEST + level - 1)), 2.0 ** (_LOWEST + level)
            near = np.flatnonzero(limit[d] > low)
            if not len(near):
                break
            for cell in range(64):
                left, right = (0.0 if not cell else 2.0 ** (cell - 1)), 2.0**cell
                own = near[x[near] > left]
                if not len(own):
                    break
                area = (high - low) * (right - left)
                parts = max(1, int(np.ceil(area)))
                seed = mix(mix(e[own]) + _U((level * 64 + cell + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                part = np.tile(np.arange(parts, dtype=np.uint64), len(own)) if parts > 1 else np.zeros(len(own), np.uint64)
                who = np.repeat(own, parts)
                seed = mix(np.repeat(seed, parts) + part * _U(0xD1342543DE82EF95))
                count = np.searchsorted(_poisson(area / parts), _unit(seed), "right")
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                name = mix(np.repeat(seed, count) + (nth + 1).astype(np.uint64) * _U(0xA0761D6478BD642F))
                who, part = np.repeat(who, count), np.repeat(part, count)
                spot = mix(name ^ _U(0xE7037ED1A0B428DB))
                rank = low + (part.astype(np.float64) + _unit(spot)) * (high - low) / parts
                keep = rank < limit[d[who]]
                if cell or (x[own] < right).any():
                    keep &= left + _unit(mix(spot + _U(0x8EBC6AF09C88C6E3))) * (right - left) < x[who]
                ranks.append(rank[keep])
                names.append(name[keep])
                slots.append(place[d[who[keep]]] * k + (name[keep] % _U(k)).astype(np.int64))
        rank, name, slot = np.concatenate(ranks), np.concatenate(names), np.concatenate(slots)
        first = np.full(len(todo) * k, np.inf)
        np.minimum.at(first, slot, rank)
        best = np.zeros(len(todo) * k, np.uint64)
        won = rank == first[slot]
        best[slot[won]] = name[won]
        full = np.isfinite(first).reshape(-1, k).all(axis=1)
        out[todo[full]] = best.reshape(-1, k)[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(docs, bands) join keys as signed 64-bit integers."""
    docs, k = signature.shape
    rows = signature.reshape(docs, bands, k // bands)
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _U(0x2545F4914F6CDD1D), (docs, 1))
    for i in range(k // bands):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return acc.view(np.int64)


def elements(texts: list[str], n: int, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each text, the text each belongs to, and their weights: 1, or with `counts` how often the window occurs."""
    h, doc = shingles(texts, n, distinct=False)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h))).astype(np.float64)
    return h[at], doc[at], times if counts else np.ones(len(at))


def jaccard(left: list[str], right: list[str], n: int, counts: bool) -> np.ndarray:
    """Exact (weighted) Jaccard similarity of each pair of texts."""
    out = np.zeros(len(left))
    sides = [elements(side, n, counts) for side in (left, right)]
    edges = [np.searchsorted(s[1], np.arange(len(left) + 1)) for s in sides]
    for i in range(len(left)):
        (a, _, x), (b, _, y) = sides
        sa, sb = slice(edges[0][i], edges[0][i + 1]), slice(edges[1][i], edges[1][i + 1])
        _, p, q = np.intersect1d(a[sa], b[sb], assume_unique=True, return_indices=True)
        both = np.minimum(x[sa][p], y[sb][q]).sum()
        total = x[sa].sum() + y[sb].sum() - both
        out[i] = both / total if total else 0.0
    return out


def numbered(texts: list[str], n: int, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each text with repeats as elements of their own, so that the plain similarity of these is the weighted one, and the text each belongs to."""
    h, own = shingles(texts, n, distinct=not counts)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    nth = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return mix(h + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), own


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of some sets of hashes shares with each of some others."""
    values, split = [*left, *right], len(left)
    doc = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, column, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    keep = times[column] > 1  # an element of one set alone is shared with none
    _, column = np.unique(column[keep], return_inverse=True)
    doc, order = doc[keep], np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((split, len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        some = np.zeros((len(values), COLUMNS), np.float32)
        some[doc[a:b], column[a:b] - low] = 1
        out += some[:split] @ some[split:].T
    return out


def joining(part: pd.DataFrame, threshold: float, joined: Joined | None = None) -> pd.DataFrame:
    """Links (a, b) between similar rows (id, component, value, first), one of them marked first, that join components: a forest, whatever the number of similar pairs."""
    joined = joined or Joined()
    part = part.drop_duplicates(["id", "first"])
    left, right = part[part["first"]], part[~part["first"]]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    both = shared(left["value"].tolist(), right["value"].tolist()).astype(np.float64)
    sizes = [np.array([len(v) for v in side["value"]], np.float64) for side in (left, right)]
    names = [side["component"].to_numpy() for side in (left, right)]
    total = sizes[0][:, None] + sizes[1][None, :] - both
    x, y = np.nonzero((both >= threshold * total - 1e-9) & (names[0][:, None] != names[1][None, :]))
    links, a_ids, b_ids = [], left["id"].tolist(), right["id"].tolist()
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = int(names[0][i]), int(names[1][j])
        if joined.find(a) != joined.find(b):
            joined.join(a, b)
            links.append((min(a_ids[i], b_ids[j]), max(a_ids[i], b_ids[j])))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def joining_blocks(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """`joining` within each block (key, p, q) of part; blocks of few pairs take these one by one, without pairs that other blocks have joined."""
    joined, links, found = Joined(), [], []
    ids, names, values = part["id"].tolist(), part["component"].tolist(), part["value"].tolist()
    for left, right in blocks(part):
        if len(left) * len(right) > FEW_PAIRS:
            found.append(joining(part.iloc[np.concatenate([left, right])], threshold, joined))
            continue
        for i in left.tolist():
            for j in right.tolist():
                a, b = len(values[i]), len(values[j])
                if min(a, b) < threshold * max(a, b) - 1e-9 or joined.find(names[i]) == joined.find(names[j]):
                    continue
                both = np.sort(np.concatenate([values[i], values[j]]))
                n = int((both[1:] == both[:-1]).sum())
                if n >= threshold * (a + b - n) - 1e-9:
                    joined.join(names[i], names[j])
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.concat([pd.DataFrame(links, columns=["a", "b"], dtype=np.int64), *found])


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = 32, rows: int = 5, counts: bool = True) -> DataFrame:
    """(doc_id, class_id, class_size, kept, key) of each row of docs (doc_id, text).

    key: hash of doc_id and text.  kept: the row that stands for its class (smallest doc_id, one row only).  With
    32 bands of 5, a pair at similarity 0.8 shares no band three times in a million, and fewer than
    two once in 20,000.  counts: elements weigh as often as they occur, else 1.
    """
    own = docs.select("doc_id", "text", F.when(F.length("text") > 0, F.xxhash64("text")).alias("id"), check_of("text").alias("check"))

    def sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, whole = part["id"].to_numpy(), part["text"].tolist()
            for base, texts in batches(whole, SKETCHED):
                h, doc, weight = elements(texts, n, counts)
                total = np.bincount(doc, weight, len(texts))
                here = np.flatnonzero(total)
                if len(here):
                    keys = band_keys(signatures(h, doc, weight, len(texts), bands * rows)[here], bands)
                    yield pd.DataFrame({"id": ids[base + here], "keys": list(keys), "sketch": total[here].astype(np.int64)})

    sketched = table(map_frames(own.where("id is not null").select("id", "text"), sketch, "id long, keys array<long>, sketch long"))
    members = table(repeated(sketched.select(F.explode("keys").alias("key"), "id", "sketch")))
    texts = table(own.join(_few(members), "id", "left_semi").groupBy("id").agg(F.first(F.struct("check", "text")).alias("one")).select("id", "one.check", "one.text"))

    def similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            left, right = part["ta"].tolist(), part["tb"].tolist()
            for base, few in batches(left):
                alike = jaccard(few, right[base : base + len(few)], n, counts) >= threshold
                yield part.iloc[base : base + len(few)].loc[alike, ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        return map_frames(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb"), similar, "a long, b long")

    def pick(some: list[str], counted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, of = numbered(some, n, counts)
        order = np.lexsort((h, counted(h), of))
        h, of = h[order], of[order]
        size = np.bincount(of, minlength=len(some))
        keep = np.arange(len(h)) - (np.cumsum(size) - size)[of] < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[of]
        return h[keep], of[keep]

    def finer(ids: DataFrame) -> DataFrame:
        some = table(texts.join(ids, "id", "left_semi").join(members.select("id", "sketch").distinct(), "id").select("id", "text", "sketch"))
        out = rarest(some, lambda part: numbered(part, n, counts)[0], pick)
        drop(some)
        return out

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for base, some in batches(part["text"].tolist()):
                h, of = numbered(some, n, counts)
                edge = np.searchsorted(of, np.arange(len(some) + 1))
                yield pd.DataFrame({"id": part["id"].to_numpy(np.int64)[base : base + len(some)], "value": [h[a:b].view(np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)]})

    def across(some: DataFrame) -> DataFrame:
        small_batches(docs.sparkSession)
        own = texts.join(_few(some), "id", "left_semi").select("id", "text")
        return in_blocks(some, map_frames(own, values, "id long, value array<long>"), lambda part: joining_blocks(part, threshold), BLOCK, BLOCK_ELEMENTS)

    linked = link(members, verify, finer, lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9, across, PAIRS_A_TEXT)
    out = _stand(own.withColumn("key", F.xxhash64("doc_id", "text")).drop("text"), linked.join(texts.select("id", "check"), "id"))
    drop(sketched, members, texts, linked)
    return out


def _few(rows: DataFrame) -> DataFrame:
    """The distinct ids of some rows, broadcast if they are few."""
    ids = table(rows.select("id").distinct())
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _stand(own: DataFrame, linked: DataFrame) -> DataFrame:
    """Class figures of rows (doc_id, id, check, key), given the components of linked texts (id, check)."""
    placed = table(own.withColumn("row", F.monotonically_increasing_id()))
    texts = placed.where("id is not null").groupBy("id", "check").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    classed = table(texts.join(linked, ["id", "check"], "left").where("n > 1 or component is not null").withColumn("class", F.coalesce("component", "id")).withColumn("tag", F.when(F.col("component").isNull(), F.col("check"))))
    figures = classed.groupBy("class", "tag").agg(F.min("class_id").alias("class_id"), F.sum("n").alias("class_size"), F.min("first").alias("first"))
    same = (F.col("c.class") == F.col("f.class")) & F.col("c.tag").eqNullSafe(F.col("f.tag"))
    marks = table(classed.select("id", "check", "class", "tag").alias("c").join(figures.alias("f"), same).select("c.id", "c.check", "f.class_id", "f.class_size", "f.first.row"))
    drop(classed)
    marks = marks.withColumnRenamed("row", "first")
    kept = F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return placed.join(marks, ["id", "check"], "left").select("doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), kept.alias("kept"), "key")
