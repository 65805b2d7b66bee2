"""Linking similar things that share a key, and connected components, as Spark jobs.

Every pair that shares a key and is not connected by other links is checked.  Three
rounds keep the work near the number of members:

1.  Each id meets the leaders of its few largest keys, a row for each, which closes
    groups of alike members without their pairs.
2.  Of the keys that still hold several components, those with few pairs between
    components for their members have all of these checked.  Members of the others get
    finer keys: their own elements that are rarest among all such members, so many
    that two similar ids can't but share one (prefix filter).  Large finer keys are
    led as in the first round.
3.  All pairs between components that finer keys still hold are checked, in blocks, so
    that no key ends in one task.

`across` checks all pairs of keys: `sketched` as a join with a condition on small
sketches of two ids that holds for all similar pairs, so that most unlike pairs never
become rows; `in_blocks` within Arrow groups, of which only links that join
components come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veridate.llm.common import drop, map_frames, table
from veridate.llm.words import batches

#: Keys of an id, the largest ones, whose leaders it meets.
LED = 2
#: Members of a key that meet in one block.
BLOCK = 256
#: Buckets in which the elements of finer keys are counted.
COUNTED = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); component: the smallest id.  Alternates large-star and small-star steps until nothing changes."""
    edges, state = _counted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new, now = _counted(small)
        drop(edges)
        edges = new
        if now == state:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
            out.scratch_path = edges.scratch_path
            return out
        state = now


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """edges as a table, and figures that tell one set of edges from another."""
    seen = Observation()
    out = table(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
    return out, seen.get


def _pairs(a: DataFrame, b: DataFrame, on: list[str], alike: Callable[[Column, Column], Column], also: Column) -> DataFrame:
    """Distinct (a, b) of rows (id, sketch) that meet and may be similar."""
    return a.join(b, on).where(also & alike(F.col("sx"), F.col("sy"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _side(members: DataFrame, name: str, *columns: str) -> DataFrame:
    return members.select(*columns, F.col("id").alias(name), F.col("sketch").alias(f"s{name}"), F.col("component").alias(f"c{name}"))


def _led(members: DataFrame, alike: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of each id with the leaders of its LED largest keys that are in other components."""
    members = members.select("key", "id", "sketch", "component")
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "sketch", "component"), F.xxhash64("id", "key")).alias("head"))
    sized = members.join(keys.select("key", "n"), "key").groupBy("id", "sketch", "component").agg(F.slice(F.sort_array(F.collect_set(F.struct("n", "key")), asc=False), 1, LED).alias("keys"))
    asked = _side(sized.select("id", "sketch", "component", F.explode("keys.key").alias("key")), "x", "key")
    heads = keys.select("key", F.col("head.id").alias("y"), F.col("head.sketch").alias("sy"), F.col("head.component").alias("cy"))
    return _pairs(asked, heads, ["key"], alike, F.col("cx") != F.col("cy"))


def _dealt(members: DataFrame, most: int, heaviest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Outliers of each key (members outside its largest component), and all its members, dealt into (key, p, q): blocks p of outliers and q of members, each two of which meet once.

    A group of alike members with few outliers costs a row for each, not its square.
    """
    blocks = lambda n, weight: F.ceil(n / most) if heaviest is None else F.ceil(F.greatest(n / most, weight / heaviest))
    some = members.withColumns({"ps": F.greatest(F.lit(1), blocks(F.col("outliers"), F.col("weight") * F.col("outliers") / F.col("n"))).cast("int"), "qs": blocks(F.col("n"), F.col("weight")).cast("int")})
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    a = some.where("outlier").withColumn("p", own("ps")).withColumn("q", F.explode(F.expr("sequence(0, qs - 1)")))
    b = some.withColumn("q", own("qs")).withColumn("p", F.explode(F.expr("sequence(0, ps - 1)")))
    return a, b


def sketched(members: DataFrame, alike: Callable[[Column, Column], Column]) -> DataFrame:
    """All pairs of members of one key that are in different components and may be similar."""
    a, b = _dealt(members, BLOCK)
    at = ["key", "p", "q"]
    return _pairs(_side(a, "x", *at), _side(b, "y", *at, "outlier"), at, alike, F.expr("cx <> cy and (not outlier or x < y)"))


def _open(members: DataFrame, labels: DataFrame, weight: Column) -> DataFrame:
    """Members of the keys that still hold several components, with n (members of the key), weight (of their sketches), pairs (between components), outlier (not in the key's largest component) and outliers (how many)."""
    now = table(members.select("key", "id", "sketch").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    sizes = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("count"), F.sum(weight).alias("weight"))
    keys = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("count") * F.col("count")).alias("squares"), F.max(F.struct("count", "component")).alias("main")).where("parts > 1")
    figures = keys.select("key", "n", "weight", ((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs"), (F.col("n") - F.col("main.count")).alias("outliers"), F.col("main.component").alias("main"))
    out = table(now.join(figures, "key").withColumn("outlier", F.col("component") != F.col("main")).drop("main"))
    drop(now)
    return out


class Joined:
    """Components that links found so far have joined."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def find(self, i: int) -> int:
        while (up := self.top.get(i, i)) != i:
            self.top[i] = i = self.top.get(up, up)
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.top[max(a, b)] = min(a, b)


def blocks(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the outliers and of the members of each block in rows (key, p, q, first) of `in_blocks`."""
    code = part.groupby(["key", "p", "q"], sort=False).ngroup().to_numpy()
    first = part["first"].to_numpy(bool)
    order = np.lexsort((~first, code))
    edge = np.searchsorted(code[order], np.arange(int(code.max()) + 2))
    heads = np.concatenate([[0], np.cumsum(first[order])])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        m = a + int(heads[b] - heads[a])
        if a < m < b:
            yield order[a:m], order[m:b]


def in_blocks(members: DataFrame, values: DataFrame, check: Callable[[pd.DataFrame], pd.DataFrame], most: int, heaviest: float) -> DataFrame:
    """Links (a, b) that `check` finds between outliers (first: true) and members (first: false) of each block (key, p, q), given whole blocks with component and the values (id, any others) of each row.

    Blocks hold about `most` members or `heaviest` weight; a block of a small key is handed over with others of its kind, about as many together.
    """
    a, b = _dealt(members, most, heaviest)
    size = members.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") / F.col("n")).alias("weight")).first()
    groups = max(1, int(np.ceil(max(size.n / most, (size.weight or 0) / heaviest))))
    alone = F.xxhash64("key", "p", "q")
    group = F.when((F.col("ps") == 1) & (F.col("qs") == 1), F.pmod(alone, F.lit(groups))).otherwise(alone)
    rows = lambda side, first: side.select(group.alias("group"), "key", "p", "q", "id", "component", F.lit(first).alias("first"))
    return rows(a, True).unionByName(rows(b, False)).join(values, "id").groupBy("group").applyInPandas(check, "a long, b long").distinct()


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], finer: Callable[[DataFrame], DataFrame], alike: Callable[[Column, Column], Column], across: Callable[[DataFrame], DataFrame], pairs_a_member: int, weight: Column | None = None) -> DataFrame:
    """(id, component) of all ids with a link.

    members: distinct (key, id, sketch).  verify: keeps those rows of (a, b) that are similar.  finer: other keys
    (key, id, sketch) of given ids, of which two similar ids share one at least.  alike: holds for the sketches of
    all similar pairs.  across: links that join the components of members of one key.  pairs_a_member: pairs between
    components up to which a key has all of them checked at once.  weight: of a member, for blocks; its sketch if not given.
    """
    weight = F.col("sketch").cast("double") if weight is None else weight
    found: list[DataFrame] = []
    small = F.col("pairs") <= pairs_a_member * F.col("n")

    def labels(*links: DataFrame) -> DataFrame:
        found.extend(table(x) for x in links)
        return components(reduce(DataFrame.unionByName, found))

    named = labels(verify(_led(members.withColumn("component", F.col("id")), alike)))
    rest = _open(members, named, weight)
    if rest.isEmpty():
        drop(rest, *found)
        return named
    large = rest.where(~small)
    if large.isEmpty():
        named = labels(across(rest))
        drop(rest, *found)
        return named
    split = _open(repeated(finer(large.select("id").distinct())), named, weight)
    drop(named)
    named = labels(across(rest.where(small)), across(split.where(small)), verify(_led(split.where(~small), alike)))
    last = _open(split.where(~small), named, weight)
    if not last.isEmpty():
        named = labels(across(last))
    drop(rest, split, last, *found)
    return named


def repeated(members: DataFrame) -> DataFrame:
    """Distinct members (key, id, any others) of the keys that two ids or more share; a key's copies combine before the shuffle."""
    shared = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    return members.join(shared.select("key"), "key", "left_semi").distinct()


def rarest(texts: DataFrame, elements: Callable[[list[str]], np.ndarray], pick: Callable[[list[str], Callable[[np.ndarray], np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, id, sketch) of elements of each text (id, text, sketch), chosen by how many elements of all texts hash to the same bucket.

    elements: hashes of all elements of some texts.  pick: keys and the text each belongs to, given the texts and a
    function from hashes to counts.  The counts only order the elements, for all texts alike.
    """

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTED, np.int64)
        for part in parts:
            for _, some in batches(part["text"].tolist()):
                total += np.bincount((elements(some) % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    counts = np.zeros(COUNTED, np.int64)
    known = map_frames(texts.select("text"), tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # COUNTED rows at most
    counts[known["bucket"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for base, some in batches(part["text"].tolist()):
                keys, own = pick(some, lambda h: shared.value[(h % np.uint64(COUNTED)).astype(np.int64)])
                rows = part.iloc[base + own]
                yield pd.DataFrame({"key": keys.view(np.int64), "id": rows["id"].to_numpy(np.int64), "sketch": rows["sketch"].to_numpy()})

    return table(map_frames(texts.select("id", "text", "sketch"), run, "key long, id long, sketch long"))
