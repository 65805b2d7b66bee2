"""Codes of vectors by product quantisation over whole numbers, with nearest entries found in GNATs.

Each component x becomes floor(scale * x).  A vector is cut into `parts` equal parts;
each part position has a codebook that starts as that part of the vectors with the
smallest ids and is improved by `rounds` of assignment and componentwise floor of the
mean.  The nearest entry of a part (ties to the lower index) is looked up in a
geometric near-neighbour access tree over the codebook's entries: a node has `degree`
split points chosen far from each other, every other entry belongs to its nearest split
point, and a table holds between which distances to each split point the entries of
each child lie.  After a query's distance to a split point is known, every child whose
range is further away than the best entry so far is out with its whole subtree.  Bounds
are rounded outwards and compared strictly, so that no entry that ties is lost, and
squared distances in whole numbers decide.

A round is one pass over the vectors in which a task sums the parts of each entry; the
driver gets one row for each entry, whatever the number of vectors.

Nulls and edge cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id.  Those of another length have codebooks of their
own.  A length that `parts` doesn't divide, or 0, has no equal parts: no row.  Neither
has a vector with a scaled component of 2^27 or more either way, whose error no long
could hold for certain.  Fewer vectors than entries give fewer entries.  Vectors that
repeat an id count each; of those the first entries are ordered by vector and label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import small_batches, table

#: Scaled components stay under this either way.
LARGEST = 1 << 27
#: Parts that descend a tree together.
TOGETHER = 1 << 14


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


@dataclass
class Gnat:
    """A node: entries (index, point) that split it, the ranges of distances, and a subtree or None below each."""

    index: np.ndarray  #: (degree,) entry of each split point
    points: np.ndarray  #: (degree, width)
    low: np.ndarray  #: (degree, degree) least distance of split point i to what belongs to j, itself included, rounded down
    high: np.ndarray
    below: list[Gnat | None]

    @classmethod
    def build(cls, points: np.ndarray, degree: int = 8, index: np.ndarray | None = None) -> Gnat:
        """A tree over the rows of points (whole numbers)."""
        index = np.arange(len(points)) if index is None else index
        chosen = [0]
        far = _squares(points, points[:1])[:, 0]
        while len(chosen) < min(degree, len(points)):
            far[chosen] = -1
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _squares(points, points[chosen[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(points)), chosen)
        squares = _squares(points, points[chosen])  # (entries, degree)
        owner = squares[rest].argmin(1)
        far = np.sqrt(squares.astype(np.float64))
        low, high = np.empty((len(chosen), len(chosen))), np.empty((len(chosen), len(chosen)))
        below: list[Gnat | None] = []
        for j, own in enumerate(chosen):
            mine = rest[owner == j]
            held = far[np.append(mine, own)]
            low[:, j], high[:, j] = _down(held.min(0)), _up(held.max(0))
            below.append(cls.build(points[mine], degree, index[mine]) if len(mine) else None)
        return cls(index[chosen], points[chosen], low, high, below)

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) nearest to each row of asked, of equally near ones the entry with the lower index."""
        best, least = np.full(len(asked), -1), np.full(len(asked), np.iinfo(np.int64).max)
        for lo in range(0, len(asked), TOGETHER):
            part = slice(lo, lo + TOGETHER)
            self._visit(asked[part], np.arange(len(asked[part])), best[part], least[part])
        return best, least

    def _visit(self, asked: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        alive = np.ones((len(rows), len(self.index)), bool)
        for i, own in enumerate(self.index.tolist()):
            at = np.flatnonzero(alive[:, i])
            if not len(at):
                continue
            r = rows[at]
            d = ((asked[r] - self.points[i]) ** 2).sum(1)
            won = (d < least[r]) | ((d == least[r]) & (own < best[r]))
            least[r[won]], best[r[won]] = d[won], own
            # What belongs to j is at least this far: a difference of distances, each rounded so that it can only be too small.
            far, reach = np.sqrt(d.astype(np.float64))[:, None], _up(np.sqrt(least[r].astype(np.float64)))[:, None]
            alive[at] &= (_down(_down(far) - self.high[i]) <= reach) & (_down(self.low[i] - _up(far)) <= reach)
        for j, child in enumerate(self.below):
            if child is not None and alive[:, j].any():
                child._visit(asked, rows[alive[:, j]], best, least)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None]) ** 2).sum(-1)


def usable(column: Column, scale: float) -> Column:
    """Whether a vector takes part."""
    held = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < LARGEST)
    return column.isNotNull() & F.coalesce(F.forall(column, held), F.lit(False))


def _whole(column: pa.Array, parts: int, scale: float) -> np.ndarray:
    """(vectors, parts, width) of scaled whole numbers."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(x * scale).astype(np.int64).reshape(len(column), parts, -1)


def _better(vectors: DataFrame, book: np.ndarray, scale: float, degree: int) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round."""
    parts, entries, width = book.shape
    trees = vectors.sparkSession.sparkContext.broadcast([Gnat.build(b, degree) for b in book])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _whole(b.column(0), parts, scale)
            for p, tree in enumerate(trees.value):
                own, _ = tree.nearest(x[:, p])
                np.add.at(sums[p], own, x[:, p])
                counts[p] += np.bincount(own, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": counts[part, entry], "sums": list(sums[part, entry])}, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    found = vectors.select("embedding").mapInArrow(tally, "part int, entry int, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    book = book.copy()
    for row in total.collect():  # parts x entries rows at most
        book[row.part, row.entry] = [s // row.n for s in row[3:]]
    return book


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, degree: int = 8) -> DataFrame:
    """(vec_id, label, codes, error, codebooks) of the usable rows of vectors (vec_id, embedding, label): codes array of entry indexes by part; error: squared distances to the coded entries, summed; codebooks: name of the final ones, a digest of all components."""
    spark, kinds = vectors.sparkSession, {f.name: f.dataType.simpleString() for f in vectors.schema}
    small_batches(spark)
    size = F.size("embedding")
    own = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), scale) & (size > 0) & (size % parts == 0)).select("vec_id", "embedding", "label")
    done = [_coded(own.where(size == r[0]), parts, entries, rounds, scale, degree) for r in sorted(own.select(size).distinct().collect())]
    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long, codebooks string"
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], shape)


def _coded(own: DataFrame, parts: int, entries: int, rounds: int, scale: float, degree: int) -> DataFrame:
    first = own.orderBy("vec_id", "embedding", F.col("label").asc_nulls_first()).limit(entries).select("embedding").collect()
    book = np.floor(np.array([r[0] for r in first], np.float64) * scale).astype(np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    for _ in range(rounds):
        book = _better(own, book, scale, degree)
    trees = own.sparkSession.sparkContext.broadcast([Gnat.build(b, degree) for b in book])
    name = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _whole(b.column(1), parts, scale)
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees.value)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            error = np.stack([f[1] for f in found]).sum(0)
            listed = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), listed, pa.array(error)], ["vec_id", "label", "codes", "error"])

    coded = own.select("vec_id", "embedding", "label").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")
    return coded.withColumn("codebooks", F.lit(name))


def digests(coded: DataFrame) -> DataFrame:
    """compress()'s rows with codes as hexadecimal digits and the error summed over rows of equal label."""
    coded = table(coded)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digits = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", digits.alias("code"), "error", "label_error", F.col("codebooks").alias("codebooks_sha256"))
