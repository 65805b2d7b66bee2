"""Nearest neighbours with score-aware (anisotropic) quantisation and four-bit table scans.

The square of a distance is |q|^2 + |x|^2 - 2 q.x, so that the largest inner products
matter.  Vectors are cut into groups of `width` coordinates with 16 codewords each, so
that a code is four bits.  Codewords and codes minimise a loss in which the part of the
residual that is parallel to the vector, which shifts large inner products, weighs
`parallel` times the rest.  Vectors lie in cells around coarse centres; a query looks
into its nearest cells, as many as held `reach` of the true neighbours of sampled
vectors.  Cells are dealt out in blocks of vectors and chunks of queries, so that no
cell ends in one task, and both meet in a cogroup.  There a query sums four-bit table entries over
all codes of the block, reranks the best `depth` by exact distance, and then every
other vector that its estimate, less the length of its residual, still allows to
be nearer than the k-th: within a block no neighbour is lost to quantisation.

Centres and codewords are fitted on a bounded sample (`sample` vectors with the
smallest hashes); every vector is indexed.  Recall can fall short of 1 only by the
cells that a query leaves out.

Nulls and edge cases: null and zero vectors, and those with null or non-finite
components, take no part; nor do rows without an id.  Vectors of another length are
searched among themselves.  Equal distances go to the smaller id.  A row is never its
own neighbour, nor are rows that repeat its id.  An id that repeats counts once, by its
nearest vector; as a query it asks with its smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridate.llm.common import drop, map_frames, small_batches, table

#: Vectors of a cell on average, cells at most, vectors of a block and queries of a chunk.
CELL, MOST_CELLS, BLOCK, CHUNK = 4096, 1024, 4096, 4096


@dataclass
class Codebook:
    words: np.ndarray  #: (groups, 16, width) codewords
    parallel: float
    centres: np.ndarray  #: (cells, size)
    probes: int  #: cells that a query looks into

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(n, groups, width) of vectors padded to whole groups."""
        groups, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, groups * width - x.shape[1]))).reshape(len(x), groups, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, groups) codes by coordinate descent under the anisotropic loss, lengths of the decoded vectors squared, and of the residuals."""
        parts = self.parts(x)
        codes = _assign(parts, self.words, self.parallel)
        decoded = self.words[np.arange(len(self.words))[None], codes]
        return codes, (decoded**2).sum((1, 2)), np.sqrt(((parts - decoded) ** 2).sum((1, 2)))

    def lookup(self, q: np.ndarray) -> np.ndarray:
        """(queries, groups, 16) table entries."""
        return np.einsum("qgd,gkd->qgk", self.parts(q), self.words)

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def _assign(parts: np.ndarray, words: np.ndarray, parallel: float, sweeps: int = 2) -> np.ndarray:
    n, groups = parts.shape[:2]
    unit = parts / np.maximum(np.sqrt((parts**2).sum((1, 2))), 1e-12)[:, None, None]
    codes = np.empty((n, groups), np.uint8)
    along = np.zeros((n, groups))  # residual of each group along the vector
    for g in range(groups):
        d = parts[:, g, None, :] - words[g][None]
        codes[:, g] = (d * d).sum(-1).argmin(1)
        along[:, g] = (d[np.arange(n), codes[:, g]] * unit[:, g]).sum(-1)
    total = along.sum(1)
    for _ in range(sweeps):
        for g in range(groups):
            d = parts[:, g, None, :] - words[g][None]
            own = (d * unit[:, g, None, :]).sum(-1)
            rest = (total - along[:, g])[:, None]
            loss = (d * d).sum(-1) + (parallel - 1) * (rest + own) ** 2
            codes[:, g] = loss.argmin(1)
            along[:, g] = own[np.arange(n), codes[:, g]]
            total = rest[:, 0] + along[:, g]
    return codes


def fit(x: np.ndarray, cells: int = 1, width: int = 1, parallel: float = 4.0, rounds: int = 4, reach: float = 0.97, k: int = 10) -> Codebook:
    """Centres from sampled vectors by k-means, and codewords from 5,000 of them by alternate assignment and weighted least squares for each group."""
    rng = np.random.default_rng(7)
    groups = -(-x.shape[1] // width)
    book = Codebook(np.zeros((groups, 16, width)), parallel, x[rng.choice(len(x), cells, replace=len(x) < cells)].copy(), cells)
    for _ in range(8 if cells > 1 else 0):
        own = book.nearest_cells(x, 1)[:, 0]
        for c in np.unique(own).tolist():
            book.centres[c] = x[own == c].mean(0)
    if cells > 1:  # how many cells hold the neighbours of sampled vectors
        q, own, near = x[:400], book.nearest_cells(x, 1)[:, 0], []
        order = book.nearest_cells(q, cells)
        for i in range(len(q)):
            d = ((x - q[i]) ** 2).sum(1)
            d[i] = np.inf
            near += np.flatnonzero(np.isin(order[i], own[np.argsort(d)[:k]])).tolist()
        book.probes = min(cells, int(np.quantile(near, reach)) + 2)
    parts = book.parts(x[:5000])
    n = len(parts)
    unit = parts / np.maximum(np.sqrt((parts**2).sum((1, 2))), 1e-12)[:, None, None]
    words = np.stack([parts[rng.choice(n, 16, replace=n < 16), g] for g in range(groups)])
    for turn in range(rounds):
        weight = 0.0 if turn < rounds // 2 else parallel - 1
        codes = _assign(parts, words, weight + 1)
        along = ((parts - words[np.arange(groups)[None], codes]) * unit).sum(-1)
        total = along.sum(1)
        for g in range(groups):
            rest = total - along[:, g]
            for c in range(16):
                m = codes[:, g] == c
                if not m.any():
                    words[g, c] = parts[rng.integers(n), g]
                    continue
                u, p = unit[m, g], parts[m, g]
                a = m.sum() * np.eye(width) + weight * u.T @ u
                b = p.sum(0) + weight * ((rest[m] + (p * u).sum(1))[:, None] * u).sum(0)
                words[g, c] = np.linalg.solve(a, b)
    book.words = words
    return book


def usable(column: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return column.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda v: v != 0)


def search(vectors: DataFrame, queries: Column, k: int = 10, depth: int = 100, sample: int = 20_000, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows of each row of vectors (vec_id, embedding) for which `queries` holds."""
    own = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = {r[0]: r[1] for r in own.groupBy(F.size("embedding")).count().collect()}
    found = [_search(own.where(F.size("embedding") == size), n, queries, k, depth, sample, cell) for size, n in sorted(sizes.items())]
    return reduce(DataFrame.unionByName, found) if found else own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _search(own: DataFrame, n: int, queries: Column, k: int, depth: int, sample: int, cell: int) -> DataFrame:
    spark, kind = own.sparkSession, own.schema["vec_id"].dataType.simpleString()
    rows = own.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "embedding").limit(sample).collect()
    book = spark.sparkContext.broadcast(fit(np.array([r.embedding for r in rows]), min(MOST_CELLS, -(-n // cell)), k=k))

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _matrix(part["embedding"])
            codes, length, residual = book.value.encode(x)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            yield part.assign(cell=book.value.nearest_cells(x, 1)[:, 0], code=[row.tobytes() for row in codes[:, ::2] | codes[:, 1::2] << 4], length=length, residual=residual)

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(cells=list(book.value.nearest_cells(_matrix(part["embedding"]), book.value.probes)))

    indexed = table(map_frames(own, index, f"vec_id {kind}, embedding array<double>, cell int, code binary, length double, residual double"))
    asked = own.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = table(map_frames(asked, probe, f"vec_id {kind}, embedding array<double>, cells array<int>").select("vec_id", "embedding", F.explode("cells").alias("cell")))
    # How many blocks and chunks each cell is dealt into: a row for each of at most MOST_CELLS cells.
    dealt = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "cell")
    dealt = F.broadcast(table(dealt))
    part_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = indexed.join(dealt, "cell").withColumn("block", part_of("blocks")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("blocks", "chunks")
    right = asked.join(dealt, "cell").withColumn("chunk", part_of("chunks")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks", "chunks")
    small_batches(spark)

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _nearest(book.value, x, q, k, depth)

    at = ["cell", "block", "chunk"]
    found = left.groupBy(at).cogroup(right.groupBy(at)).applyInPandas(meet, f"query_id {kind}, vec_id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    out = table(once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    drop(indexed, asked)
    return out


def _nearest(book: Codebook, x: pd.DataFrame, q: pd.DataFrame, k: int, depth: int) -> pd.DataFrame:
    """The k nearest other vectors of a block for each query."""
    x = x.sort_values("vec_id", kind="stable")
    own, vectors, length, residual = x["vec_id"].to_numpy(), _matrix(x["embedding"]), x["length"].to_numpy(), x["residual"].to_numpy()
    packed = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
    codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(x), -1)[:, : len(book.words)].T.copy()
    out = []
    for lo in range(0, len(q), 128):
        ids, asked = q["vec_id"].to_numpy()[lo : lo + 128], _matrix(q["embedding"].iloc[lo : lo + 128])
        tables = book.lookup(asked)
        score = np.zeros((len(asked), len(own)))
        for g in range(len(codes)):
            score += tables[:, g][:, codes[g]]
        far = np.sqrt(np.maximum((asked**2).sum(1)[:, None] + length - 2 * score, 0.0))
        for i in range(len(asked)):
            first = np.argpartition(far[i], depth)[:depth] if len(own) > depth else np.arange(len(own))
            near, ranked = _exact(vectors, own, asked[i], ids[i], first, k)
            if len(own) > depth:
                limit = ranked[k - 1] if len(near) >= k else np.inf
                more = np.flatnonzero(far[i] - residual <= limit * (1 + 1e-9))
                near, ranked = _exact(vectors, own, asked[i], ids[i], np.union1d(more, first), k)
            out.append(pd.DataFrame({"query_id": ids[i], "vec_id": near, "score": ranked}))
    return pd.concat(out, ignore_index=True)


def _exact(vectors: np.ndarray, own: np.ndarray, q: np.ndarray, asked: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest of some rows, an id once and never the query's own."""
    rows = rows[own[rows] != asked]
    far = np.sqrt(((vectors[rows] - q) ** 2).sum(1))
    order = np.lexsort((far, own[rows]))
    order = order[np.concatenate([[True], own[rows][order][1:] != own[rows][order][:-1]])] if len(order) else order
    order = order[np.lexsort((own[rows][order], far[order]))][:k]
    return own[rows][order], far[order]
