"""Text quality by support vectors over naive Bayes features.

Features are indicators of hashed n-grams: words and word pairs in lower case,
windows of three characters with letters and digits reduced to their class, and
windows of four words reduced to which of them are the same.  Each
indicator is scaled by the log ratio of its smoothed document frequencies in the two
classes; a linear classifier with hinge loss is then fitted by dual coordinate descent,
drawn part of the way to its mean weight, and a logistic curve fitted on held-back rows
turns its margin into a score between 0 and 1.

The fit takes a bounded sample of labels (the `most` rows whose ids have the
smallest hashes, without texts of over `longest` characters); scoring takes every
whole text.

Nulls and edge cases: a null text counts as empty; an empty text has no features
and gets the score of the bias alone.  Rows without a label teach nothing.  With
labels of one class only, every score is that class's.  Repeated rows give repeated
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridate.llm.common import map_batches
from veridate.llm.words import DIGIT, LETTER, UPPER, Spans, batches, join, mix, tables, words

_U = np.uint64


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text and where each text's begin (one more entry than texts)."""
    w = words(texts)
    pairs, at = w.windows(2)
    kinds, _ = tables()
    cp, starts = join(texts)
    kind = kinds[cp]
    shape = np.where(kind & DIGIT, 1, np.where(kind & LETTER, np.where(kind & UPPER, 2, 3), cp)).astype(np.uint32)
    first = np.arange(max(0, len(cp) - 3))
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(first)]
    first = first[first + 3 < starts[owner + 1]]
    grams = Spans(shape).hash(first, first + 3)
    _, four = w.windows(4)
    turns = np.zeros(len(four), np.uint64)  # for each word of a window the place of the first one equal to it
    for i in range(1, 4):
        same = np.full(len(four), i)
        for j in range(i - 1, -1, -1):
            same[w.hash[four + i] == w.hash[four + j]] = j
        turns = turns * _U(4) + same.astype(np.uint64)
    h = np.concatenate([w.hash, mix(pairs + _U(1)), mix(grams + _U(2)), mix(turns + _U(1 << 32))])
    doc = np.concatenate([w.doc, w.doc[at], np.repeat(np.arange(len(texts)), np.diff(starts))[first], w.doc[four]])
    code = np.unique(doc.astype(np.int64) << bits | (h >> _U(64 - bits)).astype(np.int64))
    return (code & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(code, np.arange(len(texts) + 1) << bits)


@dataclass
class Model:
    weights: np.ndarray  #: of each feature, ratios included
    bias: float
    slope: float
    offset: float
    bits: int

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for base, part in batches(texts):
            f, at = features(part, self.bits)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[f])])
            margin = sums[at[1:]] - sums[at[:-1]] + self.bias
            out[base : base + len(part)] = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))
        return out


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: float, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss, each dual variable between 0 and c: weights of the scaled indicators, and the bias (a constant feature).

    rows: feature numbers of each text; values: the scale of each feature; y: -1 or 1.
    """
    rng = np.random.default_rng(1)
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    x = [values[r] for r in rows]
    norm = np.array([v @ v + 1 for v in x])
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            step = min(max(alpha[i] - gradient / norm[i], 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * x[i]
                bias += step * y[i]
                most = max(most, abs(gradient))
        if most < 0.05:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins and labels, by damped Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g, s = p - target, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, longest: int = 30_000, bits: int = 20, c: float = 0.1, beta: float = 0.25, smooth: float = 1.0) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, quality 0 or 1)."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    for salts in (256, 1):  # the smallest hashes of shares first, so that one task never gets all
        by_hash = Window.partitionBy(F.pmod("h", F.lit(salts))).orderBy("h", "quality")
        chosen = chosen.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= most)
    # At most `most` rows of three numbers, whatever the size of the tables.
    usable = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")

    def extract(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for base, texts in batches(part["text"]):
                f, at = features(texts, bits)
                yield pd.DataFrame({"h": part["h"][base : base + len(texts)], "quality": part["quality"][base : base + len(texts)], "features": [f[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})

    rows = map_batches(usable.select("h", "text", "quality"), extract, "h long, quality int, features binary").collect()
    rows.sort(key=lambda r: (r.h, r.quality, r.features))
    if not rows:
        return Model(np.zeros(1 << bits), 0.0, 1.0, 0.0, bits)
    x, y = [np.frombuffer(r.features, np.int32) for r in rows], np.array([1.0 if r.quality else -1.0 for r in rows])
    if abs(y.sum()) == len(y):
        return Model(np.zeros(1 << bits), 0.0, 1.0, 4.0 * float(y[0]), bits)

    def ratios(use: np.ndarray) -> np.ndarray:
        p, q = (smooth + np.bincount(np.concatenate([np.zeros(0, np.int32), *(x[i] for i in np.flatnonzero(use & (y == side)))]), minlength=1 << bits) for side in (1.0, -1.0))
        return np.log(p / (np.sum(use & (y > 0)) + 2 * smooth)) - np.log(q / (np.sum(use & (y < 0)) + 2 * smooth))

    def solve(use: np.ndarray) -> tuple[np.ndarray, float]:
        r, at = ratios(use), np.flatnonzero(use)
        w, bias = descend([x[i] for i in at], r, y[at], c)
        used = w != 0
        mean = np.abs(w[used]).mean() if used.any() else 0.0
        return (beta * w + (1 - beta) * mean) * r * used, bias

    back = np.arange(len(y)) % 4 == 0  # held back for the logistic curve
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    w, bias = solve(~back)
    check = back if back.any() else ~back
    margin = np.array([w[x[i]].sum() + bias for i in np.flatnonzero(check)])
    slope, offset = logistic(margin, y[check])
    return Model(w, bias, slope, offset, bits)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            s = shared.value.score([t or "" for t in part["text"]])
            yield pd.DataFrame({"doc_id": pd.Series(part["doc_id"], dtype="object"), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")
