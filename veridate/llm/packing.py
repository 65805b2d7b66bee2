"""Order-preserving packing of documents into training sequences.

Each task lays the ids of its documents end to end, in the order in which Spark
reads them, and cuts the line into sequences of at most `window` ids by dynamic
programming.  Cuts may fall at the end of a document (free), at the end of a
sentence (`sentence_penalty` ids) or, within a run of more than `window` ids that has
neither, at each quarter of a window (`hard_penalty` ids); a sequence costs its
padding, which is none at a power of two.  With f(i) the least cost of cutting at point i, a full-window sequence to
point j costs f(i) + window - (p_j - p_i), so that the best i is the least
f(i) + p_i within reach: a monotone queue gives it in constant time.

The line is planned about a million characters at a time; all but the last
sequence of a plan are final, and the last one's ids open the next plan.  No rows
are shuffled, and a task holds one plan.

A null text counts as empty: its document is the end id alone.  Repeated rows are
packed each on its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veridate.llm.common import map_batches
from veridate.llm.tokens import encoder
from veridate.llm.words import batches


#: Characters whose ids are planned together.
PLANNED = 1_000_000


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id of a vocabulary with word ends whether it closes a sentence."""
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        ends[i] = token.endswith("</w>") and token[:-4][-1:] in (".", "!", "?")
    return ends


def plan(points: np.ndarray, penalties: np.ndarray, window: int, least_power: int = 256) -> list[int]:
    """Indexes of the cut points (the first and last included) of the cheapest cutting; gaps between points are at most `window`."""
    n, pos = len(points), points.tolist()
    exact: dict[int, list[int]] = {}
    size = least_power
    while size < window:
        at = np.searchsorted(points, points - size)
        for j in np.flatnonzero((points >= size) & (points[at] == points - size)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size *= 2
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(pos[0] + 0.0, 0)])
    pen = penalties.tolist()
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        key, i = queue[0]
        best = key + window - p
        for k in exact.get(j, ()):
            if cost[k] <= best:
                best, i = cost[k], k
        cost[j] = best = best + pen[j]
        back[j] = i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Line:
    """Ids of a task's documents, not yet packed."""

    def __init__(self, ends: np.ndarray, window: int, sentence_penalty: float, hard_penalty: float):
        self.ends, self.window, self.sentence, self.hard = ends, window, sentence_penalty, hard_penalty
        self.ids = np.zeros(0, np.uint32)
        self.names: list = []
        self.at = np.zeros(0, np.int64)  # where each document starts on the line; below 0 if a part is packed
        self.size = np.zeros(0, np.int64)

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.names, self.ids, self.size = self.names + names, np.concatenate([self.ids, ids]), np.concatenate([self.size, sizes])

    def _points(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        penalty = np.full(n + 1, -1.0)
        step = max(1, self.window // 4)
        penalty[1:][self.ends[self.ids]] = self.sentence
        penalty[self.at[self.at > 0]] = 0
        penalty[[0, n]] = 0
        soft = np.flatnonzero(penalty >= 0)
        for a, gap in zip(soft[:-1].tolist(), np.diff(soft).tolist(), strict=True):
            if gap > self.window:
                penalty[a + step : a + gap : step] = self.hard
        points = np.flatnonzero(penalty >= 0)
        return points, penalty[points]

    def pack(self, last: bool) -> tuple[pd.DataFrame, int]:
        """Pieces of the sequences that are final, and how many sequences they make."""
        if not len(self.ids):
            return pd.DataFrame(), 0
        points, penalties = self._points()
        cuts = points[plan(points, penalties, self.window)]
        if not last:
            cuts = cuts[:-1]
        stop = int(cuts[-1])
        a = np.union1d(cuts, self.at[(self.at > 0) & (self.at < stop)])
        a, b = a[:-1], a[1:]
        doc, seq = np.searchsorted(self.at, a, "right") - 1, np.searchsorted(cuts, a, "right") - 1
        raw, length = self.ids[:stop].astype("<u4").tobytes(), np.diff(cuts)
        whole = (length & (length - 1)) == 0
        pieces = pd.DataFrame({
            "doc_id": pd.Series([self.names[d] for d in doc.tolist()], dtype="object"),
            "start": a - self.at[doc],
            "length": b - a,
            "ids_crc32": [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
            "doc_tokens": self.size[doc],
            "sequence_id": seq,
            "offset": a - cuts[seq],
            "padded_length": np.where(whole, length, self.window)[seq],
        })
        keep = int(np.searchsorted(self.at + self.size, stop, "right"))
        self.names, self.size, self.at, self.ids = self.names[keep:], self.size[keep:], self.at[keep:] - stop, self.ids[stop:]
        return pieces, len(cuts) - 1


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, sentence_penalty: float = 4, hard_penalty: float = 64) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, "words")
        line = Line(sentence_ends(tokenizer), window, sentence_penalty, hard_penalty)
        sequence = TaskContext.get().partitionId() << 32

        def done(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal sequence
            pieces, many = line.pack(last)
            if len(pieces):
                yield pieces.assign(sequence_id=pieces["sequence_id"] + sequence)
            sequence += many

        for part in parts:
            names = part["doc_id"]
            for base, texts in batches([t or "" for t in part["text"]], PLANNED):
                ids, at = enc.encode(texts)
                line.add(names[base : base + len(texts)], np.insert(ids, at[1:], end_id), np.diff(at) + 1)
                yield from done(False)
        yield from done(True)

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")
