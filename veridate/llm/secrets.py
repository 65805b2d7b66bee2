"""Secret scanning with patterns and inferred format grammars.

Fixed patterns find the base spans of every text.  The shapes (character classes) of a
bounded sample of the distinct values they find, by kind, are the labelled
credentials: each kind's sample becomes a prefix tree, whose statistically compatible
states are merged (Hoeffding bound on stop and transition frequencies, folding
subtrees as they meet) into a probabilistic automaton.  In every other run of credential
characters, whatever its make-up, each part that begins and ends at the run's edges or
beside a mark (``+ / _ . = -``) is a candidate: the automata walk from each such begin
and score each such end by likelihood.  A part whose shape is about as likely as the
least likely value of a kind's sample, and which is likelier by `bits` as a value of that format than as text
by the corpus's own pairs of characters, is reported as kind ``format``; of parts that
overlap the one with the largest difference stays.  Runs end at base spans.  Whole runs
may have any length; parts after a mark are no longer than the longest value of the
kind's sample.  A kind of few labelled values asks for more bits: `FEW` / n times as many.

No found value is written anywhere: the first pass keeps hashes and shapes, the
second one spans.

Nulls and edge cases: a null or empty text has no spans.  Spans count code points.
Repeated rows give repeated rows; other columns are ignored.  A corpus without base
spans yields no automata and no further spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import drop, map_batches, table

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A run that may be a credential: as many characters as the shortest value that teaches.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}", re.ASCII)
#: Marks beside which a value may begin and end.
MARK = re.compile(r"[+/_.=-]")
#: Labelled values from which a kind's automaton is trusted at `bits`; for fewer the bits grow in proportion.
FEW = 20
#: How many characters each class has.
_CLASS = {"h": 6, "l": 20, "U": 26, "d": 10}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the leftmost non-overlapping matches of each kind that are long enough."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def symbols(value: str) -> str:
    """Character classes: h (a-f), l (other lower case), U, d, and marks as they are."""
    return "".join("d" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "U" if c.isalpha() else c for c in value)


@dataclass
class State:
    count: int = 0
    stops: int = 0
    uses: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton inferred from shapes of values."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.states: list[State] = [State()]
        for v in values:
            at = 0
            for c in v:
                s = self.states[at]
                s.count += 1
                s.uses[c] = s.uses.get(c, 0) + 1
                if c not in s.to:
                    s.to[c] = len(self.states)
                    self.states.append(State())
                at = s.to[c]
            self.states[at].count += 1
            self.states[at].stops += 1
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.steps = [{c: (math.log2(n / s.count), s.to[c]) for c, n in s.uses.items()} for s in self.states]
        self.ends = [math.log2(max(s.stops, 0.5) / max(s.count, 1)) for s in self.states]
        self.doubt = max(1.0, FEW / max(1, len(values)))
        scores = [self.score(v) for v in values]
        self.least = float(min(scores) - np.std(scores)) if scores else 0.0  # values that taught nothing score a little lower
        sizes = sorted(map(len, values))
        self.shortest, self.longest = (sizes[len(sizes) // 100], sizes[-1]) if sizes else (0, 0)

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            if not p.count or not q.count:
                continue
            if self._differ(p.stops, p.count, q.stops, q.count):
                return False
            for c in p.uses.keys() | q.uses.keys():
                if self._differ(p.uses.get(c, 0), p.count, q.uses.get(c, 0), q.count):
                    return False
                if c in p.to and c in q.to:
                    todo.append((p.to[c], q.to[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add state b and the tree below it to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            p.count, p.stops = p.count + q.count, p.stops + q.stops
            for c, n in q.uses.items():
                p.uses[c] = p.uses.get(c, 0) + n
                if c in p.to:
                    todo.append((p.to[c], q.to[c]))
                else:
                    p.to[c] = q.to[c]

    def _merge(self) -> None:
        kept, seen = [0], {0}
        while True:
            edge = next(((a, c, b) for a in kept for c, b in sorted(self.states[a].to.items()) if b not in seen), None)
            if edge is None:
                return
            a, c, b = edge
            for k in kept:
                if self._compatible(k, b):
                    self.states[a].to[c] = k
                    self._fold(k, b)
                    break
            else:
                kept.append(b)
                seen.add(b)

    def score(self, shape: str) -> float:
        """Mean log2 likelihood of a shape and its end; -99 for a step that the automaton lacks."""
        at, total = 0, 0.0
        for c in shape:
            if c not in self.steps[at]:
                return -99.0
            bits, at = self.steps[at][c]
            total += bits
        return (total + self.ends[at]) / (len(shape) + 1)

    def accepted(self, shape: str, begin: int, ends: set[int], upto: int) -> Iterator[tuple[int, float]]:
        """(end, log2 likelihood) of the parts from `begin` to one of `ends`, not beyond `upto`, that score about as the sample does."""
        at, total = 0, 0.0
        for i in range(begin, upto):
            step = self.steps[at].get(shape[i])
            if step is None:
                return
            bits, at = step
            total += bits
            n = i + 1 - begin
            if n >= self.shortest and i + 1 in ends and (whole := total + self.ends[at]) / (n + 1) >= self.least:
                yield i + 1, whole


class Prose:
    """How likely pairs of successive characters are in the corpus."""

    def __init__(self, counts: np.ndarray):
        self.pairs = counts.reshape(128, 128) + 0.5
        self.firsts = self.pairs.sum(axis=1)

    def score(self, value: str) -> float:
        """log2 likelihood of a value of the corpus, without what it adds itself to the counts."""
        codes = np.frombuffer((" " + value).encode("ascii"), np.uint8)
        own, first = np.zeros((128, 128)), np.bincount(codes[:-1], minlength=128)
        np.add.at(own, (codes[:-1], codes[1:]), 1)
        seen = np.maximum(self.pairs[codes[:-1], codes[1:]] - own[codes[:-1], codes[1:]], 0.5)
        return float(np.log2(seen / np.maximum(self.firsts - first, 64)[codes[:-1]]).sum())


def _pairs(text: str, spans: list[tuple[int, int, str, str]]) -> np.ndarray:
    """Codes of successive characters, of which those beyond ASCII and in spans count as blanks."""
    codes = np.frombuffer(text.encode("ascii", "replace").replace(b"?", b" "), np.uint8).astype(np.int32)
    for a, b, _, _ in spans:
        codes[a:b] = ord(" ")
    return codes[:-1] * 128 + codes[1:]


def learn(docs: DataFrame, per_kind: int = 300, longest: int = 200) -> tuple[dict[str, Automaton], Prose]:
    """Automata by kind from a bounded sample (the shapes of the `per_kind` distinct values of up to `longest` characters with the smallest hashes), and the pairs of characters of all texts outside base spans."""

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << 14, np.int64)
        for part in parts:
            found = {}
            for text in part["text"]:
                spans = base_spans(text)
                for _, _, kind, value in spans:
                    if len(value) <= longest:
                        found[kind, xxhash.xxh3_64_intdigest(value) >> 1] = symbols(value)
                counts += np.bincount(_pairs(text, spans), minlength=1 << 14)
            yield pd.DataFrame([(k, h, s, 1) for (k, h), s in found.items()], columns=["kind", "h", "shape", "n"])
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"kind": "pair", "h": at, "shape": None, "n": counts[at]})

    seen = table(map_batches(docs.where("length(text) > 0").select("text"), run, "kind string, h long, shape string, n long"))
    counts = np.zeros(1 << 14, np.int64)
    for r in seen.where("kind = 'pair'").groupBy("h").agg(F.sum("n").alias("n")).collect():  # 16,384 rows at most
        counts[r.h] = r.n
    automata = {}
    for kind in KINDS[:3]:
        shapes = [r.shape for r in seen.where(F.col("kind") == kind).groupBy("h").agg(F.first("shape").alias("shape")).orderBy("h").limit(per_kind).collect()]
        if shapes:
            automata[kind] = Automaton(shapes)
    drop(seen)
    return automata, Prose(counts)


def segments(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters, without what lies in spans."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, b, _ in spans:
            if a < m.end() and at < b:
                if a > at:
                    yield at, a
                at = max(at, b)
        if at < m.end():
            yield at, m.end()


def formats(value: str, automata: list[Automaton], prose: Prose, bits: float) -> list[tuple[int, int]]:
    """(begin, end) of the parts of a run that have some kind's format, none over another."""
    shape = symbols(value)
    marks = [m.start() for m in MARK.finditer(value)]
    begins, ends = [0, *(i + 1 for i in marks)], {*marks, len(value)}
    found = []
    for x in automata:
        for begin in begins:
            if len(value) - begin < x.shortest:
                break
            for end, score in x.accepted(shape, begin, ends, len(value) if begin == 0 else min(len(value), begin + x.longest)):
                drawn = sum(math.log2(_CLASS.get(c, 1)) for c in shape[begin:end])
                gain = score - drawn - prose.score(value[begin:end]) - bits * x.doubt
                if gain >= 0:
                    found.append((-gain, begin, -end))
    kept: list[tuple[int, int]] = []
    for _, begin, end in sorted(found):
        if all(-end <= a or b <= begin for a, b in kept):
            kept.append((begin, -end))
    return sorted(kept)


def find(docs: DataFrame, per_kind: int = 300, bits: float = 16.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans) of each row of docs (doc_id, text).

    A part of a run is kind format if some automaton gives its shape at least the lowest score of its sample, less the
    scores' standard deviation, and the part is `bits` (of log2 likelihood) likelier as a random value of that shape than as text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, per_kind))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        automata, prose = list(shared.value[0].values()), shared.value[1]
        for part in parts:
            rows = []
            for text in part["text"]:
                spans = [s[:3] for s in base_spans(text or "")]
                kinds = [k for _, _, k in spans]
                base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
                runs = [(lo + a, lo + b, "format") for lo, hi in (segments(text or "", spans) if automata else ()) for a, b in formats(text[lo:hi], automata, prose, bits)]
                every = sorted([*spans, *runs], key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append((*(kinds.count(k) for k in KINDS[:3]), len(runs), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in every)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])
            out.insert(0, "doc_id", pd.Series(part["doc_id"], dtype="object"))
            yield out

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")
