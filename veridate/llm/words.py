"""Vectorised word and window hashing for batches of texts.

Texts are laid end to end as one array of code points; words, their hashes and
the hashes of word windows then come from whole-array numpy operations, a few
nanoseconds a character, with no Python work for each word.  A *word* is a
maximal run of ``\\w`` characters, compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

WORD, DIGIT, UPPER, LETTER, SPACE, END, CAPITAL = 1, 2, 4, 8, 16, 32, 64
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Characters of a span up to which the polynomial hash is safe as an identity.
PLAIN = 128
#: Characters of the texts that are laid end to end at a time.
BATCH = 250_000
_tables: tuple[np.ndarray, np.ndarray] | None = None
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and the one-character lower case of every code point."""
    global _tables
    if _tables is None:
        kinds = np.zeros(0x110000, np.uint8)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                kinds[i] = WORD | (LETTER if c.isalpha() else 0) | (DIGIT if c.isdigit() else 0) | (UPPER if c.isupper() else 0)
                low = c.lower()
                if len(low) == 1:
                    lower[i] = ord(low)
            elif c.isspace():
                kinds[i] = SPACE
        kinds[ord("_")] |= WORD
        for c in ".!?":
            kinds[ord(c)] |= END
        kinds[ord("\n")] |= END
        _tables = kinds, lower
    return _tables


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        _powers.clear()
        for b in (_BASE, _BASE_INV):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            _powers.append(np.cumprod(row, dtype=np.uint64))
    return _powers[0], _powers[1]


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one zero, and where each text starts (one more entry than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, starts


class Spans:
    """Hashes of arbitrary spans of an array of code points."""

    def __init__(self, cp: np.ndarray):
        self.cp = cp
        up, self.down = powers(len(cp) + 1)
        self.sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + _U(0x632BE59BD9B4E019)) * up[: len(cp)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For keys whose hits are compared: a polynomial modulo 2**64, which long periodic texts can fool."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def identity(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For values that stand for the span itself: longer spans, which the polynomial might confuse, go through xxh3."""
        h = self.hash(start, end)
        for i in np.flatnonzero(end - start > PLAIN).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.cp[start[i] : end[i]].tobytes())
        return h


@dataclass
class Words:
    """Words of a batch: hash, owning text, and code-point span within that text."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: index of each text's first word; one more entry than texts
    flags: np.ndarray  #: class bits of the word's first character; END where a sentence starts, CAPITAL for an upper-case letter not followed by another

    def windows(self, n: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n successive words of one text, and the index of each window's first word."""
        h = self.hash if values is None else values
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :])
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            acc = acc * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return mix(acc[at]), at


def words(texts: list[str]) -> Words:
    kinds, lower = tables()
    cp, starts = join(texts)
    kind = kinds[cp]
    inside = (kind & WORD).astype(bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    doc = np.searchsorted(starts, begin, "right") - 1
    flags = kind[begin] & ~np.uint8(END)
    stops = np.concatenate([[0], np.cumsum((kind & END) > 0)])
    opens = np.ones(len(begin), bool)
    opens[1:] = (stops[begin[1:]] > stops[end[:-1]]) | (doc[1:] != doc[:-1])
    flags[opens] |= END
    second = kind[np.minimum(begin + 1, end - 1)]
    flags[((flags & UPPER) > 0) & ((end - begin == 1) | ((second & UPPER) == 0))] |= CAPITAL
    return Words(Spans(lower[cp]).identity(begin, end), doc, begin - starts[doc], end - starts[doc], np.searchsorted(begin, starts), flags)


def batches(texts: list[str], most: int = BATCH) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about `most` characters, with the index of the first; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def shingles(texts: list[str], n: int = 5, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-word windows of each text (all its words as one window if it has 1 to n - 1) and the text each belongs to, ordered by text and hash."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for base, part in batches(texts):
        w = words(part)
        h, at = w.windows(n)
        doc = w.doc[at]
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = [mix(np.array([hash_row(w.hash[w.first[d] : w.first[d + 1]])], np.uint64))[0] for d in short]
            h, doc = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        if distinct:
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
        found.append((h, doc + base))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def hash_row(h: Iterable[int]) -> int:
    """One 64-bit value for a short sequence of hashes."""
    acc = 0x243F6A8885A308D3
    for x in h:
        acc = (acc * 0x9E3779B97F4A7C15 + int(x)) & 0xFFFFFFFFFFFFFFFF
    return acc
