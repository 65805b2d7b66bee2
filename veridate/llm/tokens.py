"""Exact tokenisation of large text batches through the tokenizers library.

Byte-pair merges never cross pre-token borders, so the ids of a text are the
concatenated ids of its pre-tokens.  Each distinct pre-token goes through the
library once per worker; a hash table then serves its repeats, where a hit must agree
in a 64-bit hash and in the length and sum of the characters.  Pre-token borders
come from character classes for texts whose characters all lie in a range where
those classes are known to agree with the library's patterns; a text with any
other character, or with an apostrophe (contractions), is encoded whole by the
library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from veridate.llm.words import DIGIT, LETTER, SPACE, Spans, batches, join, tables

#: Characters with which the class rules below equal the library's own splitting and normalisation.
UNSURE = re.compile("[^\t\n\r\x20-\x26\x28-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
_SLOTS = 1 << 20
#: Kind of run of each combination of class bits: 0 white space, 1 letters, 2 digits, 3 others.
_RUNS = np.array([0 if b & SPACE else 2 if b & DIGIT else 1 if b & LETTER else 3 for b in range(256)], np.uint8)
_loaded: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, style: str) -> "Encoder":
    """One encoder for each file and Python worker."""
    if (path, style) not in _loaded:
        _loaded[path, style] = Encoder(path, style)
    return _loaded[path, style]


class Encoder:
    """style: "words" (lower case, white space dropped, single digits) or "bytes" (a space joins the run after it)."""

    def __init__(self, path: str, style: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks use all cores already; threads of the library only add memory and time
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.style = style
        self.break_id = self.library.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.checks = np.zeros(_SLOTS, np.uint32)
        self.entry = np.zeros(_SLOTS, np.int32)
        self.size = np.zeros(1 << 16, np.int64)
        self.at = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each pair of hashes, or -1."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(left):
            k = self.keys[slot]
            hit = (k == h[left]) & (self.checks[slot] == check[left])
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (k != 0)
            left, slot = left[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pre-tokens and how many each has.

        In style "bytes" those without white space at their end go through the library as one text with
        line breaks between: a break is a pre-token of its own there, and its id ends the ids of one of ours.
        """
        sizes, flat = np.zeros(len(strings), np.int64), np.zeros(0, np.uint32)
        lined = [i for i, x in enumerate(strings) if not x[-1].isspace()] if self.style == "bytes" and len(self.break_id) == 1 else []
        if lined:
            ids = np.array(self.library.encode("\n".join([strings[i] for i in lined]) + "\n", add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(ids == self.break_id[0])
            if len(stops) != len(lined):
                lined = []
            else:
                sizes[lined] = np.diff(stops, prepend=-1) - 1
                flat = np.delete(ids, stops)
        if len(lined) == len(strings):
            return flat, sizes
        rest = np.ones(len(strings), bool)
        rest[lined] = False
        single = [e.ids for e in self.library.encode_batch_fast([strings[i] for i in np.flatnonzero(rest).tolist()], add_special_tokens=False)]
        sizes[rest] = np.fromiter(map(len, single), np.int64, len(single))
        out = np.zeros(int(sizes.sum()), np.uint32)
        of = np.repeat(rest, sizes)
        out[~of], out[of] = flat, np.fromiter((x for one in single for x in one), np.uint32)
        return out, sizes

    def _add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(h), len(ids)
        while self.n + n > len(self.size):
            self.size, self.at = np.concatenate([self.size, self.size]), np.concatenate([self.at, self.at])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.size[self.n : self.n + n] = sizes
        self.at[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = ids
        todo, slot = np.arange(n), (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(todo):  # of those that want one free slot the first gets it, the others go on
            free = self.keys[slot] == 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[free], return_index=True)[1]] = True
            won = np.flatnonzero(free)[first[: free.sum()]]
            self.keys[slot[won]] = h[todo[won]]
            self.checks[slot[won]] = check[todo[won]]
            self.entry[slot[won]] = self.n + todo[won]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, slot = todo[stay], (slot[stay] + 1) & (_SLOTS - 1)
        self.n, self.used = self.n + n, self.used + total

    def _borders(self, kind: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every pre-token in the joined code points (0: end of a text)."""
        new = np.ones(len(kind) + 1, bool)
        new[1:-1] = kind[1:] != kind[:-1]
        if self.style == "words":
            new[:-1] |= kind == 2
        edge = np.flatnonzero(new)
        start, end, k = edge[:-1].copy(), edge[1:].copy(), kind[edge[:-1]]
        if self.style == "words":
            keep = (k == 1) | (k == 2) | (k == 3)
            return start[keep], end[keep]
        space = np.flatnonzero((k == 0) & (np.append(k[1:], 4) != 4))  # runs of white space before something else
        last = end[space] - 1
        joins = cp[last] == 0x20
        start[space[joins] + 1] -= 1
        end[space] = last
        alone = last[~joins]
        start, end = np.concatenate([start, alone]), np.concatenate([end, alone + 1])
        keep = (np.concatenate([k, np.zeros(len(alone), k.dtype)]) != 4) & (end > start)
        order = np.argsort(start[keep], kind="stable")
        return start[keep][order], end[keep][order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in text order, and where each text's ids start (one more entry than texts)."""
        sizes, parts = np.zeros(len(texts), np.int64), []
        for base, part in batches(texts):
            odd = [i for i, t in enumerate(part) if UNSURE.search(t)]
            plain = part if not odd else [("" if UNSURE.search(t) else t) for t in part]
            ids, counts = self._encode_plain(plain)
            if odd:
                whole = {i: np.array(e.ids, np.uint32) for i, e in zip(odd, self.library.encode_batch_fast([part[i] for i in odd], add_special_tokens=False), strict=True)}
                cut, pieces = np.concatenate([[0], np.cumsum(counts)]), []
                for i in range(len(part)):
                    pieces.append(whole[i] if i in whole else ids[cut[i] : cut[i + 1]])
                    counts[i] = len(pieces[-1])
                ids = np.concatenate(pieces)
            sizes[base : base + len(part)] = counts
            parts.append(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, starts = join(texts)
        kinds, lower = tables()
        kind = _RUNS[kinds[cp]]
        kind[starts[1:] - 1] = 4
        begin, end = self._borders(kind, cp)
        folded = lower[cp] if self.style == "words" else cp
        h = Spans(folded).identity(begin, end)
        h[h == 0] = 1
        sums = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(folded, out=sums[1:])
        check = ((sums[end] - sums[begin]) * 31 + end - begin).astype(np.uint32)
        if self.n > _SLOTS // 2:
            self.clear()
        found = self._find(h, check)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            miss = miss[np.lexsort((check[miss], h[miss]))]
            new = np.ones(len(miss), bool)
            new[1:] = (h[miss[1:]] != h[miss[:-1]]) | (check[miss[1:]] != check[miss[:-1]])
            at = miss[new]
            joined = "\0".join(texts)
            strings = [joined[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            self._add(h[at], check[at], *self._ids(strings))
            found[miss] = self._find(h[miss], check[miss])
        size = self.size[found].astype(np.int64)
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(self.at[found] - (stop - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], stop])[np.searchsorted(begin, starts)]
        return ids, np.diff(upto)
