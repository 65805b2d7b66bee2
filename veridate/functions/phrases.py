"""Which of many phrases a text holds, in one pass: an Aho-Corasick automaton over code points, built once a worker, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_built: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of these phrases; its values are the first index of each."""
    if phrases not in _built:
        made = ahocorasick.Automaton()
        for i in reversed(range(len(phrases))):
            made.add_word(phrases[i], i)
        made.make_automaton()
        _built[phrases] = made
    return _built[phrases]


def hits(text: Column, phrases: Sequence[str]) -> Column:
    """Indexes of the phrases that stand anywhere in a text, ascending; null for null.  Phrases are not empty; case counts."""
    known = tuple(phrases)

    @F.pandas_udf("array<int>")
    def scan(texts: pd.Series) -> pd.Series:
        find = automaton(known).iter
        return texts.map(lambda t: sorted({i for _, i in find(t)}), na_action="ignore")

    return scan(text)
