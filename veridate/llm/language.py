"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of a bounded sample of
its labelled texts.  A text is compressed whole with every dictionary, and the
language whose dictionary gives the fewest bytes wins; where the runner-up needs hardly
more bytes for the length of the text, the text is rejected.

Nulls and edge cases: a null text, an empty text or one without a letter gives
``und`` with score 0 and is rejected.  Equal sizes go to the language with more
labelled texts, then to the smaller name.  Without any labelled text everything
is ``und``.  Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridate.llm.common import filter_batches, map_batches

_LETTER = re.compile(r"[^\W\d_]")
#: Share by which the runner-up has to be longer.
MARGIN = 0.02
#: ASCII bytes other than letters become a space, so that layout and markup cost every language the same.
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-case UTF-8 with ASCII digits and marks blanked and runs of blanks as one."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split())


@dataclass
class Model:
    """Dictionaries by language, most labelled texts first."""

    languages: list[str]
    contents: list[bytes]
    level: int = 5


def fit(labelled: DataFrame, per_language: int = 240, longest: int = 20_000, dictionary_bytes: int = 112_000) -> Model:
    """Dictionaries from `labelled` (text, lang).

    The sample is bounded: of each language, the `per_language` different texts of at
    most `longest` characters with the smallest hash, whole, until `dictionary_bytes` are
    full.  A first pass counts the texts of each language, so that the second drops all but
    about twice as many as are wanted before it moves any.
    """
    usable = labelled.where("lang is not null and text is not null").select("lang", "text").withColumn("h", F.xxhash64("text"))
    fits = F.length("text").between(1, longest)
    figures = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(fits, F.col("h"))).alias("texts")).collect()
    counts = {r.lang: r.n for r in figures}
    share = {r.lang: min(1.0, (2 * per_language + 100) / max(1, r.texts)) for r in figures}
    if not share:
        return Model([], [])
    wanted = F.create_map(*(F.lit(x) for item in share.items() for x in item))[F.col("lang")]
    few = usable.where(fits & (F.pmod("h", F.lit(1 << 24)) < wanted * (1 << 24))).groupBy("lang", "h").agg(F.first("text").alias("text"))
    ranked = few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "text"))), 1, per_language).alias("texts"))
    texts: dict[str, list[bytes]] = {}
    for r in ranked.collect():
        texts[r.lang] = [normal(t.text) for t in r.texts if _LETTER.search(t.text)]
    texts = {k: v for k, v in texts.items() if v}
    languages = sorted(texts, key=lambda k: (-counts[k], k))
    contents = []
    for k in languages:
        kept, size = [], 0
        for one in dict.fromkeys(texts[k]):
            if size < dictionary_bytes:
                kept.append(one)
                size += len(one) + 1
        contents.append(b" ".join(kept)[:dictionary_bytes])
    return Model(languages, contents)


class Coder:
    def __init__(self, model: Model):
        import zstandard as z

        self.model, self.coders = model, []
        for raw in model.contents:
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            self.coders.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and by which share of its own bytes the runner-up is longer."""
        if not text or not self.coders or not _LETTER.search(text):
            return "und", 0.0, 0.0
        raw = normal(text)
        sizes = [len(c.compress(raw)) for c in self.coders]
        best = min(sizes)
        score = 1 / sum(2.0 ** (best - s) for s in sizes)
        margin = sorted(sizes)[1] / best - 1 if len(sizes) > 1 else 1.0
        return self.model.languages[sizes.index(best)], score, margin


def identify(docs: DataFrame, model: Model, least_margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of each row of docs (doc_id, text).

    rejected: no letter, or the runner-up is longer by less than the share `least_margin`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[dict[str, list]]) -> Iterator[pd.DataFrame]:
        coder = Coder(shared.value)
        for part in parts:
            found = [coder(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": pd.Series(part["doc_id"], dtype="object"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "margin": [f[2] for f in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, margin double")
    return scored.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < least_margin))


def keep_identified(docs: DataFrame, model: Model, least_margin: float = MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, that `identify` does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(parts: Iterator[list]) -> Iterator[list[bool]]:
        coder = Coder(shared.value)
        for texts in parts:
            yield [lang != "und" and margin >= least_margin for lang, _, margin in map(coder, texts)]

    return filter_batches(docs, "text", keep)
