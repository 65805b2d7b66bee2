"""The stages of the pipeline on the smallest data, each held against its operator's meaning on its own input."""

import re

import corpus_pipeline
from veridate.llm.common import read, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns, before, counts = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = table(stage(spark, before, DATA))
        assert after.columns == columns
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        counts.append((name, before.count(), after.count()))
        before = after
    assert counts[0][2] >= 0.95 * counts[0][1]
    bench = [re.findall(r"\w+", r.text.lower()) for r in read(spark, DATA, "benchmark").collect()]
    for r in before.collect():
        text = " " + " ".join(re.findall(r"\w+", r.text.lower())) + " "
        assert not any(" " + " ".join(b) + " " in text for b in bench if len(b) >= 13)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in before.collect()} and (pieces.groupby("sequence_id").length.sum() <= 4096).all()
