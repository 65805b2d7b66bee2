"""Periodic runs against every period tried at every place, their digests against a plain reading of the contract, and edge cases."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veridate.llm import queries, runs
from veridate.llm.common import read

DATA = "/root/testdata/sf0.001"
SPACE = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least=6, times=4):
    """{(start, length): smallest period} by trying all periods."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(found):
    return [(r["start"], r["length"], r["period"]) for r in found]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=90), max_size=4), st.sampled_from([3, 4, 5]))
def test_equals_brute_force_on_small_alphabets(texts, times):
    found, _ = runs.runs_of([" ".join(t) for t in texts], 6, times)
    assert [plain(f) for f in found] == [brute(t, 6, times) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 9)), max_size=12))
def test_equals_brute_force_on_nested_periods(parts):
    words = [w for unit, n in parts for w in unit * n]
    found, left = runs.runs_of([" ".join(words)], 6, 4)
    expected = brute(words)
    assert plain(found[0]) == expected
    gone = {i for s, n, q in expected for i in range(s + q, s + n)}
    assert left == [" ".join(w for i, w in enumerate(words) if i not in gone)]


@given(st.lists(st.integers(0, 200), min_size=1, max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 200))
def test_wavelet_tree(values, a, b, x):
    lo, hi = sorted((min(a, len(values)), min(b, len(values))))
    one = lambda v: np.array([v])
    tree, part = runs.Wavelet(np.array(values), 8), sorted(values[lo:hi])
    under = sum(v < x for v in part)
    assert tree.below(one(lo), one(hi), one(x))[0] == under
    if under < len(part):
        assert tree.nth(one(lo), one(hi), one(under))[0] == part[under]


def contract(doc_id, text):
    words = SPACE.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_contract_on_whole_table(spark):
    out = queries.op11_periodic_runs(spark, DATA)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == sorted(contract(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect())


def test_edge_cases(spark):
    unit = "a b c d e"
    long = " ".join(f"w{i * i % 9973}" for i in range(150_000)) + " x y" * 20_000
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "a b"), (5, "a " * 5), (6, "a " * 6), (7, f"{unit} " * 4), (7, f"{unit} " * 4), (None, "\n".join([unit] * 4) + " z"), (8, "A a " * 9), (9, long), (2**60 + 1, "é \U0001f600 " * 4)]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, runs string, period int")
    found = runs.find(docs)
    got = [tuple(r) for r in runs.digests(found).collect()]
    expected = [(i, *contract(None, t)[1:]) for i, t in rows if i != 9]
    assert sorted((r for r in got if r[0] != 9), key=repr) == sorted(expected, key=repr)
    assert [plain(r.runs) for r in found.where("doc_id = 9").collect()] == [[(0, 150_000, 9973), (150_000, 40_000, 2)]]
    assert not runs.digests(runs.find(runs.planted(docs.where("false")))).collect()
    assert {(r.doc_id, r.text) for r in runs.planted(docs.where("doc_id is null or text is null")).collect()} == {(i, t) for i, t in rows if i is None or t is None}
    with pytest.raises(ValueError):
        runs.runs_of(["a b"], 6, 2)
