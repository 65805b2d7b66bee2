"""Fingerprints against a bit-by-bit reading, components against all pairs, pivot tables and keys against their promise, and edge cases."""

import random
import re
from itertools import combinations

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from veridate.llm import links, queries, simhash
from veridate.llm.common import read

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    """{index: smallest index that links reach} over all pairs of distinct fingerprints."""
    top = {f: f for f in prints.values()}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for a, b in combinations(sorted(top), 2):
        if (a ^ b).bit_count() <= 3:
            top[find(a)] = find(b)
    least = {}
    for i, f in prints.items():
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: least[find(f)] for i, f in prints.items()}


@given(st.text(alphabet="aBcÉ \n ", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_query_equals_all_pairs_on_whole_table(spark):
    prints = {r.doc_id: slow_print(r.text) for r in read(spark, DATA, "documents").collect()}
    found = components(prints)
    out = queries.op12_simhash(spark, DATA)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, f"{f:016x}", found[i]) for i, f in prints.items())


def planted_prints(n=400):
    """Distinct fingerprints: chains, dense balls, pairs at three and four bits, and unrelated ones."""
    rnd, found = random.Random(5), set()
    centre = rnd.getrandbits(64)
    found |= {centre ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 5, 6) for _ in range(n // 5)}
    for _ in range(n):
        f = rnd.getrandbits(64)
        found |= {f, f ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice((3, 4, 4, 5))))}
    step = rnd.getrandbits(64)
    for _ in range(60):
        step ^= sum(1 << b for b in rnd.sample(range(64), 3))
        found.add(step)
    return sorted(found)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_links_equal_all_pairs(spark, monkeypatch):
    prints = planted_prints()
    found = components(dict(enumerate(prints)))
    fps = spark.createDataFrame([(signed(f),) for f in prints], "id long")
    for most in (simhash.PAIRS_A_MEMBER, 0):  # 0: every open key goes through finer keys and blocks
        monkeypatch.setattr(simhash, "PAIRS_A_MEMBER", most)
        monkeypatch.setattr(links, "BLOCK", 16)
        got = {r.id: r.component for r in simhash.linked(fps).collect()}
        mine = {}
        for i, f in enumerate(prints):
            mine.setdefault(found[i], set()).add(signed(f))
        expected = {frozenset(group) for group in mine.values() if len(group) > 1}
        groups = {}
        for i, c in got.items():
            groups.setdefault(c, set()).add(i)
        assert {frozenset(g) for g in groups.values()} == expected


def test_keys_and_table_lose_no_link(spark):
    rnd = random.Random(3)
    masks = simhash.block_masks(list(range(64)))
    assert len(masks) == 20 and all(m.bit_count() >= 31 for m in masks)
    near = []
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 3)))
        near.append((signed(a), signed(b)))
        first = next(m for m in masks if a & m == b & m)
        rest = simhash.block_masks([i for i in range(64) if not first >> i & 1])
        assert any((a ^ b) & f == 0 for f in rest)
    pairs = spark.createDataFrame(near, "id long, other long")
    left = simhash.pivot_table(pairs.select("id")).withColumnRenamed("sketch", "x").join(pairs, "id")
    both = left.join(simhash.pivot_table(pairs.selectExpr("other as id")).selectExpr("id as other", "sketch as y").distinct(), "other")
    assert both.where(simhash.near_in_table(both.x, both.y)).count() == both.count() >= 2000
    far = spark.createDataFrame([(signed(rnd.getrandbits(64)), signed(rnd.getrandbits(64))) for _ in range(2000)], "id long, other long")
    a = simhash.pivot_table(far.select("id")).collect()
    b = simhash.pivot_table(far.selectExpr("other as id")).collect()
    refs = simhash.references()
    for r in a[:50]:
        packed = [getattr(r.sketch, f"p{i // 7}") >> 8 * (i % 7) & 255 for i in range(21)]
        assert packed == [((r.id ^ ref) & (1 << 64) - 1).bit_count() for ref in refs]
    assert len(b) == 2000


def test_edge_cases(spark):
    rows = [(4, None), (3, ""), (9, " \n"), (5, "one two"), (6, "ONE\ttwo"), (7, "one two three four " * 300_000), (8, "one two three four " * 300_000), (None, "one two"), (None, "only here and nowhere else"), (1, "Ünlike"), (1, "Ünlike"), (2**60 + 1, "ünlike")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, fp int, component string")
    out = simhash.components(docs).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id) for r in out} == {(4, 3), (3, 3), (9, 3), (5, 5), (6, 5), (None, 5), (7, 7), (8, 7), (None, None), (1, 1), (2**60 + 1, 2**60 + 1)}
    assert not simhash.shown(simhash.components(docs.where("false"))).collect()
