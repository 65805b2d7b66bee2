"""Vector codes against exhaustive search, trees under ties and wide ranges, the query against its SQL, and edge cases."""

import hashlib
import os

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veridate.llm import gnat, queries

DATA = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.integers(1, 5), st.integers(0, 40), st.integers(2, 9), st.integers(0, 2**32 - 1))
def test_tree_equals_exhaustive_search(n, width, spread, degree, seed):
    rng = np.random.default_rng(seed)
    scale = 1 if spread < 20 else 10**6
    points = rng.integers(-spread, spread + 1, (n, width)) * scale
    asked = np.concatenate([points, rng.integers(-spread, spread + 1, (200, width)) * scale])
    entry, far = gnat.Gnat.build(points, degree).nearest(asked)
    squares = ((asked[:, None] - points[None]) ** 2).sum(-1)
    assert (entry == squares.argmin(1)).all() and (far == squares.min(1)).all()


def test_tree_skips_subtrees():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 100, (8, 4)) + 10_000 * i for i in range(8)])
    tree, seen = gnat.Gnat.build(points), []
    visit = gnat.Gnat._visit
    gnat.Gnat._visit = lambda self, asked, rows, best, least: (seen.append(len(rows)), visit(self, asked, rows, best, least))[1]
    try:
        tree.nearest(points)
    finally:
        gnat.Gnat._visit = visit
    assert sum(seen[1:]) <= len(points)  # of eight subtrees a query enters one


def slow(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    whole = np.array([[int(np.floor(256 * float(x))) for x in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    book = whole[:entries].swapaxes(0, 1).copy()
    codes = lambda: np.stack([((whole[:, p, None] - book[p][None]) ** 2).sum(-1).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        own = codes()
        for p in range(parts):
            for e in set(own[:, p].tolist()):
                book[p, e] = [sum(column) // len(column) for column in whole[own[:, p] == e, p].T.tolist()]
    own = codes()
    error = sum(((whole[:, p] - book[p, own[:, p]]) ** 2).sum(-1) for p in range(parts)).tolist()
    name = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{c:02x}" for c in own[i]), error[i], total[r[2]], name) for i, r in enumerate(kept))


def test_query_equals_contract_and_sql(spark):
    out = queries.op13_gnat_codes(spark, DATA)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(tuple(r) for r in out.collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == slow(rows)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{os.path.join(DATA, 'embeddings.parquet')}'")
    assert sorted(db.sql(queries.ORACLES["op13_gnat_codes"]).fetchall()) == got


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    some = lambda: [float(np.float32(x)) for x in rng.normal(0, 2, 32)]
    rows = [(i, some(), int(i % 3) if i % 7 else None) for i in range(90)]
    twin = rows[10][1]
    rows += [(200, twin, 1), (201, twin, None), (202, [0.0] * 32, 1), (-5, [-0.001] * 32, 2)]
    odd = [(300, None, 1), (301, [float("nan")] + twin[1:], 1), (302, [float("inf")] + twin[1:], None), (303, [None, *twin[1:]], 1), (304, [], 1), (305, [1.0] * 31, 1), (None, twin, 1), (306, [1e30] * 32, 1)]
    vectors = spark.createDataFrame([(i, v, label, "k", 1) for i, v, label in rows + odd], "vec_id long, embedding array<float>, label int, code string, n int")
    got = sorted(tuple(r) for r in gnat.digests(gnat.compress(vectors)).collect())
    assert got == slow(rows)
    few = rows[:5]
    assert sorted(tuple(r) for r in gnat.digests(gnat.compress(vectors.where("vec_id between 0 and 4"))).collect()) == slow(few)
    wide = spark.createDataFrame([(1, [1.0] * 16, 0), (2, [2.0] * 32, 0), (2, [2.0] * 32, 0)], "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.error, list(r.codes)) for r in gnat.compress(wide).orderBy("vec_id").collect()] == [(1, 0, [0] * 16), (2, 0, [0] * 16), (2, 0, [0] * 16)]
    assert not gnat.digests(gnat.compress(vectors.where("false"))).collect()
