"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns and no rows, and on the smallest data against brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridate.llm import dartminhash, decontaminate, language, linededup, neighbours, packing, quality, queries, secrets, simple8b, suffixes
from veridate.llm.common import read

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} tail{i % 31}." for i in range(20_000))
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, BASE, "x"), (2, BASE, "x"), (2, BASE, "x"), (3, BASE.replace("w30", "w3"), None), (4, None, None), (None, "", "y"), (None, "alone in the world with words", "y"), (5, "###", "z"), (6, "###", "z"), (7, LONG, "z"), (8, "one two", "z"), (2**60 + 1, "Two words here.\n" + BASE, "z")]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "k", 0.5, 1) for i, t, s in ROWS], "doc_id long, text string, source string, key string, score double, class int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_near_duplicates(docs, empty):
    found = dartminhash.classes(docs).collect()
    assert len(found) == len(ROWS) and not dartminhash.classes(empty).collect()
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == by[3] == {1} and by[5] == by[6] == {5} and by[4] == {4} and by[8] == {8} and by[None] == {None}
    assert sum(r.kept for r in found if r.class_id == 1) == 1
    assert by[2**60 + 1] == {1}


def test_near_duplicates_brute_force(spark):
    got = {r.doc_id: r.class_id for r in queries.op4_dartminhash(spark, DATA).collect()}
    sets = {}
    for r in read(spark, DATA, "documents").collect():
        w = re.findall(r"\w+", r.text.lower())
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in ids}


def test_line_dedup(docs, empty, spark):
    out = linededup.dedup(docs)
    assert set(out.columns) >= {"doc_id", "text", "source", "key", "score", "class", "n_lines", "n_removed", "all_removed"}
    found = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert found[1].text == BASE and found[2].all_removed and found[3].all_removed and found[2**60 + 1].text == "Two words here."
    assert found[4].text is None and found[5].text == "###" and found[7].text == LONG and out.count() == len(ROWS) and found[1]["key"] == "k"
    assert not linededup.dedup(empty).collect()
    lines = spark.createDataFrame([(1, "the quick brown fox jumps over it\nshort\nshort"), (2, "short\nthe quick brown fax jumps  over it \nanother line that is long enough"), (3, "the quick brown fax jumps over its")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup(lines).collect()}
    assert got == {1: ("the quick brown fox jumps over it\nshort\nshort", 0), 2: ("short\nanother line that is long enough", 1), 3: ("", 1)}


def test_repeats(docs, empty, spark):
    found = {r.doc_id: r for r in suffixes.repeats(docs).collect()}
    assert set(found) == {1, 2, 2**60 + 1} and [tuple(s) for s in found[2**60 + 1].spans] == [(3, 63)] and found[1].repeated_words == 60
    assert not suffixes.repeats(empty).collect()
    got = {r.doc_id: r.repeated_words for r in queries.op3_suffixes(spark, DATA).collect()}
    texts = {r.doc_id: re.findall(r"\w+", r.text.lower()) for r in read(spark, DATA, "documents").collect()}
    where = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    expected = {}
    for i, w in texts.items():
        marked = {p for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for p in range(k, k + 50)}
        if marked:
            expected[i] = len(marked)
    assert got == expected


def test_decontamination(docs, empty, spark):
    q = "A train leaves Paris at 7 and goes 40 km to the town of Lille while Anna waits 7 minutes."
    items = spark.createDataFrame([(1, q, "a"), (2, "what is this thing called now", "a"), (3, None, "a"), (None, "", "a")], "item_id long, text string, doc_id string")
    d = spark.createDataFrame([(1, "Well. " + q), (2, q.replace("Paris", "Rome").replace("7", "9").replace("40", "50")), (3, q.replace("waits 7", "waits 8")), (4, None), (None, "so what is this thing called now then"), (5, "nothing")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.matches(d, items).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 2, True)}
    assert not decontaminate.matches(empty, items).collect() and not decontaminate.matches(docs, items.where("false")).collect()


def test_quality(docs, empty, spark):
    out = queries.op2_quality(spark, DATA).join(read(spark, DATA, "labels").select("doc_id", "quality"), "doc_id")
    assert out.where("held_out and predicted = quality").count() >= 0.7 * out.where("held_out").count()
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 1), (8, 0), (99, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert not quality.score(empty, quality.fit(docs, labels.where("false"))).collect()


def test_language(docs, empty, spark):
    out = queries.op7_language(spark, DATA)
    right = out.join(read(spark, DATA, "documents"), "doc_id").where("held_out and lang_pred = lang").count()
    assert right >= 0.9 * out.where("held_out").count()
    model = language.Model(["en"], [b"word"])
    found = language.identify(docs, model).collect()
    assert len(found) == len(ROWS) and {r.lang_pred for r in found if r.doc_id in (4, 5, 6)} == {"und"} and 2**60 + 1 in {r.doc_id for r in found}
    assert language.keep_identified(docs, model).columns == docs.columns and not language.identify(empty, model).collect()
    assert language.fit(docs.selectExpr("text", "cast(null as string) lang")).languages == []


def test_packing(docs, empty):
    rows = packing.pack(docs, WORD, 2, window=256).collect()
    library = Tokenizer.from_file(WORD)
    library.encode_special_tokens = True
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and own[0].padded_length == (at if at & (at - 1) == 0 else 256)
    assert sum(r.length for r in rows) == sum(want)
    long = sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.start)
    assert [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1].tolist()]
    ids = [*library.encode(LONG, add_special_tokens=False).ids, 2]
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in long)
    assert not packing.pack(empty, WORD, 2).collect()


def test_token_files(docs, empty):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    start, expected = 0, []
    for i, t in sorted(((i, t or "") for i, t, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, simple8b.round_trip(docs, BYTE).collect()), key=lambda r: r[1]) == expected
    assert not simple8b.round_trip(empty, BYTE).collect()


def test_secrets(docs, empty, spark):
    rng = np.random.default_rng(3)
    value = lambda: "".join(rng.choice(list("0123456789ABCDEFGHJKMNPQRSTVWXYZ"), 24))
    rows = [(i, f"then token = {value()} and so on") for i in range(60)] + [(100, f"see {value()} here"), (101, "internationalisation of words"), (None, None)]
    found = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].n_assign == 1 for i in range(60)) and found[100].spans == "format:4:28" and found[101].spans == "" and found[None].n_hex == 0
    assert len(secrets.find(docs).collect()) == len(ROWS) and not secrets.find(empty).collect()


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x[10] = x[20] = x[30]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, 2.0]), (None, [1.0] * 6), (40, [float(v) for v in x[40]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in sorted(neighbours.search(df, F.col("vec_id") % 10 == 0, depth=20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [int(i) for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        hits += len(set(best) & {v for v, _ in found})
        assert len(found) == 10 and all(abs(d[v] - s) < 1e-12 for v, s in found)
    assert set(got) == set(range(0, 300, 10)) and hits >= 0.9 * 300 and [v for v, _ in got[10]][:2] == [20, 30]
    assert not neighbours.search(df.where("false"), F.col("vec_id") % 10 == 0).collect()


def test_lines_of_a_common_segment(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    opening = "licensed material of "
    lines = [opening + word(42) for _ in range(1500)]
    edited = [x[:30] + "#" + x[31:55] + "#" + x[56:] for x in lines[:60]]  # in both other segments
    docs = spark.createDataFrame(list(enumerate([*lines, *edited])), "doc_id long, text string").repartition(4, "doc_id")
    _, linked = linededup.line_classes(docs)
    assert linked.count() == 120 and linked.groupBy("component").count().where("count = 2").count() == 60


def test_outliers_of_a_group_of_copies(spark):
    base = [f"b{i}" for i in range(200)]
    put = lambda at, name, of: [*of[:at], name, *of[at + 1 :]]
    texts = [put(i % 150 + 10, f"m{i}", base) for i in range(300)]
    for i in range(60):
        other = [*base[:174], *(f"o{i}x{k}" for k in range(26))]
        texts += [other, put(0, f"p{i}", other)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4, "doc_id")
    found = {r.doc_id: r.class_id for r in dartminhash.classes(docs, bands=3, rows=1).collect()}
    assert {found[i] for i in range(300)} == {0} and all(found[i] == found[i + 1] == i for i in range(300, 420, 2))


def test_decontamination_of_few_literals(spark):
    q = "Add 12 and 45 then 7 8 9 10 11 12 13 14 15 16 17 18 19 20"
    items = spark.createDataFrame([(1, q)], "item_id long, text string")
    d = spark.createDataFrame([(1, "Well. " + q), (2, " ".join(str(i) for i in range(100, 130)))], "doc_id long, text string")
    assert [(r.doc_id, r.exact, r.matched_words) for r in decontaminate.matches(d, items).collect()] == [(1, True, 19)]


def test_pairs_of_lines_with_a_common_third(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    opening, lines = "a common third here.", []
    for _ in range(400):
        x = opening + word(40)
        lines += [x, x[:27] + "#" + x[28:48] + "#" + x[49:]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4, "doc_id")
    assert linededup.dedup(docs).where("n_removed > 0").count() == 400


def test_lines_that_fool_a_polynomial_hash(spark):
    x = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    y = x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.dedup(docs).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r.doc_id: r.class_id for r in dartminhash.classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("limits", [{}, {"FEW_ROWS": 0, "FEW_BYTES": 0, "PAIRS_A_LINE": 0}])
def test_line_dedup_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(linededup, name, value)
    docs = {r.doc_id: r.text for r in read(spark, DATA, "documents").collect()}
    where = defaultdict(list)
    for i in sorted(docs):
        for k, x in enumerate(docs[i].split("\n")):
            if len(" ".join(x.split())) >= 24:
                where[" ".join(x.split())].append((i, k))
    lines = sorted(where, key=len)
    top = {x: x for x in lines}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            if len(b) - len(a) > 2:
                break
            if linededup.within(a, b, 2):
                top[find(b)] = find(a)
    classes = defaultdict(list)
    for x in lines:
        classes[find(x)] += where[x]
    gone = {p for own in classes.values() for p in sorted(own)[1:]}
    expected = {i: "\n".join(x for k, x in enumerate(docs[i].split("\n")) if (i, k) not in gone) for i in docs}
    assert {r.doc_id: r.text for r in queries.op10_line_dedup(spark, DATA).collect()} == expected


def test_neighbours_in_cells_with_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "CHUNK", 20)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 16)), rng.normal(size=(1, 16)) + rng.normal(size=(700, 16)) * 1e-3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, depth=20, cell=400).collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(found) & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert set(got) == set(range(0, 2200, 20)) and all(len(f) == 10 for f in got.values()) and hits >= 0.95 * 10 * len(got)


def test_language_rejects_what_is_half_one_language_and_half_another(spark):
    en, de = "the cat and the dog sat on the mat by the door ", "der hund und die katze auf der matte an der tuer "
    model = language.Model(["en", "de"], [en.encode() * 40, de.encode() * 40])
    docs = spark.createDataFrame([(1, "the dog sat on the mat and the cat by the door"), (2, "xyz qrs"), (3, "12")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(docs, model).collect()}
    assert found[1] == ("en", False) and found[2][1] and found[3] == ("und", True)
    assert [r.doc_id for r in language.keep_identified(docs, model).collect()] == [1]


def test_decontamination_brute_force(spark, monkeypatch):
    """Whatever is a verbatim run of 13 words of an item is found, with the list and with the map of bits."""
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in read(spark, DATA, "benchmark").collect()}
    runs = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 12):
            runs[tuple(w[k : k + 13])].add(i)
    expected = set()
    for r in read(spark, DATA, "documents").collect():
        w = re.findall(r"\w+", r.text.lower())
        expected |= {(r.doc_id, i) for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())}
    plain = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, DATA).collect()}
    assert expected and expected <= plain
    monkeypatch.setattr(decontaminate, "FILTER_LIMIT", 0)
    monkeypatch.setattr(decontaminate, "BITS", 1 << 22)
    assert {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, DATA).collect()} == plain


def test_openers_are_slots(spark):
    q = "Anna has 7 red apples and gives 3 of them to the boy who sits by the old well."
    d = spark.createDataFrame([(1, q.replace("Anna", "Bob").replace("7", "9").replace("3", "4"))], "doc_id long, text string")
    found = decontaminate.matches(d, spark.createDataFrame([(1, q)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.exact, r.matched_words) for r in found] == [(1, False, 19)]


def test_secrets_of_several_formats(spark):
    rng = np.random.default_rng(8)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    dotted = lambda: ".".join(draw(low + up + digit, n) for n in (10, 12, 16))
    prose = " ".join(draw("etaoinshr", int(rng.integers(2, 16))) for _ in range(400))
    rows = [(i, f"{prose[: 40 * (i % 20)]} secret: {dotted() if i % 2 else draw(up + digit, 14)} end") for i in range(200)]
    rows += [(300, f"see {dotted()} or {draw(up + digit, 14)}"), (301, prose), (302, "www.example.com/internationalisation-of-words")]
    found = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[300].n_format == 2 and found[301].spans == "" and found[302].spans == ""


def test_every_text_keeps_its_base_spans(spark):
    for r in queries.op5_secrets(spark, DATA).join(read(spark, DATA, "documents"), "doc_id").collect():
        base = secrets.base_spans(r.text or "")
        assert [s for s in r.spans.split(",") if s and not s.startswith("format")] == [f"{k}:{a}:{b}" for a, b, k, _ in base]


def test_suffixes_without_a_shared_list(spark, monkeypatch):
    plain = {r.doc_id: r.repeated_words for r in queries.op3_suffixes(spark, DATA).collect()}
    monkeypatch.setattr(suffixes, "FILTER_LIMIT", 0)
    assert {r.doc_id: r.repeated_words for r in queries.op3_suffixes(spark, DATA).collect()} == plain


def test_a_text_of_over_a_million_characters(spark):
    text = "\n".join(f"line {i} of a very long text, number {i * i}." for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "x y z"), (3, text)], "doc_id long, text string")
    assert len(text) > 1_000_000
    assert {r.doc_id: r.class_id for r in dartminhash.classes(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id for r in suffixes.repeats(docs).collect()} == {1, 3}
    pieces = packing.pack(docs, WORD, 2).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == next(r.doc_tokens for r in pieces if r.doc_id == 1)


def test_a_passage_before_one_change_is_found(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven grey herons watch from a wooden bridge near the old mill"
    item = f"{passage} and 4 boats pass with 9 sailors on each of them"
    docs = [(1, f"{passage} and 5 boats pass with 5 sailors on each of them"), (2, " ".join(passage.split()[:17]) + " and 5 boats pass with 5 sailors on none"), (3, f"so {passage} it ends"), (4, None), (5, "")]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    by = {r.doc_id: r for r in found}
    assert len(passage.split()) >= 20 and {1, 3} <= set(by) and not by[1].exact and 4 not in by and 5 not in by


def test_packing_of_a_whole_table(spark):
    library = Tokenizer.from_file(WORD)
    library.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op8_packing(spark, DATA).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    docs = {r.doc_id: r.text or "" for r in read(spark, DATA, "documents").collect()}
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += own[0].padded_length - at
    assert padding <= 0.02 * sum(r.length for own in sequences.values() for r in own) + 4096 * 8


def test_token_files_of_a_whole_table(spark):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    start, expected = 0, []
    for r in sorted(read(spark, DATA, "documents").collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op9_token_files(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected


def test_held_out_accuracy(spark):
    data, large = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
    quality_of = queries.op2_quality(spark, large).where("held_out").join(read(spark, large, "labels").select("doc_id", "quality"), "doc_id").cache()
    language_of = queries.op7_language(spark, data).where("held_out").join(read(spark, data, "documents").select("doc_id", "lang"), "doc_id")
    assert quality_of.where("predicted = quality").count() >= 0.98 * quality_of.count() > 0
    assert language_of.where("lang_pred = lang").count() >= 0.97 * language_of.count() > 0


def test_equal_texts_of_fewer_words_do_not_repeat(spark):
    text = lambda n: " ".join(f"v{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text(49)), (2, text(49)), (3, "x " + text(50)), (4, "y " + text(50))], "doc_id long, text string")
    assert {r.doc_id for r in suffixes.repeats(docs.where("doc_id < 3")).collect()} == set() and {r.doc_id for r in suffixes.repeats(docs).collect()} == {3, 4}


def test_passages_that_begin_or_end_within_runs_of_one_word(spark):
    rng = np.random.default_rng(12)
    rows = []
    for n in range(40):
        word, other, m = f"r{n}", f"q{n}", int(rng.integers(30, 46))
        rows += [f"{word} " * m + f"{other} " * (52 - m), f"{word} " * (m + 15) + f"{other} " * (58 - m), f"{word} " * (m - 1) + f"{other} " * (52 - m)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4, "doc_id")
    where = defaultdict(set)
    for i, t in enumerate(rows):
        w = t.split()
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    assert {r.doc_id for r in suffixes.repeats(docs).collect()} == {i for own in where.values() if len(own) > 1 for i in own}
