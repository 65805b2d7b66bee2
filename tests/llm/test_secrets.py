"""Format spans beside marks and base spans, from few labelled values, against every part of every run tried, and clean texts."""

import re

import numpy as np

from veridate.llm import secrets
from veridate.llm.common import read

DATA = "/root/testdata/sf0.001"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def draw(rng, letters, n):
    return "".join(rng.choice(list(letters), n))


def prose(rng, n=300):
    return " ".join(draw(rng, "etaoinshrdlu", int(rng.integers(2, 14))) for _ in range(n))


def scan(spark, rows):
    return {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_contexts_and_few_labels(spark):
    rng = np.random.default_rng(4)
    value = lambda: "ghp_" + draw(rng, ALPHABET, 36)
    contexts = ["see {}", "credential={}", "https://x.io/{}/a", "auth:{}.", "{}.", "key-{}", "a/b_c={}=", "token=abcdefghijkl={} x"]
    for labelled in (120, 19):
        rows = [(i, f"{prose(rng, 60)} token = {value()} end") for i in range(labelled)]
        planted, where = {}, {}
        for i, c in enumerate(contexts):
            v = value()
            planted[1000 + i] = f"{c.format(v)} {prose(rng, 5)}"
            where[1000 + i] = c.format(v).index(v)
        clean = {2000: prose(rng), 2001: "www.example.com/internationalisation-of-words/under_scored.names=and-more", 2002: "INTERNATIONALISATION-OF-CAPITALS " * 5, 2003: "=" * 80 + " " + "-" * 90 + " " + "_." * 50}
        found = scan(spark, [*rows, *planted.items(), *clean.items()])
        lost = [contexts[i - 1000] for i, at in where.items() if f"format:{at}:{at + 40}" not in found[i].spans and not (found[i].n_assign and "=" in contexts[i - 1000])]
        assert not lost, (labelled, lost)
        assert all(found[i].spans == "" for i in clean), [found[i].spans for i in clean]


def test_recall_of_three_formats_and_clean_texts(spark):
    rng = np.random.default_rng(9)
    kinds = [lambda: "sk_live_" + draw(rng, ALPHABET, 24), lambda: ".".join(draw(rng, ALPHABET, n) for n in (12, 20, 27)), lambda: draw(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32)]
    rows = [(i, f"{prose(rng, 40)} api_key: {kinds[i % 3]()} end") for i in range(240)]
    hidden = {1000 + i: (f"{prose(rng, 10)} path/", kinds[i % 3](), f"/x {prose(rng, 10)}") for i in range(150)}
    clean = [(5000 + i, prose(rng, 120)) for i in range(40)]
    found = scan(spark, [*rows, *((i, "".join(x)) for i, x in hidden.items()), *clean])
    hit = sum(any(k == "format" and int(b) - int(a) >= 0.8 * len(v) and int(a) < len(p) + len(v) and len(p) < int(b) for k, a, b in (s.split(":") for s in found[i].spans.split(",") if s)) for i, (p, v, _) in hidden.items())
    assert hit >= 0.9 * len(hidden)
    assert all(found[i].spans == "" for i, _ in clean)


def test_every_part_of_every_run(spark):
    docs = read(spark, DATA, "documents")
    automata, text_model = secrets.learn(docs)
    found = {r.doc_id: r for r in secrets.find(docs).collect()}
    for r in docs.collect():
        base = [s[:3] for s in secrets.base_spans(r.text or "")]
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", r.text or ""):
            free = [i for i in range(m.start(), m.end()) if not any(a <= i < b for a, b, _ in base)]
            for lo in [i for i in free if i - 1 not in free]:
                hi = next(i for i in range(lo, m.end() + 1) if i not in free)
                value = r.text[lo:hi]
                edge = [i for i in range(len(value) + 1) if i in (0, len(value)) or value[i - 1] in "+/_.=-" or value[i] in "+/_.=-"]
                gains = []
                for a in edge:
                    for b in edge:
                        if a and value[a - 1] not in "+/_.=-" or b < len(value) and value[b] not in "+/_.=-" or b <= a:
                            continue
                        for x in automata.values():
                            shape = secrets.symbols(value[a:b])
                            if len(shape) < x.shortest or a and len(shape) > x.longest or (score := x.score(shape)) < x.least:
                                continue
                            gain = score * (len(shape) + 1) - sum(np.log2(secrets._CLASS.get(c, 1)) for c in shape) - text_model.score(value[a:b]) - 16 * max(1, x.doubt)
                            if gain >= 0:
                                gains.append((-round(gain, 6), a, -b))
                kept = []
                for _, a, b in sorted(gains):
                    if all(-b <= c or d <= a for c, d in kept):
                        kept.append((a, -b))
                expected += [f"format:{lo + a}:{lo + b}" for a, b in kept]
        assert sorted(s for s in found[r.doc_id].spans.split(",") if s.startswith("format")) == sorted(expected), r.doc_id


def test_long_run_of_marks_and_letters():
    rng = np.random.default_rng(2)
    automata = [secrets.Automaton([secrets.symbols(draw(rng, "0123456789abcdef", 40)) for _ in range(100)])]
    model = secrets.Prose(np.zeros(1 << 14, np.int64))
    value = "/".join(draw(rng, ALPHABET, 30) for _ in range(30_000))
    assert isinstance(secrets.formats(value, automata, model, 16.0), list)
