"""Whitening, decontamination and search against brute force, with odd rows."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from netweir.llm import decontam, search, whiten

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def table(spark, rows, key):
    """Rows of a key and a text, beside columns with names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], f"{key} long, text string, id string, h int, w int")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, n int")


def test_leading_pairs_equal_a_dense_solver():
    rng = np.random.default_rng(2)
    for d, k in ((6, 32), (40, 32), (150, 12)):
        x = rng.normal(size=(900, d)) * np.linspace(0.5, 3, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
        v = np.cov(x.T, bias=True)
        e, u = whiten.leading(lambda m, v=v: v @ m, d, k)
        assert e == pytest.approx(np.linalg.eigvalsh(v)[::-1][:k], rel=1e-12)
        assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-11 and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12


def test_minres_solves_projected_equations():
    rng = np.random.default_rng(3)
    a = np.diag(np.linspace(1, 4, 30))
    q = np.linalg.qr(rng.normal(size=(30, 3)))[0]
    b = rng.normal(size=(30, 2))
    b -= q @ (q.T @ b)
    values = np.array([0.1, 6.0])
    t = whiten.minres(lambda m: a @ m, values, q, b, 27)
    off = np.eye(30) - q @ q.T
    for j in range(2):
        assert off @ (a - values[j] * np.eye(30)) @ off @ t[:, j] == pytest.approx(b[:, j], abs=1e-8)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 40)).astype(np.float32) * np.linspace(0.2, 2, 40, dtype=np.float32)
    odd = [(900, None), (901, []), (902, [1.0, None] * 20), (903, [float("nan")] * 40), (904, [float("inf")] * 40), (905, [1.0] * 7)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (3, v[3].tolist())]
    got = whiten.components(vectors(spark, rows + odd)).collect()
    kept = np.array([x for _, x in rows])
    x = np.floor(64 * kept).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    cov = (c := x - s / n).T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    z = c @ u / np.sqrt(e)
    assert len(got) == n * 32 and {r["vec_id"] for r in got} == {i for i, _ in rows} and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] not in (None, 3)}
    for k in range(1, 33):
        mine = np.array([by[i, k]["whitened"] for i in range(400) if i != 3])
        true = np.delete(z[:400, k - 1], 3)
        assert mine * np.sign(mine @ true) == pytest.approx(true, abs=1e-7)
        assert by[0, k]["explained"] == pytest.approx(e[k - 1] / np.trace(cov), rel=1e-9)
    assert [by[i, 1]["deviation"] for i in (0, 1, 2)] == [int(((n * x[i] - s) ** 2).sum()) for i in (0, 1, 2)]
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whiten.components(vectors(spark, [(1, None)])).count() == 0
    one = whiten.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["deviation"], r["n"]) for r in one] == [([], 0, 2)] * 2
    two = whiten.whitened(vectors(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0])])).collect()
    assert [len(r["whitened"]) for r in two] == [1, 1] and abs(two[0]["whitened"][0]) == pytest.approx(1)
    big = whiten.whitened(spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in big] == [None, None] and abs(big[0]["whitened"][0]) == pytest.approx(1)


def brute_matches(docs, items, size):
    grams = {}
    for i, t in items:
        w = split(t)
        for p in range(len(w) - min(len(w), size) + 1 if w else 0):
            grams.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = []
    for i, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for g, of in grams.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    ids |= of
        names = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["Ab", "cé", "d9", "漢字", "É", "e"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-_"]) for _ in range(n))
    items = [(i, text(rng.randint(3, 9))) for i in range(30)] + [(40, None), (41, "  "), (42, "AB"), (None, "cé d9 cé"), (7, "e e e e"), (7, "e e e e"), (8, "d9")]
    for some in (items[:-1], [(i, t) for i, t in items if len(split(t)) != 1]):
        docs = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(500, None), (501, ""), (None, "cé d9 cé"), (3, text(20)), (4, "e e e e e"), (4, "e e e e e")]
        d, b = table(spark, docs, "doc_id"), table(spark, some, "item_id")
        want = brute_matches(docs, some, 4)
        for most in (decontam.BROADCAST_BYTES, 0):
            got = [tuple(r) for r in decontam.report(d, b, size=4, broadcast_bytes=most).collect()]
            assert sorted(got, key=str) == want


def test_decontamination_of_odd_tables(spark):
    d, b = table(spark, [(1, "a b c"), (2, None)], "doc_id"), table(spark, [(1, "b")], "item_id")
    assert decontam.report(d.limit(0), b).count() == 0
    assert [tuple(r)[1:3] for r in decontam.report(d, b.limit(0)).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
    long = table(spark, [(1, "ab " * 400_000 + "x y z"), (2, "A" * 1_000_000)], "doc_id")
    got = {r["doc_id"]: tuple(r)[1:4] for r in decontam.report(long, table(spark, [(5, "X y Z"), (6, "ab ab")], "item_id")).collect()}
    assert got == {1: (400_003, 400_003, 2), 2: (1, 0, 0)}


def test_hit_words_or_documents_are_removed(spark):
    docs = [(1, "One, TWO three; four five."), (2, None), (3, "nothing here"), (4, "two three"), (None, "...two three, x")]
    d, b = table(spark, docs, "doc_id"), table(spark, [(1, "two three"), (2, "three four")], "item_id")
    out = decontam.decontaminated(d, b)
    assert out.columns == d.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "One, five.", 2: None, 3: "nothing here", 4: "", None: "...x"}
    assert {r["id"] for r in out.collect()} == {"x"}
    assert {r["doc_id"] for r in decontam.decontaminated(d, b, "documents").collect()} == {2, 3}


def brute_ranks(docs, items, top):
    held = [(i, split(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for i, t in set(items):
        scores = []
        for doc, w in held:
            c = Counter(w)
            m = 10 + (90 * len(w) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in set(split(t)) if c[x])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(i, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "漢", "Ab", "aB"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([8, 65])]) for _ in range(n)) + "."
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)] + [(None, "w1 w2"), (700, "w1 w2"), (3, "w1 w2"), (3, "w1 w2"), (800, None), (801, "-")]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(30, None), (31, "zz"), (32, "w1 w2"), (32, "w1 w2"), (None, "漢 é")]
    d, b, want = table(spark, docs, "doc_id"), table(spark, items, "item_id"), brute_ranks(docs, items, 5)
    for most, cells in ((search.INDEX_BYTES, search.CELLS), (300, 64)):
        monkeypatch.setattr(search, "CELLS", cells)
        assert sorted((tuple(r) for r in search.ranked(d.repartition(5), b, top=5, index_bytes=most).collect()), key=str) == want


def test_search_of_odd_tables(spark):
    d, b = table(spark, [(1, "a b c"), (2, None)], "doc_id"), table(spark, [(1, "b")], "item_id")
    assert search.ranked(d.limit(0), b).count() == 0 and search.ranked(d, b.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.ranked(d, b).collect()] == [(1, 1, 1)]
    long = table(spark, [(1, "ab " * 400_000), (2, "A" * 1_000_000), (3, "c")], "doc_id")
    assert [(r["item_id"], r["doc_id"]) for r in search.ranked(long, table(spark, [(5, "ab"), (6, "a" * 1_000_000)], "item_id")).orderBy("item_id").collect()] == [(5, 1), (6, 2)]
