"""Near-duplicates of texts and vectors against brute force, with planted groups and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hyperminhash as H
from tessera.llm import hyperplane_dedup as V


def brute(texts, percent=75):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(n=260, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind < 2 or not texts:
            texts.append([rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 200]))])
        elif kind == 2:
            texts.append(list(rnd.choice(texts)))
        else:  # chains of near copies
            t = list(rnd.choice(texts[-20:]))
            for _ in range(max(1, len(t) // rnd.choice([20, 40, 60]))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(t)
    out = [(i * 3, " ".join(t)) for i, t in enumerate(texts)]
    return out + [(5000, None), (5001, ""), (5002, " \n "), (5003, "One  two"), (5004, "one\ttwo"), (5005, "x " * 3000), (5006, "X " * 2500)]


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "STAR", 3 if block == 4 else 1024)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in texts], "doc_id long, text string, component_id string, kept boolean").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(docs).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("block", [512, 7])
def test_leftover_buckets_find_links(spark, monkeypatch, block):
    """Blocks by themselves, sketches first and then full sets, join what brute force joins."""
    monkeypatch.setattr(H, "BLOCK", block)
    texts = [(i, t) for i, t in corpus(80, 9) if t and t.split()]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    of = H.sketches(docs, "doc_id", "text", 5).select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("id"), F.col("doc_id").alias("component"), "n_shingles", "regs")
    dealt = H._blocks(of)
    maybe = H._maybe_linked(dealt, 75)
    assert maybe.select("id").distinct().count() < len(texts) and maybe.count() <= dealt.count()
    full = H._set_rows(docs, maybe.select("id"), "doc_id", "text", 5)
    links = [(r.u, r.v) for r in H._across(maybe.join(full, F.col("id") == F.col("sid")).select("key", "i", "j", "own", "id", "component", "shingles"), 75).collect()]
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert {i: find(i) for i, _ in texts} == {i: x[1] for i, x in brute(texts).items()}


def test_rows_that_share_an_id_are_one_vertex(spark):
    """Their texts tie the classes of all of them together."""
    rows = [(3, "a b c d e f g"), (5, "a b c d e f g"), (5, "p q r s t u v"), (7, "p q r s t u v"), (9, "k l m n o"), (9, None), (2, "k l m n o"), (11, "one two"), (11, "three"), (12, "three")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3): 3, (5, 3): 3, (7, 3): 3, (9, 1): 2, (9, 0): 9, (2, 1): 2, (11, 1): 11, (12, 1): 11}


def test_recall_of_bands_and_estimates():
    """Pairs of random sets at the threshold: bands and the estimate's floor find all but 1 in 20000, and
    least shingles find all of the smallest."""
    rng = np.random.default_rng(12)
    lost = tried = 0
    for size in (4, 6, 8, 11, 16, 17, 21, 22, 24, 28, 40, 100):
        common, n = -(-3 * size // 4), 200_000 // size
        whole = rng.integers(0, 2**63, (n, size), dtype=np.uint64) * np.uint64(2)
        if common <= H.SMALL:
            a, b = np.sort(whole, axis=1), np.sort(whole[:, :common], axis=1)
            p, q = (-(-75 * k // 100) for k in (size, common))
            assert (a[:, : size - p + 1, None] == b[:, None, : common - q + 1]).any(axis=(1, 2)).all()
            continue
        pairs = np.concatenate([whole, whole[:, :common]], axis=1)
        docs = np.concatenate([np.repeat(2 * np.arange(n), size).reshape(n, -1), np.repeat(2 * np.arange(n) + 1, common).reshape(n, -1)], axis=1)
        regs = H.sketch(docs.ravel(), pairs.ravel(), 2 * n)
        a, b = regs[::2], regs[1::2]
        met = (a == b).reshape(n, -1, H.BAND).all(axis=2).any(axis=1)
        lost += int((~met | ~H._may_link(a, b, np.full(n, size), np.full(n, common), 75)[0]).sum())
        tried += n
    assert tried > 20_000 and lost <= 2


def test_near_duplicate_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert H.near_duplicates(empty).count() == 0 and H.keep_one(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in H.near_duplicates(odd).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert sorted((r.doc_id or -1, r.text) for r in H.keep_one(odd).collect() if r.text) == [(-1, "a b c d e f"), (1, "a b c d e f")]


def test_estimate_is_near_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.5, 0.75, 0.9):
        common = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 2**63, 2000 - len(common), dtype=np.uint64)]) * np.uint64(2) for _ in range(2)]
        regs = H.sketch(np.repeat([0, 1], 2000), np.concatenate(sets), 2)
        true = len(common) / (4000 - len(common))
        errors.append(abs(float(H.estimate(regs[0], regs[1], np.array(2000), np.array(2000))) - true))
    assert max(errors) < 0.13


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 16))
    rows = [v.tolist() for v in base]
    for v in base[:25]:
        rows += [(v + rng.standard_normal(16) * s).tolist() for s in (0.02, 0.2, 0.3)]
    rows += [base[0].tolist()] * 40 + [(base[1] * 3).tolist()] * 2
    return [(i * 2, v) for i, v in enumerate(rows)]


def brute_vectors(rows):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in zip(*np.nonzero(link), strict=True):
        p, q = sorted((find(ids[a]), find(ids[b])))
        root[q] = p
    return {i: (int(link[k].sum()) - 1, find(i), find(i) == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, weight string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 1.0]), (10, [1e200, 0.0]), (11, [-0.0, 5.0]), (12, [0.0, 5.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 8, 9)}
    assert got == {**alone, None: (0, None, True), 6: (2, 6, True), 7: (2, 6, False), 10: (2, 6, False), 11: (1, 11, True), 12: (1, 11, False)}
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_tables_and_codes():
    """Of 20000 random pairs just above the threshold, tables and the codes' limit find all."""
    rng = np.random.default_rng(2)
    n, dim = 20_000, 64
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    signs, tables = V.plan(10**6)
    planes = V._planes(dim, signs, tables)
    met = (V._signatures(a, planes, signs, tables) == V._signatures(b, planes, signs, tables)).any(axis=1)
    far = np.bitwise_count(V.codes(a) ^ V.codes(b)).sum(axis=1)
    first = np.bitwise_count(V.codes(a)[:, 0] ^ V.codes(b)[:, 0])
    assert (~met).sum() <= 1 and (far > V.far()).sum() == 0 and (first > V.far(signs=64)).sum() == 0
    i, j = V.near_codes(V.codes(a[:300]), V.codes(b[:300]), 0.95)
    assert i.tolist() == j.tolist() == list(range(300))
    assert np.bitwise_count(V.codes(a) ^ V.codes(a[::-1])).sum(axis=1).min() > V.far()


def test_rows_that_share_a_vec_id_are_one_vertex(spark):
    rows = [(3, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [-1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (7, 1, 3), (8, 0, 8)]


def test_plan_keeps_the_miss_rate():
    for n in (0, 10, 10**5, 10**9):
        signs, tables = V.plan(n)
        assert (1 - V.agree(0.95) ** signs) ** tables <= V.MISS
