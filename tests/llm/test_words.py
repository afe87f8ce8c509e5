"""Word kernels and shared helpers against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.components import connected_components
from tessera.llm.textkern import Texts, Words, distinct, pieces, shingles, span_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé漢 \t\n\x0b\x0c\r\x1c 🙂", max_size=40)), min_size=0, max_size=8)


def plain(text):
    return (text or "").encode().split()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    t = Texts(pa.array(texts, pa.string()))
    w = Words(t)
    for i, x in enumerate(texts):
        at = slice(w.off[i], w.off[i + 1])
        assert [t.data[a:b].tobytes() for a, b in zip(w.start[at], w.end[at], strict=True)] == plain(x)
    flat = [x.lower() for text in texts for x in plain(text)]
    h = w.hashes(lower=True)
    assert len({(a, int(b)) for a, b in zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h.tolist()))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_shingle_counts(texts):
    w = Words(Texts(pa.array(texts, pa.string())))
    h, d = shingles(w, 3)
    d, h = distinct(d, h)
    for i, x in enumerate(texts):
        words = [y.lower() for y in plain(x)]
        want = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} - {()}
        assert (d == i).sum() == len(want)


def test_slices_and_pieces():
    column = pa.array(["skip", "a b", None, "c", "d" * 50])
    t = Texts(column.slice(1, 3))
    assert [t.text(i) for i in range(3)] == [b"a b", b"", b"c"]
    parts = list(pieces(pa.record_batch([column], names=["t"]), 0, 4))
    assert [x for p in parts for x in p.column(0).to_pylist()] == column.to_pylist()
    assert list(pieces(pa.record_batch([pa.array([], pa.string())], names=["t"]), 0)) == []


def test_spans_of_all_lengths():
    """A span's hash depends on its bytes alone, not on where it lies or what is next to it."""
    rng = np.random.default_rng(3)
    spans = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in [*range(1, 80), 500, 5000]] + [b"\0" * n for n in range(1, 80)]
    seen = []
    for lead, gap in ((b"", b""), (b"xyz", b"--")):
        data = lead + gap.join(spans)
        end = len(lead) + np.cumsum([len(x) + len(gap) for x in spans]) - len(gap)
        h = span_hashes(np.frombuffer(data, np.uint8), end - [len(x) for x in spans], end)
        assert [h[i] == span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for i, x in enumerate(spans)] == [True] * len(spans)
        seen.append(h.tolist())
    assert seen[0] == seen[1] and len(set(seen[0])) == len(spans)


def thue_morse(n, a, b):
    """Two strings that every polynomial hash modulo a power of two, whatever its odd base, maps to one value."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_no_structured_collisions():
    from tessera.llm import divergence_rules, nbsvm
    from tessera.llm.brown_lm import word_hashes

    x, y = thue_morse(4096, "a", "b")
    t = Texts(pa.array([f"{x}\n{y}\n{x}", x, y]))
    w = Words(t)
    assert divergence_rules.base_counts(t, w).n_dup_lines.tolist() == [1, 0, 0]
    assert divergence_rules.base_counts(Texts(pa.array([f"{x}\n{y}"])), Words(Texts(pa.array([f"{x}\n{y}"])))).n_dup_lines.tolist() == [0]
    for h in (w.hashes(lower=True), w.hashes(lower=False), word_hashes(w)):
        assert len(set(h.tolist())) == 2
    h, d = shingles(w, 5)
    assert h[d == 1] != h[d == 2]
    # as shingles and windows of words
    p, q = thue_morse(8, "one ", "two ")
    w = Words(Texts(pa.array([p, q])))
    h, d = shingles(w, 8)
    assert len(set(h.tolist())) == 2
    doc, slot = nbsvm.features(t)
    assert set(slot[doc == 1].tolist()) != set(slot[doc == 2].tolist())


def test_id_filter(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "x")
    bits = shared.id_filter(ids, "x")
    rows = spark.range(5000).select("id", shared.filter_slot(F.col("id")).alias("s")).collect()
    hit = shared.in_filter(bits, np.array([r["s"] for r in rows]))
    assert all(hit[r["id"]] for r in rows if r["id"] % 7 == 0) and hit.sum() < 750


def test_runs(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))

    def total(key, run):
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([sum(sum(b.column(1).to_pylist()) for b in run)])], names=["k", "s"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.k: r.s for r in shared.map_runs(rows, ["k"], ["v"], total, "k long, s long").collect()}
        skipped = {r.k: r.s for r in shared.map_runs(rows, ["k"], ["v"], lambda key, run: total(key, [next(run)]), "k long, s long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: sum(range(k, 3000, 7)) for k in range(7)} and set(skipped) == set(got)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(900 + i, 901 + i) for i in range(60)] + [(5, 5), (None, 3)] + [(2000, 2001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.id: r.component for r in connected_components(df, shared.Scratch(spark, "t"), "c").collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(df.limit(0), shared.Scratch(spark, "t"), "c").count() == 0
