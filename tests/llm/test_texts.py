"""Tokens, rules, languages, quality and language-model scores against plain Python or held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, brown_lm, crf_langid, divergence_rules, nbsvm
from tessera.llm.shared import bit_of_id, expand, unpack
from tessera.llm.textkern import Texts, Words

ODD = [None, "", " \n\t ", "x", "a\n\na\na \n", "12 34", "🙂 é 漢字", "word " * 5000, "\x00\x1c odd", "The cat sat. " * 3]


@pytest.fixture(scope="module")
def coder():
    path, pattern = bpe.public_ranks()
    with open(path, "rb") as f:
        return bpe.Coder(f.read(), pattern)


def test_chunks_do_not_change_tokens(coder):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice([" ", "  ", "\n", "a", "'re", "'", "7", "é", "漢", "!!", "　", "'l", "l"]) for _ in range(1500)) for _ in range(20)]
    texts += [" " * 900 + "a" * 900 + "'s've" * 99 + "\n" * 300, "🙂" * 500, "don't 's " * 100]
    for t in texts:
        want = coder.core.encode_ordinary(t)
        assert coder.decode(want) == t.encode()
        for chunk, overlap in ((400, 40), (64, 8), (50, 50), (6000, 300)):
            assert coder.encode(t, chunk, overlap).tolist() == want


def test_chunks_agree_with_their_neighbours(coder):
    """Running text is stitched at every overlap; what is carried on is only text without such a place."""
    text = "Words, words and 12 more. " * 400
    parts = [coder.chunk(t, last, 40) for t, last in bpe.cut(text, 400, 40)]
    assert len(parts) > 20 and all(p.over for p in parts) and [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
    assert [len(t) for t, _ in bpe.cut(text, 400, 40)][:-1] == [440] * (len(parts) - 1)
    assert not any(coder.chunk(t, last, 40).over for t, last in list(bpe.cut("a" * 2000, 400, 40))[:-1])


@pytest.mark.parametrize("dealt", [bpe.DEALT, 30])
def test_encode_and_decode(spark, coder, dealt):
    docs = spark.createDataFrame([(i, t, "a", [i]) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, row array<int>").repartition(3)
    how = {"chunk": 64, "overlap": 16, "dealt": dealt}
    done = bpe.decode(bpe.encode(docs, check_col="same", **how)).collect()
    assert len(done) == len(ODD)
    for r in done:
        assert bytes(r["decoded"]) == (ODD[r["doc_id"]] or "").encode() and r["ids"] == coder.core.encode_ordinary(ODD[r["doc_id"]] or "") and r["same"] and r["row"] == [r["doc_id"]] and r["text"] == ODD[r["doc_id"]]
    got = bpe.digests(docs.union(docs), **how).collect()
    assert len(got) == 2 * len(ODD)
    for r in got:
        t = ODD[r["doc_id"]] or ""
        ids = coder.core.encode_ordinary(t)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.digests(docs.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["decoded"] is None
    with pytest.raises(KeyError):
        coder.decode([10**6])


def base(text):
    text = text or ""
    words, seen, dup = text.encode().split(), set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_rules(spark, sf):
    texts = ODD + ["a b c d e f g h i j " * 4, "one two\r\none two\none two\n" * 3, "#a *b $c %d &e |f <g> " * 9]
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    assert divergence_rules.reference(docs) is None
    for r in divergence_rules.rules(docs, None).collect():
        assert tuple(r)[1:7] == base(texts[r["doc_id"]]) and r["kept"] == (not r["base_failed"])
    real = spark.read.parquet(f"{sf}/documents.parquet")
    ref = divergence_rules.reference(real)
    assert ref.classes.shape == (4, len(divergence_rules.CLASSES)) and np.allclose([w.sum() for w in ref.words], 1)
    got = {r["doc_id"]: r for r in divergence_rules.rules(real, ref).collect()}
    for r in real.collect():
        assert tuple(got[r["doc_id"]])[1:7] == base(r["text"])
    kept = divergence_rules.keep_good(real, ref)
    assert kept.columns == real.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert divergence_rules.rules(docs.limit(0), ref).count() == 0


def test_distance():
    p = np.array([[1.0, 0], [0.5, 0.5], [0.2, 0.8]])
    q = np.array([[0.0, 1], [0.5, 0.5], [0.8, 0.2]])
    m = (p[2] + q[2]) / 2
    want = math.sqrt((sum(a * math.log2(a / b) for a, b in zip(p[2], m)) + sum(a * math.log2(a / b) for a, b in zip(q[2], m))) / 2)
    assert np.allclose(divergence_rules.distance(p, q), [1, 0, want])


def test_texts_without_common_words_are_not_kept(spark, sf):
    """What chance adds is taken off the divergence, so the word limit holds for short texts as well."""
    assert np.allclose(divergence_rules.less_noise(np.array([0.5, 0.1]), 65, np.array([100, 100])), [math.sqrt(0.25 - 64 / (800 * math.log(2))), 0])
    rnd = random.Random(7)
    texts = [" ".join("".join(rnd.choice("aeioustnrl") for _ in range(9)) for _ in range(n)) for n in (105, 140, 180, 215)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ref = divergence_rules.reference(spark.read.parquet(f"{sf}/documents.parquet"))
    for r in divergence_rules.rules(docs, ref).collect():
        assert not r["base_failed"] and r["word_distance"] > divergence_rules.WORD_LIMIT and not r["kept"]


def test_verdicts_match_brute_force(spark, sf):
    """References, distances and verdicts by plain Python over whole texts."""
    D = divergence_rules
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9000 + i, t, None) for i, t in enumerate(ODD)] + [(9100, "a b c " * 30, "xx"), (9101, " ".join(map(str, range(100))), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    classes, common = {}, {}

    def chars(text):
        return Counter(int(D.CLASS_OF[b]) for b in (text or "").encode())

    for _, text, lang in rows:
        if lang is not None and not base(text)[5]:
            classes.setdefault(lang, Counter()).update(chars(text))
            common.setdefault(lang, Counter()).update((text or "").encode().lower().split())
    top = {k: [w for w, n in v.items() if n > sorted([*v.values(), *[0] * 65], reverse=True)[D.COMMON]] for k, v in common.items()}

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        half = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return math.sqrt(max((half(p) + half(q)) / 2, 0))

    got = {r["doc_id"]: r for r in D.rules(docs, D.reference(docs)).collect()}
    for i, text, _ in rows:
        own, words = chars(text), Counter((text or "").encode().lower().split())
        n, c, best = sum(words.values()), sum(own[k] for k in range(len(D.CLASSES))), None
        for lang in sorted(classes):
            total, every = sum(classes[lang][k] for k in range(len(D.CLASSES))), sum(common[lang].values())
            a = js([own[k] / max(c, 1) for k in range(len(D.CLASSES))], [classes[lang][k] / total for k in range(len(D.CLASSES))])
            p = [words[w] / max(n, 1) for w in top[lang]]
            q = [common[lang][w] / every for w in top[lang]]
            b = js([*p, (n - sum(words[w] for w in top[lang])) / max(n, 1)], [*q, 1 - sum(q)])
            if best is None or a + b < best[0] + best[1] - 1e-12:
                best = a, b, len(top[lang]) + 1
        off = lambda d, cells, size: math.sqrt(max(d * d - (cells - 1) / (8 * size * math.log(2)), 0))
        a = 0.0 if c < D.GUARD_CHARS else off(best[0], len(D.CLASSES), c)
        b = 0.0 if n < D.GUARD_WORDS else off(best[1], D.COMMON + 1, n)
        assert got[i]["class_distance"] == pytest.approx(a, abs=1e-7) and got[i]["word_distance"] == pytest.approx(b, abs=1e-7), i
        assert got[i]["kept"] == (not base(text)[5] and a <= D.CLASS_LIMIT and b <= D.WORD_LIMIT)


def test_forward_backward_matches_enumeration(monkeypatch):
    import itertools

    rng = np.random.default_rng(0)
    k, count = 3, np.array([0, 1, 5, 3, 0, 6])
    e, a = rng.normal(size=(15, k)) * 2, rng.normal(size=(k, k))
    want, pairs, at = np.zeros_like(e), np.zeros((k, k)), 0
    for c in count:
        acc, joint, total = np.zeros((c, k)), np.zeros((k, k)), 0.0
        for y in itertools.product(range(k), repeat=int(c)) if c else ():
            w = np.exp(sum(e[at + i, y[i]] for i in range(c)) + sum(a[y[i - 1], y[i]] for i in range(1, c))) * np.exp(a[:, y[0]]).sum()
            total += w
            for i in range(c):
                acc[i, y[i]] += w
            for i in range(1, c):
                joint[y[i - 1], y[i]] += w
        if c:
            want[at : at + c] = acc / total
            pairs += joint / total
        at += c
    for chunk in (2, 4, 64):
        monkeypatch.setattr(crf_langid.chunked, "__defaults__", (chunk,))
        got, moved, _ = crf_langid.marginals(e, count, a, pairs=True)
        assert np.allclose(got, want) and np.allclose(moved, pairs)


def test_languages(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = bit_of_id("doc_id", 4) == 2
    model = crf_langid.fit(docs, ~held)
    rows = crf_langid.predict(docs, model).join(docs.select("doc_id", "lang", held.alias("held")), "doc_id").where("held").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in crf_langid.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 5)) and all(got[i][0] in model.langs for i in (3, 4, 6, 7, 8, 9))
    mixed = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 400)).first()["text"] for lang in ("en", "fr")}
    words = {k: " ".join(v.split()[:40]) for k, v in mixed.items()}
    langs = crf_langid.label_words(spark.createDataFrame([(1, f"{words['en']} {words['fr']}")], "doc_id long, text string"), model).first()["langs"]
    assert np.mean([a == b for a, b in zip(langs, ["en"] * 40 + ["fr"] * 40, strict=True)]) > 0.8
    nothing = crf_langid.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in crf_langid.predict(odd, nothing).collect()} == {"und"}
    one = crf_langid.fit(docs.where("lang = 'en'").limit(5), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in crf_langid.predict(docs.limit(3), one).collect()} == {("en", 1.0)}


def test_training_sample_is_bounded(spark):
    """Fifty languages with texts of 20000 words each reach the driver as a bounded number of words."""
    import tracemalloc

    rnd = random.Random(6)
    rows = []
    for k in range(50):
        words = ["".join(rnd.choice("abcdefghijklmnop"[k % 8 : k % 8 + 8]) for _ in range(3)) + chr(97 + k % 25) + "xy"[k // 25] for _ in range(200)]
        rows += [(100 * k + i, f"l{k:02}", " ".join(rnd.choices(words, k=20_000))) for i in range(4)]
    rows += [(9000, "zh", "漢字" * 50_000), (9001, "zh", "漢字 " * 400), (9002, None, "x"), (9003, "l00", None), (None, "l01", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(16)
    pieces = crf_langid.sample(docs.union(docs.where("doc_id < 100")), F.lit(True))
    count = Counter()
    for lang, text in pieces:
        count[lang] += len(text.split())
        assert len(text.encode()) <= crf_langid.PIECE_BYTES
    assert len(count) == 51 and max(count.values()) <= crf_langid.CELLS // 51**2 and min(count.values()) > 300
    assert [x for x, _ in pieces] == sorted(x for x, _ in pieces)
    # pieces come from all over a text
    text = {i: x for i, _, x in rows}
    places = [text[100].find(x) / len(text[100]) for lang, x in pieces if lang == "l01" and x in text[100]]
    assert not places or max(places) > 0.2
    tracemalloc.start()
    model = crf_langid.train([x.encode() for _, x in pieces], [lang for lang, _ in pieces])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700e6
    got = crf_langid.predict(docs.where("lang LIKE 'l%' AND doc_id % 100 = 3"), model).join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


def test_class_counts_match_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("quality IS NOT NULL").select("text", F.col("quality").cast("int").alias("y"))
    counts, n = nbsvm.class_counts(rows.union(rows.limit(5)).repartition(5))
    want = np.zeros((2, nbsvm.SLOTS))
    given = [tuple(r) for r in rows.collect()] + [tuple(r) for r in rows.limit(5).collect()]
    for text, y in given:
        want[y, nbsvm.features(Texts(pa.array([text])))[1]] += 1
    assert (counts == want).all() and n.tolist() == [sum(y == k for _, y in given) for k in (0, 1)]


def test_descent_matches_a_plain_solver():
    """Projected gradient steps on the dual problem lead to the same weights."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(8, rng.integers(1, 5), replace=False)) for _ in range(14)]
    values = [rng.normal(size=len(x)) for x in rows]
    y, cost = np.where(rng.random(14) < 0.5, 1.0, -1.0), rng.uniform(0.5, 3, 14)
    x = np.zeros((14, 9))
    for i, (at, v) in enumerate(zip(rows, values, strict=True)):
        x[i, at], x[i, 8] = v, 1.0
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a = np.zeros(14)
    for _ in range(200_000):
        a = np.clip(a - (q @ a - 1) * 0.02, 0, cost)
    w = nbsvm.descend(rows, values, y, cost, epochs=5000)
    want = (a * y) @ x
    assert np.allclose(w[:8], want[:8], atol=2e-3) and w[-1] == pytest.approx(want[8], abs=2e-3) and not w[8:-1].any()


def test_quality_sample_is_bounded(spark, sf, monkeypatch):
    monkeypatch.setattr(nbsvm, "SAMPLE_SLOTS", 30_000)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = nbsvm.labels_of(labels)
    x, y = nbsvm._sample(docs.union(docs), known, "doc_id", "text")
    assert {0, 1} == set(y.tolist()) and all(sum(len(v) for v, k in zip(x, y, strict=True) if k == c) <= 30_000 for c in (0, 1))
    again, labels_again = nbsvm._sample(docs, known, "doc_id", "text")
    assert len(x) == len(again) and all((a == b).all() for a, b in zip(x, again, strict=True)) and (y == labels_again).all()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = bit_of_id("doc_id", 4) == 2
    model = nbsvm.fit(docs, labels, ~held)
    rows = nbsvm.score(docs, model).join(docs.select("doc_id", held.alias("held")), "doc_id").join(labels, "doc_id").where("held").collect()
    for y in (0, 1):
        assert np.mean([(r["score"] >= nbsvm.ACCEPT) == y for r in rows if r["quality"] == y]) > 0.95
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in nbsvm.score(odd, model).collect())
    kept = nbsvm.keep_good(docs.limit(50), model)
    assert kept.columns == docs.columns
    none = nbsvm.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in nbsvm.score(odd, none).collect()} == {0.5}
    ones = nbsvm.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert min(r["score"] for r in nbsvm.score(odd, ones).collect()) > 0.99
    assert nbsvm.score(odd.limit(0), model).count() == 0


def test_indicators_are_distinct_and_within_texts():
    both, alone = Texts(pa.array(["a b a b", "a b"])), Texts(pa.array(["a b"]))
    doc, slot = nbsvm.features(both)
    assert len(set(zip(doc.tolist(), slot.tolist(), strict=True))) == len(doc)
    assert slot[doc == 1].tolist() == nbsvm.features(alone)[1].tolist()


def scores(docs):
    train, tokens = Counter(), {}
    for i, t in docs:
        tokens[i] = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


@pytest.mark.parametrize("small", [False, True])
def test_language_model(spark, sf, monkeypatch, small):
    if small:  # many groups and shards
        monkeypatch.setattr(brown_lm, "GROUP", 20_000)
        monkeypatch.setattr(brown_lm, "SHARD", 4000)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int")
    got = brown_lm.score(df, bit_of_id("doc_id", 7) == 2).collect()
    want = scores(docs)
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4] and r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def classes_of(texts, rows):
    """The class of every word (None is an end), from the rows that the scores are made of."""
    class_of = {}
    for r in rows.where("unit = -1").collect():
        who, n = np.frombuffer(expand(r["a"]), brown_lm._WHO), unpack(r["b"], np.int64)
        k = np.frombuffer(expand(r["c"]), np.uint8)
        for i, part in zip(who["id"].tolist(), np.split(k, np.cumsum(n)[:-1]), strict=True):
            for w, x in zip([*(texts[i] or "").encode().lower().split(), None], part.tolist(), strict=True):
                assert class_of.setdefault(w, x) == x
    return class_of


def watch(monkeypatch):
    seen = {}
    keep = brown_lm._scores
    monkeypatch.setattr(brown_lm, "_scores", lambda classed, model: seen.update(rows=classed, model=model.value) or keep(classed, model))
    return seen


@pytest.mark.parametrize("small", [False, True])
def test_scores_match_brute_force(spark, sf, monkeypatch, small):
    """Given the classes, counts of words, classes and transitions and the scores that they give are those of plain Python."""
    if small:
        for name, x in (("GROUP", 20_000), ("SHARD", 4000), ("HELD", 500)):
            monkeypatch.setattr(brown_lm, name, x)
    seen = watch(monkeypatch)
    texts = dict([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in brown_lm.score(df.union(df.where("doc_id = 10009")), bit_of_id("doc_id", 7) == 2, common=300).collect()}
    class_of, m = classes_of(texts, seen["rows"]), seen["model"]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    train = [tokens[i] for i in texts if not held[i]] + [tokens[i] for i in (10009,) if not held[i]]
    count, c = Counter(w for ws in train for w in ws), brown_lm.CLASSES
    for w, k in class_of.items():
        assert (k == brown_lm.UNSEEN) == (w not in count) and (k == brown_lm.END_CLASS) == (w is None) and k != brown_lm.REST_CLASS
    pair, one = Counter(), Counter()
    for ws in train:
        for a, b in zip([None, *ws[:-1]], ws, strict=True):
            pair[class_of[a], class_of[b]] += 1
            one[class_of[b]] += 1
    first, n = Counter(), sum(one.values())
    for (a, _), x in pair.items():
        first[a] += x
    size = Counter()
    for w in count:
        size[class_of[w]] += count[w] + 1
    share = lambda k: (one[k] + 1) / (n + c)
    move = lambda j, k: 0.95 * (pair[j, k] + share(k)) / (first[j] + 1) + 0.05 * share(k)
    for i, ws in tokens.items():
        want, j = 0.0, brown_lm.END_CLASS
        for w in ws:
            k = class_of[w]
            if k == brown_lm.UNSEEN:  # the likeliest class for it to be in
                k = max((x for x in size if x < brown_lm.OPEN), key=lambda x: move(j, x) / (size[x] + 1))
            want += math.log10(move(j, k)) + (math.log10((count[w] + 1) / (size[k] + 1)) if w is not None else 0.0)
            j = k
        assert got[i]["score"] == pytest.approx(want, rel=1e-9), i
    assert np.allclose((10**m.transition).sum(axis=1), 1)


@pytest.mark.parametrize("small", [False, True])
def test_every_training_word_has_the_class_of_its_contexts(spark, monkeypatch, small):
    """Rare words, however they are spelt, go to the classes of the common words they stand in for."""
    if small:
        for name, x in (("GROUP", 3000), ("SHARD", 300), ("HELD", 500), ("JUDGED", 64)):
            monkeypatch.setattr(brown_lm, name, x)
    rnd = random.Random(5)
    texts = [" ".join(rnd.sample([f"f{i}" for i in range(520)], 520)) for _ in range(30)] + ["left hx right", "hy up hy"] * 400
    texts += [t for i in range(300) for t in [f"left x{i}zz right", f"y{i}zz up y{i}zz"] * (1 + i % 3)]
    seen = watch(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert brown_lm.score(docs, F.lit(False), common=520).count() == len(texts)
    class_of = classes_of(texts, seen["rows"])
    assert class_of[b"hx"] != class_of[b"hy"] and class_of[None] == brown_lm.END_CLASS
    assert {class_of[b"x%dzz" % i] for i in range(300)} == {class_of[b"hx"]} and {class_of[b"y%dzz" % i] for i in range(300)} == {class_of[b"hy"]}
    # between "left" and "right" a new word is taken for an x
    assert seen["model"].unseen[class_of[b"left"]] == class_of[b"hx"]


def test_unseen_words_follow_one_another():
    rng = np.random.default_rng(8)
    unseen = rng.integers(0, 9, brown_lm.CLASSES)
    for n in (0, 1, 300):
        now = np.where(rng.random(n) < 0.7, brown_lm.UNSEEN, rng.integers(0, 62, n))
        want, j = [], brown_lm.END_CLASS
        for k in now.tolist():
            j = int(unseen[j]) if k == brown_lm.UNSEEN else k
            want.append(j)
        before = brown_lm.settle(now, unseen)
        assert now.tolist() == want and before.tolist() == [brown_lm.END_CLASS, *want[:-1]][: n or 1]


def test_best_classes_match_brute_force():
    rng = np.random.default_rng(4)
    c = brown_lm.CLASSES
    table = rng.poisson(3, (c, c)) * (rng.random((c, c)) < 0.4)
    table[5], table[:, 5] = 0, 0
    at, context, n = rng.integers(0, 30, 400), rng.integers(0, 2 * c, 400), rng.integers(1, 4, 400)
    got = brown_lm.best_classes(at, context, n, 30, table)
    before, after = ((x + 1) / (x.sum() + c) for x in (table.sum(axis=1), table.sum(axis=0)))
    for w in range(30):
        own = np.bincount(context[at == w], n[at == w], 2 * c)
        value = {k: own[:c] @ np.log((table[:, k] + before) / (table[:, k].sum() + 1)) + own[c:] @ np.log((table[k] + after) / (table[k].sum() + 1)) for k in set(range(brown_lm.OPEN)) - {5}}
        assert value[got[w]] == pytest.approx(max(value.values()))
    assert brown_lm.best_classes(at, context, n, 30, table * 0).tolist() == [brown_lm.REST_CLASS] * 30


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    true = rng.integers(0, 4, 40)
    n = rng.poisson(1 + 60 * (true[None, :] == (true[:, None] + 1) % 4))

    def gain(of, k):
        hot = np.eye(k)[of]
        t = hot.T @ n @ hot
        x = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0).sum()
        return x(t) - x(t.sum(axis=0)) - x(t.sum(axis=1))

    of = brown_lm.exchange(n, classes=7, rounds=40)
    start = np.append(np.arange(38) % 5, [5, 6])
    assert gain(of, 7) > gain(start, 7) and of[-2:].tolist() == [5, 6] and (of[:-2] < 5).all()
    for w in range(38):  # no single move helps
        for k in range(5):
            moved = of.copy()
            moved[w] = k
            assert gain(moved, 7) <= gain(of, 7) + 1e-6, (w, k)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert brown_lm.score(none, F.lit(False)).count() == 0
    alone = brown_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (alone["n_known"], alone["train_tokens"]) == (0, 0) and alone["base_score"] == 0.0
