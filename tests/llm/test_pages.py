"""WARC archives, main texts and mixing, and the pipeline as a whole."""

import base64
import hashlib
import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import hyperminhash, mixing, nbsvm, style_tree, warc_zstd
from tessera.llm.shared import Scratch

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", None), (4, "http://a", ""), (None, "http://n", "<p>x</p>"), (9, "é", "漢字" * 3000), (5, "z", "<p>x</p>"), (1, "again", "<p>x</p>"), (7, "7", "WARC/1.1\r\n\r\n")]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_zstd, "ARCHIVE", 300)
    pages = spark.createDataFrame([(*r, "odd") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    scratch = Scratch(spark, "warc")
    manifest = scratch.write(warc_zstd.write_archives(pages, scratch.path("archives")), "manifest")
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES) and manifest.count() > 3
    got = sorted(map(tuple, warc_zstd.read_archives(spark, scratch.path("archives")).collect()), key=str)
    want = []
    for i, url, html in PAGES:
        raw = (html or "").encode()
        first = min((p for p, _, h in PAGES if p is not None and (h or "") == (html or "")), default=None)
        again = i is not None and i != first
        want.append((i, url and url.replace("\r", "%0D").replace("\n", "%0A"), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None, None if again else bytearray(raw)))
    assert got == sorted(want, key=str)
    assert warc_zstd.round_trip(pages.limit(0)).count() == 0
    large = warc_zstd.round_trip(pages, least=100)
    assert large.where("record_type = 'revisit'").count() == 0


def archive(*records, dictionary=b"some words of a dictionary"):
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return warc_zstd.dictionary_frame(dictionary) + b"".join(coder.compress(r) for r in records)


def test_warc_reader_validates():
    good = warc_zstd.page_record(1, "u", b"<p>" * 99, None)
    assert [warc_zstd.page_of(r)["page_id"] for _, r in warc_zstd.frames(archive(good, good))] == [1, 1]
    packed = zstandard.ZstdCompressor().compress(b"some words of a dictionary")
    body = archive(good)[8 + 26 :]
    assert len(list(warc_zstd.frames(warc_zstd.dictionary_frame(packed) + body))) == 1
    for bad in (b"", archive(good)[10:], archive(good)[:-3], archive(good) + b"junk", archive(good)[:40] + b"\xff" + archive(good)[41:]):
        with pytest.raises(warc_zstd.WarcError):
            list(warc_zstd.frames(bad))
    for broken in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Data"), good[:-1], good.replace(b"<p><p>", b"<q><p>", 1), good.replace(b"Content-Length: 342", b"Content-Length: 9")):
        if broken != good:
            with pytest.raises(warc_zstd.WarcError):
                warc_zstd.page_of(broken)
    revisit = warc_zstd.page_record(2, "u", b"x", 1)
    assert warc_zstd.page_of(revisit)["refers_to"] == 1 and warc_zstd.page_of(revisit)["payload_bytes"] == 1


def blocks(html):
    return style_tree.Page(html).blocks()


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div id=cookie-banner>We use</div>
      <main><article class="post"><header><h1>T &amp; x&hellip;</h1></header><p>One <b>two</b>three<p>Four<br>five &lt;b&gt;<ul><li>a<li>b</ul><div class="share">S</div><div hidden>h</div>
      <section id="comments"><article><p>c1</p></article></section><form><input>f</form><aside>sb</aside><!-- no <p> --><script>if(a<b){"</p>"}</script></article></main><footer>f</footer>"""
    assert blocks(page) == ["T & x…", "One twothree", "Four five <b>", "a", "b"]
    assert blocks("") == [] and blocks("plain\n text") == ["plain text"] and blocks("<p>a<p>b<div>c</div>d") == ["a", "b", "c", "d"]
    assert blocks("<body><p>a < b <a href='x>y'>l</a><!-- cut") == ["a < b l"] and blocks("<p>end<di") == ["end"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>x") == ["1", "2", "3", "x"]
    assert blocks("<article></article><p>else</p>") == ["else"] and blocks("<ARTICLE><P>Up</P></ARTICLE><p>out") == ["Up"]
    assert blocks("<script>never closed <p>x") == [] and blocks("</p></div>x</b>") == ["x"]
    assert blocks("<p>" * 3000 + "deep" + "<div>" * 3000) == ["deep"]


def test_style_tree_finds_noise(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(999)]
    rows, want = [], {}
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(30))
        want[i] = text if i % 2 else "Same article"
        body = f"<p>{text}</p>" if i % 2 else "<p>Same article</p>"
        inner = f"<div class=story>{body}</div>" if i < 100 else f"<article>{body}</article>"
        rows.append((i, f"http://Host.example:80/{i}", f"<body><div class=top><span>Welcome to the site</span></div>{inner}<div class=low><p>All rights kept</p></div></body>"))
    rows += [(200, "http://other/", "<body><div class=top>Welcome to the site</div></body>"), (201, None, None)]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
    assert all("Welcome" not in got[i] for i in range(120))
    # a page whose own text is the smaller part is taken for a copy, and its running text stays
    assert all(got[i] == want[i] if i % 2 or i >= 100 else got[i] == "Same article\nAll rights kept" for i in range(120))
    assert got[200] == "Welcome to the site" and got[201] == ""
    assert style_tree.extract(pages.limit(0)).count() == 0


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def site(kind, n=40, seed=2):
    """(html, wanted text) of n pages of a site."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        body = [words(rnd, rnd.randint(12, 40)) for _ in range(rnd.randint(2, 5))]
        ps = "".join(f"<p>{x}</p>" for x in body)
        if kind == "plain":  # no article, and names that say nothing
            html = f"<body><div class=x1><a href=/>Home</a> <a href=/n>News</a></div><div class=x2 id=p{i}>{ps}</div><div class=x3><p>All rights kept by us</p><ul><li>Terms<li>Privacy</ul></div></body>"
        elif kind == "inside":  # boilerplate of unlisted names, and none, inside the article
            html = f"<body><article><div class=x7>Read this in our app</div><h1>{body[0]}</h1>{ps}<p>Thank you for reading our pages</p><div class=x8><p>More from {rnd.choice('AB')}</p></div></article></body>"
            body = [body[0], *body]
        else:  # copies of one article, each with a block of its own
            same = random.Random(99)
            body = [words(same, 30) for _ in range(4)] + [words(rnd, 5)]
            html = "<body><div class=x1>Home</div><article>" + "".join(f"<p>{x}</p>" for x in body) + "</article></body>"
        out.append((html, "\n".join(body)))
    return out


@pytest.mark.parametrize("kind", ["plain", "inside", "copies"])
def test_the_tree_decides(spark, kind):
    """Without the tree the text is another one, unless the pages are copies; with it it is right."""
    pages = site(kind)
    df = spark.createDataFrame([(i, f"https://{kind}.org/{i}", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(df).collect()}
    for i, (html, want) in enumerate(pages):
        assert got[i] == want
        assert ("\n".join(blocks(html)) == want) == (kind == "copies")


def brute_noise(pages):
    """Keys of noise by a plain merge of pages (html), one host."""
    seen = {}
    for html in pages:
        p = style_tree.Page(html)
        raw = p.features().tobytes()
        digest = style_tree.xxhash.xxh64_intdigest(raw) - (1 << 63)
        seen[p.fingerprint()] = min(seen.get(p.fingerprint(), (digest, raw)), (digest, raw))
    rows = [set(map(tuple, style_tree.np.frombuffer(raw, "int64").reshape(-1, 5).tolist())) for _, raw in seen.values()]
    keys = {r[0]: (r[1], r[2]) for page in rows for r in page}
    on = {k: [{r for r in page if r[0] == k} for page in rows] for k in keys}
    on = {k: [x for x in v if x] for k, v in on.items()}
    low, value = set(), {}

    def count(k, at):
        out = {}
        for x in on[k]:
            for v in {r[at] for r in x} - {0}:
                out[v] = out.get(v, 0) + 1
        return out

    def judge(k):
        """(importance, whether all below is low)"""
        m = len(on[k])
        below = [(len(on[c]), *judge(c)) for c in keys if keys[c][0] == k]
        if m < style_tree.MIN_PAGES:
            return 1.0, False
        looks, texts = count(k, 3), count(k, 4)
        n = sum(looks.values())
        look = -sum(x / n * math.log(x / n) for x in looks.values()) / math.log(m)
        parts = [(w, x) for w, x, _ in below] + ([(m, sum(1 - math.log(x) / math.log(m) for x in texts.values()) / len(texts))] if texts else [])
        inner = sum(w * x for w, x in parts) / sum(w for w, _ in parts) if parts else look
        share = style_tree.GAMMA ** len(looks)
        x = (1 - share) * look + share * inner if below else inner
        value[k] = x
        for text, hits in texts.items():
            if hits >= max(style_tree.MIN_PAGES, m / 2) and 1 - math.log(hits) / math.log(m) < style_tree.NOISE:
                low.add(text)
        quiet = x < style_tree.NOISE and all(q for *_, q in below)
        if quiet:
            low.add(k)
        return x, quiet

    for k in keys:
        if keys[k][0] == 0:
            judge(k)
    return low


def test_tree_matches_a_plain_merge(spark):
    hosts = {kind: [h for h, _ in site(kind)] for kind in ("plain", "inside", "copies")}
    hosts["mixed"] = [h for k in hosts for h in hosts[k][:25]] + ["", "<p>x</p>", "<nav>n</nav>"] + hosts["plain"][:3]
    hosts["deep"] = ["<div>" * 60 + f"<p>{words(random.Random(i), 9)}</p>" + "</div>" * 30 + "<p>always the same</p>" for i in range(20)]
    rows = [(i, f"https://{host}/", h) for host, pages in hosts.items() for i, h in enumerate(pages)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    given = pages.select("page_id", "url", "html", style_tree.host_of(F.col("url")).alias("host"))
    got = {r.tree_host: r.low for r in style_tree.noise_nodes(given, Scratch(spark, "t")).collect()}
    for host, some in hosts.items():
        want = brute_noise(some)
        assert len(got.get(host, [])) == len(set(got.get(host, []))) and set(got.get(host, [])) == want, host
    assert got["deep"] and got["plain"] and got["inside"]


def test_importance():
    # a node on all pages with one text and one layout; one with as many texts as pages
    rows = [(1, 0, 1, 100, 0.0, 1, math.log(100), 1), (2, 0, 1, 100, 0.0, 1, 0.0, 100), (3, 0, 1, 1, 0.0, 1, 0.0, 1)]
    got = style_tree.importances(rows)
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(1) and got[3] == 1
    nested = style_tree.importances([(1, 0, 1, 64, 0.0, 1, 0.0, 0), (2, 1, 2, 64, 0.0, 1, 0.0, 64)])
    assert nested[1] == pytest.approx(0.9 * 1.0)  # one style node leaves 0.9 of it to the child


def mix_by_hand(rows, exponent, budget):
    """copies by (source) whole readings and the tokens of its last part"""
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    t = sum(total.values())
    z = sum((v / t) ** exponent for v in total.values())
    return {s: ((v / t) ** exponent / z, int((v / t) ** exponent / z * budget / v + 1e-9)) for s, v in total.items()}


@pytest.mark.parametrize("how", [{}, {"budget": "cover", "repeats": 2.0}, {"entropy": 0.99, "repeats": None, "budget": 3000}])
def test_mixing(spark, monkeypatch, how):
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 11}", rnd.choice([1, 2, 5, 9])) for i in range(1200)] + [(5000 + i, None, 4) for i in range(30)]
    docs = spark.createDataFrame([(i, s, "w " * n, 1) for i, s, n in rows], "doc_id long, source string, text string, copies int")
    got = mixing.mixture(docs, **how).collect()
    scratch = Scratch(spark, "t")
    sources = scratch.write(docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("tokens")), "s")
    found = mixing.temperature(sources, how.get("entropy", mixing.ENTROPY), how.get("repeats", mixing.REPEATS), how.get("budget"))
    shares = [r["tokens"] for r in sources.collect()]
    t = sum(shares)

    def entropy(a):
        w = [(x / t) ** a for x in shares]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= how.get("entropy", mixing.ENTROPY) * math.log(len(shares)) else (lo, mid)
    if how.get("budget") != "cover":
        assert found.exponent == pytest.approx(1.0 if entropy(1.0) >= how.get("entropy", mixing.ENTROPY) * math.log(len(shares)) else lo, abs=1e-6)
    plan = mix_by_hand(rows, found.exponent, found.budget)
    used = {}
    for r in got:
        w, epochs = plan[r["source"]]
        assert r["weight"] == pytest.approx(w) and r["copies"] in (epochs, epochs + 1) and r["n_tokens"] == dict((i, n) for i, _, n in rows)[r["doc_id"]]
        used[r["source"]] = used.get(r["source"], 0) + r["copies"] * r["n_tokens"]
    for s, n in used.items():  # within the budget, and no document of any size is missing from it
        assert plan[s][0] * found.budget - 10 <= n <= plan[s][0] * found.budget + 1e-6
    if how.get("budget") == "cover":
        assert min(r["copies"] for r in got) == 1 and max(used[s] / sum(n for _, x, n in rows if x == s) for s in used) <= 2.0 + 1e-6
    out = mixing.mix(docs, **how)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_copies_of_one_page_keep_their_text(spark):
    """Without article or main, and without other pages, copies say nothing of what repeats; with other
    pages beside them their menus go and their text stays."""
    menu = "<div class=x><div><a href=/a>Home</a></div></div>"
    plain, bare = f"<body>{menu}<div><h2>Title</h2><p>One text.</p><p>Two texts.</p></div></body>", "<body><div>Only this.</div></body>"
    rows = [(i, "http://p.org/", plain) for i in range(12)] + [(100 + i, "http://b.org/", bare) for i in range(12)] + [(200 + i, "http://m.org/", plain) for i in range(12)]
    rows += [(300 + i, "http://m.org/", f"<body>{menu}<div><p>Other text {i} and more of it {i * i}.</p></div></body>") for i in range(30)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(12)} == {"Home\nTitle\nOne text.\nTwo texts."} and {got[100 + i] for i in range(12)} == {"Only this."}
    assert {got[200 + i] for i in range(12)} == {"Title\nOne text.\nTwo texts."} and got[303] == "Other text 3 and more of it 9."


def test_schedule_mixes_at_all_times(spark):
    """Epochs are permuted, each in its own order; every stretch of the schedule has the sources' weights."""
    rnd = random.Random(3)
    rows = [(i, "a" if i % 10 < 8 else "bc"[i % 2], " ".join(["w"] * rnd.choice([5, 10, 15]))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(mixing.schedule(docs, budget="cover").collect(), key=lambda r: (r["time"], r["source"], r["block"], r["place"]))
    total, weight = sum(r["n_tokens"] for r in got), {r["source"]: r["weight"] for r in got}
    assert all(0 <= r["time"] <= 1 for r in got)
    for k in range(4):
        part = got[k * len(got) // 4 : (k + 1) * len(got) // 4]
        tokens = sum(r["n_tokens"] for r in part)
        assert tokens == pytest.approx(total / 4, rel=0.03)
        for s, w in weight.items():
            assert sum(r["n_tokens"] for r in part if r["source"] == s) / tokens == pytest.approx(w, rel=0.15)
    by_epoch = {}
    for r in got:
        if r["source"] == "b":
            by_epoch.setdefault(r["epoch"], []).append(r["doc_id"])
    first, second = by_epoch[1], by_epoch[2]
    assert len(set(first)) == len(first) and set(second) <= set(first) and second != [x for x in first if x in set(second)]
    assert first != sorted(first)
    # mix writes this order
    written = [r["doc_id"] for r in mixing.mix(docs, budget="cover").collect()]
    assert written == [r["doc_id"] for r in got]


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, "b", "x y"), (2, "b", "x y"), (None, "b", "z")], "doc_id long, source string, text string")
    got = sorted((r["doc_id"] or -1, r["copies"]) for r in mixing.mixture(blank, budget="cover").collect())
    assert got == [(-1, 1), (1, 1), (2, 1), (2, 1)]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, now, sizes = Scratch(spark, "t"), docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, scratch.write(stage(spark, now, sf), f"s{k}")
        sizes.append(now.count())
        if k < 4:
            assert now.schema.simpleString() == docs.schema.simpleString(), name
        assert now.select(*docs.columns).distinct().join(before.select(*docs.columns).distinct(), docs.columns, "left_anti").count() == 0
        if k == 2:
            found = hyperminhash.near_duplicates(before)
            assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in found.where("kept").collect()}
            assert hyperminhash.near_duplicates(now).where("NOT kept").count() == 0
        if k == 3:
            assert now.select("doc_id").distinct().count() == sizes[2] <= sizes[3] <= 2 * sizes[2]
    assert sizes[0] < 1000 and sizes[2] < sizes[1] <= sizes[0] and sizes[4] == sizes[3]
    assert now.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = nbsvm.fit(docs, labels, F.lit(True))
    good = labels.where("quality = 1").join(nbsvm.keep_good(docs, model), "doc_id")
    assert good.count() > 0.97 * labels.where("quality = 1").count()


def test_pipeline_edges(spark):
    sf = "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars BETWEEN 600 AND 3000").limit(6)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "a", 0), (7, "x", None, None, None), (8, "漢字 " * 4000, "zz", "b", 1)], good.schema)
    clash = good.unionByName(odd).withColumns({c: F.lit("mine") for c in ("copies", "score", "kept", "id", "slot", "epoch", "component_id", "turn")})
    for docs in (good.limit(0), clash, odd):
        now = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = Scratch(spark, "edge").write(stage(spark, now, sf), "stage")
            if k < 4:
                assert now.columns == docs.columns
        assert now.count() >= 0 and now.where("NOT round_trip").count() == 0
