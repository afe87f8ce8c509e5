"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and ids (digits aside)
are one element node, and the same text in one is one content node. An element's presentation importance is
the entropy of the child sequences that its pages use, a content node's importance is how little its text
repeats over the pages that have the element; both are combined from the leaves up, with fewer style nodes
leaving more to the children. Content nodes of low importance on most of these pages, and branches of low importance
with nothing else below them, are noise and are removed from each page, inside articles and outside.

Copies of an article are not a layout: pages of a host with one fingerprint (a hash of the longest
block) are merged once, and where removal would take more than half of a page's text, the page is taken for
a copy and its running text is spared. Elements whose tag, role, class or id names a menu, header, footer,
sidebar, notice, advert, form or comment have importance 0 from the start, since their texts may vary.

What is left of a page is its articles, else its main element, else its body, as blocks in page order.
A page's features travel once, to meet copies of it; then counts are added up before they are shuffled.
A host's merged tree holds the nodes of MIN_PAGES pages or more, and only its noise travels to the pages.

Defined results: null or empty html has no text; a null url, or one without a host, shares a tree with
others like it; unclosed and misnested elements close as browsers close them, except that formatting is
not reopened; a tag or comment that the page's end cuts short is dropped; very long pages are parsed whole;
repeated rows are merged once and extracted one by one; of pages with one fingerprint the one with the least
digest is merged; a null page_id stays null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, map_runs
from tessera.llm.textkern import pieces

GAMMA = 0.9
#: Nodes below this importance that occur on so many pages are noise.
NOISE = 0.25
MIN_PAGES = 8
#: Of the pages that have an element, the share on which a text of its own is part of the layout.
SHARED = 0.5
#: Distinct counts that a task holds before it passes them on.
HELD = 200_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[a-z]+|[0-9]+")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {  # a start tag of the key closes an open element of the values
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("html body article main section aside div table ul ol dl nav header footer form td th".split())
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template button select textarea iframe svg math object canvas dialog menu audio video title input fieldset noembed noframes xmp".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus respond replies widget toolbar pagination pager form search".split()
)
#: Noise only outside articles: inside, a header holds the title.
OUTER_TAGS, OUTER_NAMES = frozenset(["header"]), frozenset(["header"])
#: Running text, which copies of a page keep.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


class Page:
    """A parsed page: nodes as parallel lists, and texts as (node, text) with None between blocks."""

    def __init__(self, html: str) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.key: list[int] = [0]
        self.level: list[int] = [0]
        self.block: list[int] = [0]
        self.noise: list[bool] = [False]
        self.article: list[bool] = [False]
        self.main: list[bool] = [False]
        self.children: list[list[str]] = [[]]
        self.texts: list[tuple[int, str] | None] = []
        self.open: dict[str, int] = defaultdict(int)  # elements on the stack, by tag
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, at = [0], 0
        lowered = None
        end = len(html)
        while at < end:
            m = TAG.search(html, at)
            if m is None:
                self._text(stack[-1], html[at:])
                break
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None or not m[4]:
                continue
            name = name.lower()
            if m[1]:
                self._close(stack, name)
                continue
            self._make_room(stack, name)
            node = self._open(stack[-1], name, m[3])
            if name not in INLINE:
                self.texts.append(None)
            elif name == "br":
                self.texts.append((stack[-1], " "))
            if name in RAW:
                if lowered is None:
                    lowered = html.lower() if len(html.lower()) == len(html) else html
                found = lowered.find(f"</{name}", at)
                at = end if found < 0 else found
                self._push(stack, node)
            elif name not in VOID and not (m[3].endswith("/") and name in ("svg", "math")):
                self._push(stack, node)

    def _text(self, node: int, text: str) -> None:
        self.texts.append((node, text))

    def _open(self, parent: int, name: str, raw: str) -> int:
        names, role, hidden, look = frozenset(), "", False, ""
        if raw and not raw.isspace():
            given = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(raw)}
            look = f"{given.get('class', '')}#{given.get('id', '')}".lower()
            names = frozenset(TOKEN.findall(look))
            role = given.get("role", "").lower()
            hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        inside = self.article[parent] or self.main[parent]
        noise = self.noise[parent] or name in NOISE_TAGS or role in NOISE_ROLES or hidden
        if name not in ("html", "body", "main"):
            noise = noise or not names.isdisjoint(NOISE_NAMES) or (not inside and (name in OUTER_TAGS or not names.isdisjoint(OUTER_NAMES)))
        level = self.level[parent] + 1
        style = f"{name}.{DIGITS.sub('0', look)}" if look else name
        self.parent.append(parent)
        self.tag.append(name)
        self.level.append(level)
        self.key.append(_hash(self.key[parent], style))
        self.block.append(self.block[parent] if name in INLINE else len(self.block))
        self.noise.append(noise)
        self.article.append(self.article[parent] or (name == "article" and not noise))
        self.main.append(self.main[parent] or name == "main" or role == "main")
        self.children[parent].append(style)
        self.children.append([])
        return len(self.parent) - 1

    def _push(self, stack: list[int], node: int) -> None:
        stack.append(node)
        self.open[self.tag[node]] += 1

    def _pop_to(self, stack: list[int], at: int) -> None:
        for x in stack[at:]:
            self.open[self.tag[x]] -= 1
        if any(self.tag[x] not in INLINE for x in stack[at:]):
            self.texts.append(None)
        del stack[at:]

    def _close(self, stack: list[int], name: str) -> None:
        for i in () if not self.open[name] else range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == name:
                self._pop_to(stack, i)
                return
            if tag in SCOPES and (name in INLINE or name in ("p", "li")):
                break
        if name == "p":
            self.texts.append(None)

    def _make_room(self, stack: list[int], name: str) -> None:
        closed = CLOSES.get(name, ())
        if not self.open["p"] and not any(self.open[x] for x in closed):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in closed or (tag == "p" and name not in INLINE and name not in RAW):
                self._pop_to(stack, i)
                if tag == "p":
                    return
                closed = closed if name in ("tr", "tbody", "tfoot") else ()
                if not closed:
                    return
            elif tag in SCOPES and tag not in closed:
                return

    def contents(self) -> dict[int, str]:
        """The own text of each element, that of its inline elements included, if there is any."""
        own: dict[int, list[str]] = defaultdict(list)
        for piece in self.texts:
            if piece is not None:
                own[self.block[piece[0]]].append(piece[1])
        return {i: text for i, x in own.items() if (text := " ".join("".join(x).split()))}

    def marked(self, low: frozenset[int], running: bool = False) -> list[bool]:
        """Per node, whether its text is removed; with running, running text stays."""
        spared = [running and x in RUNNING for x in self.tag]
        for i in range(len(spared) - 1, 0, -1):  # and so does what holds it
            if spared[i] and not self.noise[i]:
                spared[self.parent[i]] = True
        out = list(self.noise)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]] or (self.key[i] in low and self.tag[i] not in ("html", "body") and not spared[i])
        texts = {i for i, x in self.contents().items() if not spared[i] and _hash(self.key[i], x) in low}
        return [x or self.block[i] in texts for i, x in enumerate(out)] if texts else out

    def blocks(self, low: frozenset[int] = frozenset()) -> list[str]:
        """The kept blocks: without noise unless that takes more than half of the text, as on copies of one
        page; then without noise that is no running text; and if there is no other text, all."""
        whole = self._within(self.noise)
        if not low:
            return whole
        room = sum(map(len, whole))
        for running in (False, True):
            kept = self._within(self.marked(low, running))
            if 2 * sum(map(len, kept)) >= room:
                return kept
        return kept or whole

    def fingerprint(self) -> int:
        """A hash of the longest block before the tree is known: alike for most near copies of a page."""
        return _hash(max(self._within(self.noise), key=len, default=""))

    def _within(self, gone: list[bool]) -> list[str]:
        """Of the blocks not gone: those of the articles if they have text, else of main, else of the body."""
        for within in (self.article, self.main, None):
            found, now = [], []
            for piece in [*self.texts, None]:
                if piece is None or gone[piece[0]] or (within is not None and not within[piece[0]]):
                    if now and (text := " ".join(html_module.unescape("".join(now)).split())):
                        found.append(text)
                    if piece is None or now:
                        now = []
                else:
                    now.append(piece[1])
            if found:
                return found
        return []

    def features(self) -> np.ndarray:
        """Distinct rows (key, parent key, level, hash of the child sequence, content key or 0) of the block
        elements outside noise. A content key is a hash of the element's key and its text."""
        own = self.contents()
        rows = set()
        for i in range(1, len(self.tag)):
            if not self.noise[i] and self.tag[i] not in INLINE:
                look = _hash(*[x for x in self.children[i] if x.split(".")[0] not in INLINE])
                rows.add((self.key[i], self.key[self.parent[i]], self.level[i], look, _hash(self.key[i], own[i]) if i in own else 0))
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def host_of(url) -> F.Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


_COUNTS = "host string, key long, parent long, level int, kind int, value long, n long"


def _features(pages: DataFrame) -> DataFrame:
    """(host, print, digest, rows): features of each page."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                prints, digests, rows = [], [], []
                for html in part.column(1).to_pylist():
                    page = Page(html or "")
                    rows.append(page.features().tobytes())
                    prints.append(page.fingerprint())
                    digests.append(xxhash.xxh64_intdigest(rows[-1]) - (1 << 63))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64()), pa.array(digests, pa.int64()), pa.array(rows, pa.binary())], names=["host", "print", "digest", "rows"])

    return pages.select("host", "html").mapInArrow(apply, "host string, print long, digest long, rows binary")


def _counts(features: DataFrame) -> DataFrame:
    """(host, key, parent, level, kind, value, n): pages that have the node (kind 0), that have it with a
    child sequence (1) and with a text (2)."""

    def out(held: dict) -> pa.RecordBatch:
        columns = list(zip(*((*k, n) for k, n in held.items()), strict=True)) or [()] * 7
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _COUNTS.split(", ")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for host, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                for key, parent, level, look, text in np.frombuffer(raw, np.int64).reshape(-1, 5).tolist():
                    seen |= {(host, key, parent, level, 0, 0), (host, key, parent, level, 1, look)}
                    if text:
                        seen.add((host, key, parent, level, 2, text))
                for x in seen:
                    held[x] += 1
                if len(held) >= HELD:
                    yield out(held)
                    held.clear()
        yield out(held)

    return features.select("host", "rows").mapInArrow(apply, _COUNTS)


def importances(nodes: list[tuple[int, int, int, int, float, int, float, int]]) -> dict[int, float]:
    """Composite importance of each element key, from rows (key, parent, level, pages, presentation
    entropy in nats, child sequences, sum of ln(pages of a text) over texts, texts). A row without sequences
    stands for a node that is important by itself."""
    below: dict[int, list[tuple[float, float]]] = defaultdict(list)
    found: dict[int, float] = {}
    for key, parent, _, m, entropy, sequences, spread, texts in sorted(nodes, key=lambda x: -x[2]):
        if m <= 1 or not sequences:
            value = 1.0
        else:
            parts = list(below.get(key, ()))
            if texts:
                parts.append((m, 1 - spread / texts / math.log(m)))
            look = entropy / math.log(m)
            weight = sum(w for w, _ in parts)
            inner = sum(w * x for w, x in parts) / weight if weight else look
            share = GAMMA**sequences
            # a leaf is its texts alone
            value = inner if not below.get(key) else (1 - share) * look + share * inner
        found[key] = value
        below[parent].append((m, value))
    return found


def low_keys(rows: list[dict]) -> list[int]:
    """The keys of the branches of low importance that hold no node of another kind."""
    nodes, fillers = [], 0
    for r in rows:
        fillers += r["sequences"] == 0
        nodes.append((r["key"] if r["sequences"] else -fillers, r["parent"], r["level"], r["m"], r["entropy"], r["sequences"], r["spread"], r["texts"]))
    found = importances(nodes)
    high: set[int] = set()
    for key, parent, *_ in sorted(nodes, key=lambda x: -x[2]):
        if key in high or found[key] >= NOISE:
            high |= {key, parent}
    return sorted(x[0] for x in nodes if x[0] not in high)


def noise_nodes(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree_host, low): the keys of each host's branches and content nodes of low importance."""
    once = _features(pages).groupBy("host", "print").agg(F.min_by("rows", "digest").alias("rows"))
    counts = scratch.write(_counts(once).groupBy("host", "key", "parent", "level", "kind", "value").agg(F.sum("n").alias("n")), "counts")
    ln = F.log("n")
    looks, texts = (F.col("kind") == k for k in (1, 2))
    nodes = counts.groupBy("host", "key", "parent", "level").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(looks, F.col("n"))).alias("used"),
        F.sum(F.when(looks, F.col("n") * ln)).alias("nln"),
        F.sum(looks.cast("long")).alias("sequences"),
        F.sum(F.when(texts, ln).otherwise(0.0)).alias("spread"),
        F.sum(texts.cast("long")).alias("texts"),
    )
    nodes = scratch.write(nodes, "nodes")
    # nodes on few pages are sure to be kept; their parents only need to know how often there are any
    few = nodes.where(F.col("m") < MIN_PAGES).groupBy("host", "parent", "level").agg(F.sum("m").alias("m"))
    zero = lambda name, kind: F.lit(0).cast(kind).alias(name)
    few = few.select("host", zero("key", "long"), "parent", "level", "m", zero("entropy", "double"), zero("sequences", "long"), zero("spread", "double"), zero("texts", "long"))
    several = nodes.where(F.col("m") >= MIN_PAGES).select("host", "key", "parent", "level", "m", (F.log("used") - F.col("nln") / F.col("used")).alias("entropy"), "sequences", "spread", "texts")
    tree = several.union(few).select(F.xxhash64("host").alias("h"), "*")

    def judge(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, list[dict]] = defaultdict(list)
        for b in run:
            for r in b.to_pylist():
                by_host[r["host"]].append(r)
        found = {host: low_keys(rows) for host, rows in by_host.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["tree_host", "low"])

    branches = map_runs(tree, ["h"], [], judge, "tree_host string, low array<long>")
    repeated = counts.where((F.col("kind") == 2) & (F.col("n") >= MIN_PAGES)).select(F.col("host").alias("ch"), F.col("key").alias("ck"), "value", "n")
    own = repeated.join(nodes.where(F.col("m") >= MIN_PAGES).select("host", "key", "m"), (F.col("host") == F.col("ch")) & (F.col("key") == F.col("ck")))
    contents = own.where((F.lit(1) - F.log("n") / F.log("m") < NOISE) & (F.col("n") >= SHARED * F.col("m"))).groupBy("host").agg(F.collect_list("value").alias("low")).select(F.col("host").alias("tree_host"), "low")
    both = branches.union(contents).groupBy("tree_host").agg(F.flatten(F.collect_list("low")).alias("low")).where(F.size("low") > 0)
    return scratch.write(both, "noise")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text (blocks joined by a line feed) and n_chars."""
    scratch = Scratch(pages.sparkSession, "style")
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    low = noise_nodes(given, scratch)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                texts = ["\n".join(Page(h or "").blocks(frozenset(x or ()))) for h, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    both = given.join(low, F.col("host") == F.col("tree_host"), "left").select("page_id", "url", "html", "low")
    return both.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
