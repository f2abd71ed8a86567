"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a variable, content or not. A node's tag, names, text length and link share speak for
either state; a child tends to have its parent's state. Messages passed up to the root and down again (sum-product) give
each node's exact marginal, and the text of nodes that are more likely content than not is the page's main text. The
tables are counted on a bounded sample of pages labelled by their own article markup."""
from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, FEATURES = 2_000, 5_000
STRONGEST, SMOOTH = 3.0, 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("table ul ol dl td th article body select".split())   # An end tag may be implied up to these
BREAKS = frozenset(("br", "hr", "img"))
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer form header menu modal nav navbar navigation newsletter notice notices popup promo "
                              "related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_NAMES = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "parent", "names", "chars", "linked", "ends")

    def __init__(self, tag, parent, names):
        self.tag, self.parent, self.names, self.chars, self.linked, self.ends = tag, parent, names, 0, 0, False


class Page(HTMLParser):
    """Block nodes in page order, and pieces (node, text); text None is a break. Missing end tags are implied as browsers do."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, ())]
        self.open = [("#root", 0)]   # Open elements: tag and the block node its text belongs to
        self.places: dict[str, list[int]] = {}   # Where a tag stands among the open elements
        self.blocks = [0]   # Where block elements stand among them
        self.links, self.hidden = 0, 0
        self.pieces: list[tuple[int, str | None]] = []
        self.feed(html)
        self.close()

    def _pop(self, to: int):
        block = False
        for tag, _ in self.open[to:]:
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                block = True
        if block:
            self.pieces.append((self.open[to - 1][1], None))
        del self.open[to:]

    def _at(self, tags) -> int:
        """Place of the innermost open element with one of the tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _last(self, tags) -> int:
        k = self._at(tags)
        return k if "p" in tags or k > self._at(WALLS.difference(tags)) else 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in BREAKS:
                self.pieces.append((self.open[-1][1], None))
            return
        if tag == "body" and self.hidden and (k := self._last(("head",))):
            self._pop(k)
        if tag in CLOSES_P and (k := self._last(("p",))):
            self._pop(k)
        if tag in SIBLINGS and (k := self._last(SIBLINGS[tag])):
            self._pop(k)
        at = self.open[-1][1]
        if tag not in INLINE:
            names = tuple(x for k, v in attrs if k in ("class", "id", "role") and v for x in _NAMES.split(v.lower()) if x)
            self.nodes.append(Node(tag, at, names))
            at = len(self.nodes) - 1
            self.pieces.append((at, None))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, at))
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)   # A slash closes nothing in HTML but void elements

    def handle_endtag(self, tag):
        k = self._at((tag,))
        if k:
            if tag not in INLINE or self.blocks[-1] < k:
                self._pop(k)
        elif tag in ("br", "p"):
            self.pieces.append((self.open[-1][1], None))

    def handle_data(self, data):
        if self.hidden:
            return
        at = self.open[-1][1]
        self.pieces.append((at, data))
        stripped = data.strip()
        n, node = len(stripped), self.nodes[at]
        node.chars += n
        if self.links:
            node.linked += n
        if n:
            node.ends = stripped[-1] in ".!?…。"


def features(node: Node) -> list[str]:
    out = ["tag " + node.tag, *("name " + x for x in node.names)]
    if node.chars:
        out += [f"chars {min(12, node.chars.bit_length())}", "links " + ("most" if 2 * node.linked > node.chars else "some" if node.linked else "none"), f"ends {node.ends}"]
    return out


def labels(page: Page) -> list[bool] | None:
    """Content or not by the page's own markup: inside article or main, outside what is named as something else. None where
    the page has no such markup."""
    state: list[tuple[bool, bool]] = []
    for n in page.nodes:
        inside, banned = state[n.parent] if n.parent >= 0 else (False, False)
        state.append((inside or n.tag in CONTENT_TAGS or "main" in n.names, banned or n.tag in BOILERPLATE_TAGS or not BOILERPLATE_NAMES.isdisjoint(n.names)))
    return [a and not b for a, b in state] if any(a for a, _ in state) else None


def tally(html: str) -> Counter:
    page = Page(html)
    found = labels(page)
    out: Counter = Counter()
    for n, y in zip(page.nodes, found or ()):
        out[f"{int(y)} node"] += 1
        for f in features(n):
            out[f"{int(y)} {f}"] += 1
        if n.parent >= 0:
            out[f"{int(y)} under {int(found[n.parent])}"] += 1
    return out


class Model:
    """Log odds of content by feature, and the log odds that a child shares its parent's state; both bounded by STRONGEST, so
    that no single sign decides alone."""

    def __init__(self, counts: dict[str, int]):
        n = [counts.get("0 node", 0) + 2 * SMOOTH, counts.get("1 node", 0) + 2 * SMOOTH]
        self.odds = {}
        for f in {k[2:] for k in counts if not k[2:].startswith(("node", "under"))}:
            self.odds[f] = math.log((counts.get("1 " + f, 0) + SMOOTH) / n[1]) - math.log((counts.get("0 " + f, 0) + SMOOTH) / n[0])
        for prior, names in ((-STRONGEST, ["tag " + t for t in BOILERPLATE_TAGS] + ["name " + x for x in BOILERPLATE_NAMES]), (STRONGEST, ["tag " + t for t in CONTENT_TAGS])):
            for f in names:   # What the labels are defined by is known even if the sample lacks it
                self.odds.setdefault(f, prior)
        bound = lambda x: max(-STRONGEST, min(STRONGEST, x))
        self.odds = {f: bound(v) for f, v in self.odds.items()}
        under = [[counts.get(f"{y} under {p}", 0) + SMOOTH for y in (0, 1)] for p in (0, 1)]
        stay = [bound(math.log(under[p][p] / under[p][1 - p])) for p in (0, 1)]
        self.to = [[1 / (1 + math.exp(-stay[0])), 1 / (1 + math.exp(stay[0]))], [1 / (1 + math.exp(stay[1])), 1 / (1 + math.exp(-stay[1]))]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of every node; parents stand before their children."""
        (t00, t01), (t10, t11) = self.to
        get = self.odds.get
        up = []
        for n in nodes:   # Evidence, as a probability
            s = sum(get(f, 0.0) for f in features(n))
            up.append(1 / (1 + math.exp(-max(-40.0, min(40.0, s)))))
        own = up.copy()
        sent = [(0.5, 0.5)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):   # Upward: what the subtree of i says about its parent
            b = own[i]
            m0, m1 = t00 * (1 - b) + t01 * b, t10 * (1 - b) + t11 * b
            sent[i] = m0, m1
            p = nodes[i].parent
            a = own[p]
            own[p] = min(1 - 1e-15, max(1e-15, a * m1 / (a * m1 + (1 - a) * m0)))
        out = own.copy()
        for i in range(1, len(nodes)):   # Downward: the parent's marginal without what i itself said
            m0, m1 = sent[i]
            q = out[nodes[i].parent]
            r1, r0 = q / m1, (1 - q) / m0
            r1, r0 = r1 / (r1 + r0), r0 / (r1 + r0)
            e1, e0 = (r0 * t01 + r1 * t11), (r0 * t00 + r1 * t10)
            b = own[i]
            out[i] = min(1 - 1e-15, max(1e-15, b * e1 / (b * e1 + (1 - b) * e0)))
        return out

    def text(self, html: str) -> str:
        page = Page(html)
        keep = [m > 0.5 for m in self.marginals(page.nodes)]
        return " ".join("".join(" " if t is None else t if keep[i] else "" for i, t in page.pieces).split())


def train(pages: DataFrame, key: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """Count the tables on about sample_pages pages, chosen by a hash of the key. The driver holds the FEATURES
    commonest after counts are summed."""
    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for h in b.column(0).to_pylist():
                total.update(tally(h or ""))
        top = list(total.items())   # As many as the bounded sample has
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["feature", "n"])

    step = max(1, pages.count() // sample_pages)
    sample = pages.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(html)
    rows = sample.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "feature").limit(FEATURES)
    return Model({r.feature: r.n for r in rows.collect()})


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text (empty if there is none) and n_chars of every row; null pages are empty."""
    def run(batches):
        for b in batches:
            out = [model.text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[key, url, "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
