"""Main text of web pages by a tree-structured graphical model over the DOM.

A page's block elements are binary variables (content or not) on the DOM's tree. A node's potential comes from its tag,
its class, id and role words, and its own text; potentials between parent and child favour equal labels as far as
training says, those between the page's frame (html, body) and its parts having weights of their own. Sum-product messages, once upward and once downward, give every node's exact content marginal; blocks of
nodes at 0.5 and above are the text. The weights are trained by maximum likelihood, gradients from the same messages,
on labelled pages that page_examples() generates (articles of many layouts with menus, notices, adverts, forms, comments
and the like around and inside them); no page of the table is learned from.

Cases: null html is empty; a page without content has empty text; broken and cut-off markup is read leniently (an
unfinished tag at the end is no text, an unclosed script runs to the end); repeated rows are extracted each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|object|canvas|audio|video|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br hr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font hr i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr area base col embed input link meta param source track".split())
#: An opening tag closes these, up to the nearest of the second group.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
LABEL = re.compile(r'data-content="([01])"')
FRAME = frozenset(("html", "body"))
GROUPS = ("html body", "head title", "nav menu", "header", "footer", "aside", "form fieldset button", "article main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "blockquote pre figure figcaption", "table tbody thead tr td th", "dialog details summary address")
TAG_OF = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
#: Parts of class, id and role words.
CONTENT_WORDS = ("article", "content", "post", "entry", "story", "main", "body", "text")
OTHER_WORDS = (
    "nav menu breadcrumb toc pager pagination skip", "header masthead topbar banner", "footer bottom copyright legal", "side aside widget rail", "ad ads advert advertisement sponsor sponsored promo promotion", "cookie consent notice gdpr alert popup modal overlay toast notification",
    "comment comments reply replies respond disqus discussion feedback", "share sharing social follow", "related recommended more-stories popular trending teaser", "newsletter subscribe signup login form search", "byline author meta tags categories date",
)
OTHER = {w: i for i, g in enumerate(OTHER_WORDS) for w in g.split()}
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
N_TAGS, N_OTHER = len(GROUPS) + 1, len(OTHER_WORDS)
N = N_TAGS + 1 + N_OTHER + 6
SEED, N_EXAMPLES, EPOCHS, STEP = 5, 520, 14, 0.4


class Node:
    __slots__ = ("tag", "attrs", "parent", "chars", "link", "stops", "label", "x", "up", "down", "edge")

    def __init__(self, tag: str, attrs: str, parent: int):
        self.tag, self.attrs, self.parent, self.chars, self.link, self.stops = tag, attrs, parent, 0, 0, 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents before children, and the blocks of text in page order with their nodes."""
    nodes, stack, blocks, run = [Node("html", "", -1)], [0], [], []
    links = 0

    def flush():
        text = " ".join(html_lib.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append((stack[-1], text))
            nodes[stack[-1]].chars += len(text)
            nodes[stack[-1]].stops += text.count(".") + text.count(",")

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            run.append(piece)
            if links:
                nodes[stack[-1]].link += len(piece)
        at = m.end()
        tag = (m[3] or m[7] or "").lower()
        if not tag:
            continue
        closing, attrs = m[2] or m[6], m[4] or m[8] or ""
        if not (m[5] or m[9]):  # cut off: no element
            continue
        if tag in INLINE:
            if tag in BREAKS:
                run.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    del stack[i:]
                    break
            links = 0
            continue
        if nodes[stack[-1]].tag == "p" and tag != "button":
            stack.pop()
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in stop:
                    break
                if nodes[stack[i]].tag in same:
                    del stack[i:]
        if tag in ("html", "body") and any(nodes[i].tag == tag for i in stack):
            continue
        nodes.append(Node(tag, attrs, stack[-1]))
        if not attrs.endswith("/"):
            stack.append(len(nodes) - 1)
    run.append(page[at:])
    flush()
    return nodes, blocks


def node_features(node: Node) -> list[tuple[int, float]]:
    out = [(TAG_OF.get(node.tag, N_TAGS - 1), 1.0)]
    if node.attrs:
        words = {w.lower() for a in ATTRIBUTE.findall(node.attrs) for w in SPLIT.split(a[0] or a[1] or a[2]) if w}
        kinds = {OTHER[w] for w in words if w in OTHER}
        out += [(N_TAGS + 1 + k, 1.0) for k in kinds]
        if not kinds and any(w.startswith(CONTENT_WORDS) for w in words):
            out.append((N_TAGS, 1.0))
    base = N_TAGS + 1 + N_OTHER
    out.append((base, 1.0))
    if len(out) == 2:  # no name says anything
        out.append((base + 5, 1.0))
    if node.chars:
        out += [(base + 1, min(1.0, node.chars / 200)), (base + 2, min(1.0, node.link / node.chars)), (base + 3, min(1.0, 10 * node.stops / node.chars)), (base + 4, float(node.chars < 25))]
    return out


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + log1p(exp(-abs(a - b)))


class Model:
    """unary: weight of each feature for content; pair[f][p][c]: potential of a parent's and a child's labels, f being 1
    if the parent is the page's frame."""

    def __init__(self):
        self.unary, self.pair = np.zeros(N), np.zeros((2, 2, 2))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log odds of content for each node, by sum-product messages upward, then downward."""
        w, pairs = self.unary.tolist(), [[t for row in pair for t in row] for pair in self.pair.tolist()]
        for node in nodes:
            node.x = node_features(node)
            node.up = sum([w[i] * v for i, v in node.x])
            node.edge = pairs[node.parent >= 0 and nodes[node.parent].tag in FRAME]
        for node in reversed(nodes[1:]):
            t00, t01, t10, t11 = node.edge
            node.down = _log_sum(t10, t11 + node.up) - _log_sum(t00, t01 + node.up)  # the message to the parent
            nodes[node.parent].up += node.down
        out = [nodes[0].up]
        for node in nodes[1:]:
            t00, t01, t10, t11 = node.edge
            above = out[node.parent] - node.down  # the parent without this child
            node.down = above
            out.append(node.up + _log_sum(t01, t11 + above) - _log_sum(t00, t10 + above))
        return out

    def step(self, nodes: list[Node], rate: float) -> None:
        """One gradient step on a labelled page's log likelihood."""
        odds, unary, pair = self.marginals(nodes), np.zeros(N), np.zeros((2, 2, 2))
        for node, o in zip(nodes, odds, strict=True):
            miss = node.label - 1 / (1 + exp(-o)) if o > -700 else node.label
            for i, v in node.x:
                unary[i] += miss * v
        for node in nodes[1:]:
            t00, t01, t10, t11 = node.edge
            logs = np.array([[t00, t01 + node.up], [t10 + node.down, t11 + node.down + node.up]])
            p = np.exp(logs - logs.max())
            own = pair[int(nodes[node.parent].tag in FRAME)]
            own -= p / p.sum()
            own[nodes[node.parent].label, node.label] += 1
        self.unary += rate * (unary / len(nodes) ** 0.5 - 0.0003 * self.unary)
        self.pair += rate * (pair / len(nodes) ** 0.5 - 0.0003 * self.pair)


def page_examples(n: int, seed: int) -> list[str]:
    """Labelled pages: every element of interest carries data-content 1 or 0; others have their parent's label."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    sylls = "ra to mi len sor ve quin tal es an der ou ble pra".split()

    def words(lo: int, hi: int, stops: bool = True) -> str:
        out = ["".join(pick(*sylls) for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(lo, hi))]
        return "".join(w + (pick(" ", " ", " ", " ", ", ", ". ") if stops else " ") for w in out).strip() + ("." if stops else "")

    def el(tag: str, content: int | None, inside: str, names: str = "") -> str:
        mark = "" if content is None else f' data-content="{content}"'
        named = f' {pick("class", "class", "id")}="{names}"' if names else ""
        return f"<{tag}{named}{mark}>{inside}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>")

    def link(lo=1, hi=4) -> str:
        return f'<a href="/x">{words(lo, hi, False)}</a>'

    def odd_name() -> str:
        """A class that says nothing, or none."""
        return "" if rng.random() < 0.5 else "".join(pick(*sylls) for _ in range(rng.integers(1, 4))) + pick("", "-1", "_x")

    def button() -> str:
        return el("button", 0, words(1, 3, False), pick("", "", odd_name()))

    def menu() -> str:
        return el("ul", 0, "".join(el("li", 0, link()) for _ in range(rng.integers(2, 8))))

    def aside_block() -> str:
        kind = rng.integers(10)
        text = el("p", 0, words(3, 40)) if rng.random() < 0.6 else words(3, 30)
        if kind == 0:
            return el(pick("nav", "div"), 0, menu(), pick("nav", "menu", "main-menu", "breadcrumb")) if rng.random() < 0.6 else el("nav", 0, menu())
        if kind == 1:
            return el("div", 0, text, pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo"))
        if kind == 2:
            return el(pick("aside", "div"), 0, el("h3", 0, words(1, 3, False)) + menu() + text, pick("sidebar", "widget", "related", "popular"))
        if kind == 3:
            return el("aside", 0, text + (menu() if rng.random() < 0.5 else ""))
        if kind == 4:
            return el("div", 0, text + button(), pick("cookie", "cookie-notice", "consent", "popup", "alert", "notice"))
        if kind == 5:
            return el("form", 0, words(1, 6) + "<input type=text>" + el("p", 0, words(2, 8)), pick("", "search", "newsletter", "login"))
        if kind == 6:
            return el("div", 0, link() + " " + link() + " " + link(), pick("share", "social", "share-links", odd_name()))
        if kind == 7:
            return comments()
        if kind == 8:
            return el("header", 0, el("div", 0, words(1, 4, False), pick("logo", "masthead", "")) + (menu() if rng.random() < 0.5 else ""))
        return el("div", 0, el("p", 0, words(2, 20)), pick("newsletter", "subscribe", "banner"))

    def comments() -> str:
        each = "".join(el(pick("div", "li", "article"), 0, el("p", 0, words(3, 60)), pick("comment", "reply", "comment-body")) for _ in range(rng.integers(1, 5)))
        return el(pick("section", "div", "ol"), 0, el("h3", 0, words(1, 3, False)) + each, pick("comments", "comment-list", "replies", "disqus"))

    def body_block() -> str:
        kind = rng.integers(16)
        if kind < 8:
            inside = words(1, 120) if rng.random() < 0.85 else words(1, 4)
            if rng.random() < 0.05:
                inside += " " + button()
            return el("p", 1, inside, odd_name() if rng.random() < 0.2 else "")
        if kind == 14:
            return el("pre", 1, words(3, 60))
        if kind == 15:
            return el(pick("div", "section"), 1, "".join(el("p", 1, words(5, 60)) for _ in range(rng.integers(1, 3))) if rng.random() < 0.7 else words(8, 60), odd_name())
        if kind == 8:
            return el("p", 1, "<b>" + words(2, 12) + pick("</b>", "<br>", "</b><br>") + words(1, 30))
        if kind == 9:
            return el(pick("h2", "h3"), 1, words(1, 7, False))
        if kind == 10:
            return el("ul", 1, "".join(el("li", 1, words(2, 20)) for _ in range(rng.integers(2, 6))))
        if kind == 11:
            return el("blockquote", 1, el("p", 1, words(5, 40)))
        if kind == 12:
            return el("table", 1, "".join(el("tr", 1, el("td", 1, words(1, 4)) + el("td", 1, words(1, 6))) for _ in range(rng.integers(2, 5))))
        return el("figure", 1, "<img src=x>" + el("figcaption", 1, words(3, 12)))

    out = []
    for _ in range(n):
        inside = [el("h1", 1, words(1, 12, bool(rng.random() < 0.4)))] if rng.random() < 0.6 else []
        inside += [body_block() for _ in range(rng.integers(1, 12 if rng.random() < 0.6 else 3))]
        if rng.random() < 0.15:  # nothing but a paragraph or two
            inside = [el("p", 1, words(4, 60)) for _ in range(rng.integers(1, 3))]
        for _ in range(rng.integers(0, 3)):  # adverts, forms and the like within the article
            inside.insert(int(rng.integers(1, len(inside) + 1)), aside_block())
        if rng.random() < 0.3:
            inside.append(comments())
        if rng.random() < 0.3:
            inside = [el(pick("div", "section"), 1, "".join(inside), pick("", "content", "body", "entry-content", odd_name()))]
        if rng.random() < 0.2:
            inside.insert(0, el("header", 0, words(1, 6) if rng.random() < 0.5 else menu()))
        shape = rng.random()
        if shape < 0.4:
            main = el("article", 1, "".join(inside), odd_name() if rng.random() < 0.2 else "")
        elif shape < 0.5:
            main = el("main", 1, "".join(inside))
        elif shape < 0.7:
            main = el("div", 1, "".join(inside), pick("content", "article-body", "post", "entry", "story", "main-content"))
        elif shape < 0.92:
            main = el("div", 1, "".join(inside), odd_name())
        else:  # text without an element of its own
            main = el("div", 1, words(20, 200), odd_name())
        if rng.random() < 0.2:
            main = el(pick("div", "main"), 1, main, pick("", "wrapper", "container", "page", odd_name()))
        alone = rng.random() < 0.15
        around = [[aside_block() for _ in range(0 if alone else rng.integers(0, 4))] for _ in range(2)]
        tag = pick("footer", "footer", "div")
        foot = el(tag, 0, el("p", 0, words(3, 20)) if rng.random() < 0.4 else words(3, 30), pick("footer", "site-footer") if tag == "div" else pick("", "", "footer", odd_name())) if not alone and rng.random() < 0.9 else ""
        out.append(el("html", 0, "<head><title>" + words(2, 8) + "</title></head>" + el("body", 0, "".join([*around[0], main, *around[1], foot]))))
    return out


def train(n: int = N_EXAMPLES, seed: int = SEED) -> Model:
    model, pages = Model(), []
    for page in page_examples(n, seed):
        nodes, _ = parse(page)
        for node in nodes:
            m = LABEL.search(node.attrs)
            node.label = int(m[1]) if m else nodes[node.parent].label if node.parent >= 0 else 0
        pages.append(nodes)
    for epoch in range(EPOCHS):
        for nodes in pages:
            model.step(nodes, STEP / (1 + 0.3 * epoch))
    return model


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    odds = model.marginals(nodes)
    return " ".join(text for i, text in blocks if odds[i] >= 0)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(model: Model):
    def run(batches):
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_OUT)

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(train()), "page_id long, url string, text string, n_chars long")


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
