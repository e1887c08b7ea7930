"""Main-text extraction: boosted trees over DOM-node features, decoded down the tree.

Every block element and text run gets features of its subtree (text and tag density, links, punctuation), its attribute
tokens, its depth and its siblings.  Boosted trees give the log-odds that a node holds main text; the decoder then picks
the labelling of the whole tree with the largest sum, in which no node below a rejected one is kept and no element is kept
without kept text below.  The model is trained here, on pages from a generator of templates (``training_page``) whose
nodes carry their labels; it never sees the pages to be extracted, and has a fixed size whatever their number.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import table
from .dom import Node, parse

TRAINING_PAGES = 700
# Names that page templates use for main text and for what stands around it.
MAIN_NAMES = "article post-content entry-content article-body story-body main-content content post-body entry text-body page-content blog-post news-article body-copy prose".split()
NOISE_NAMES = (
    "nav navbar menu main-menu top-menu breadcrumb header site-header page-header masthead banner logo footer site-footer page-footer copyright sidebar side-bar widget rail "
    "ad ads advert advertisement sponsor sponsored promo cookie-notice cookie consent gdpr notice alert popup modal newsletter subscribe signup login form search search-form "
    "share social social-share related related-posts recommended more-stories comments comment comment-list reader-comments discussion disqus replies pagination pager toolbar tags legal disclaimer"
).split()
NEUTRAL_NAMES = "container wrapper row col inner outer box block layout grid page site section left right center wrap clearfix main-wrapper".split()
_TAGS = ("p", "li", "div", "h1", "h2", "h3", "td", "blockquote", "#text")


def _words(r: random.Random, n: int) -> str:
    out = ["".join(r.choice("aeioubcdfghlmnprstvwäéñ") for _ in range(r.randint(2, 10))) for _ in range(n)]
    for k in range(0, n, max(3, r.randint(5, 14))):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += r.choice(".,.;.")
    return " ".join(out) + r.choice([".", "", "!", "?"])


def _attributes(r: random.Random, names: list[str], share: float) -> str:
    if r.random() > share:
        return ""
    name = r.choice(names)
    if r.random() < 0.2:
        name += " " + r.choice(NEUTRAL_NAMES)
    return f' {"id" if r.random() < 0.25 else "class"}="{name}"'


def _links(r: random.Random, n: int, mark: str = "") -> str:
    items = "".join(f'<li{mark}><a href="/{k}">{_words(r, r.randint(1, 4))}</a></li>' for k in range(n))
    return f"<ul{mark}>{items}</ul>"


def _noise(r: random.Random, kind: str) -> str:
    """A piece of page around the main text."""
    named = lambda names, share=0.9: _attributes(r, names.split(), share)
    if kind == "nav":
        tag = r.choice(["nav", "nav", "div"])
        return f'<{tag}{named("nav navbar menu main-menu top-menu breadcrumb", 0.5 if tag == "nav" else 0.9)} data-drop=1>{_links(r, r.randint(3, 12))}</{tag}>'
    if kind == "header":
        tag = r.choice(["header", "header", "div"])
        return f'<{tag}{named("header site-header masthead banner logo page-header", 0.4 if tag == "header" else 1)} data-drop=1>{r.choice(["<h1>%s</h1>", "<p>%s</p>", "<div>%s</div>", "%s"]) % _words(r, r.randint(1, 8))}{_links(r, 4) if r.random() < 0.4 else ""}</{tag}>'
    if kind == "footer":
        tag = r.choice(["footer", "footer", "div"])
        inner = r.choice(["&copy; %s", "<p>&copy; 2024 %s</p>", "<p>%s</p>", "<small>%s</small>"]) % _words(r, r.randint(3, 30))
        return f'<{tag}{named("footer site-footer copyright legal page-footer", 0.4 if tag == "footer" else 1)} data-drop=1>{inner}{_links(r, 5) if r.random() < 0.4 else ""}</{tag}>'
    if kind == "side":
        tag = r.choice(["aside", "aside", "div", "section"])
        body = "".join(f"<{h}>{_words(r, 3)}</{h}>{_links(r, r.randint(2, 6)) if r.random() < 0.6 else '<p>' + _words(r, r.randint(4, 60)) + '</p>'}" for h in r.choices(["h2", "h3", "h4", "div"], k=r.randint(1, 3)))
        return f'<{tag}{named("sidebar side-bar widget rail related related-posts recommended more-stories tags", 0.5 if tag == "aside" else 1)} data-drop=1>{body}</{tag}>'
    if kind == "ad":
        tag = r.choice(["div", "div", "aside", "section"])
        return f'<{tag}{named("ad ads advert advertisement sponsor sponsored promo", 1)} data-drop=1>{r.choice(["%s", "<p>%s</p>", "<a href=x>%s</a>"]) % _words(r, r.randint(2, 45))}</{tag}>'
    if kind == "notice":
        return f'<div{named("cookie-notice cookie consent gdpr notice alert popup modal newsletter subscribe disclaimer", 1)} data-drop=1>{r.choice(["%s", "<p>%s</p>"]) % _words(r, r.randint(4, 50))}{"<button>OK</button>" if r.random() < 0.6 else ""}</div>'
    if kind == "form":
        return f'<form{named("login form search search-form signup newsletter subscribe", 0.6)} data-drop=1><label>{_words(r, 3)}</label><input type="text">{"<p>" + _words(r, r.randint(3, 25)) + "</p>" if r.random() < 0.5 else ""}<button>{_words(r, 1)}</button></form>'
    if kind == "share":
        return f'<div{named("share social social-share toolbar pagination pager", 1)} data-drop=1>{r.choice([_links(r, 4), _words(r, 3)])}</div>'
    tag = r.choice(["div", "section", "aside", "ol"])
    each = r.choice(["div", "article", "li"]) if tag != "ol" else "li"
    body = "".join(f'<{each}{named("comment reply reader-comment", 0.8)}>{r.choice(["<b>%s</b>", "<h4>%s</h4>", "<span>%s</span>"]) % _words(r, 2)}<p>{_words(r, r.randint(5, 90))}</p></{each}>' for _ in range(r.randint(1, 6)))
    return f'<{tag}{named("comments comment-list reader-comments discussion disqus replies", 1)} data-drop=1>{"<h3>" + _words(r, 2) + "</h3>" if r.random() < 0.6 else ""}{body}</{tag}>'


def _main(r: random.Random) -> str:
    """Main text; some of it has noise inside."""
    tag = r.choice(["article", "article", "main", "div", "div", "section"])
    parts = []
    if r.random() < 0.75:
        parts.append(f"<h1>{_words(r, r.randint(1, 12))}</h1>")
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25])):
        kind, n = r.random(), r.choice([1, 1, 2, 6, 15, 30, 60, 120, 200])
        if kind < 0.72:
            parts.append(r.choice(["<p>%s</p>"] * 7 + ["<p><b>%s<br>", "<p>%s", "<div>%s</div>"]) % _words(r, n))
        elif kind < 0.82:
            parts.append(f"<h{(k := r.randint(2, 4))}>{_words(r, r.randint(1, 8))}</h{k}>")
        elif kind < 0.88:
            parts.append("<ul>" + "".join(f"<li>{_words(r, r.randint(2, 25))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.92:
            parts.append(f"<blockquote>{r.choice(['%s', '<p>%s</p>']) % _words(r, n)}</blockquote>")
        elif kind < 0.95:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{_words(r, r.randint(1, 8))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif kind < 0.97:
            parts.append(f"<figure><img src=x><figcaption>{_words(r, r.randint(2, 12))}</figcaption></figure>")
        else:
            parts.append(f'<p>{_words(r, 8)} <a href="/x">{_words(r, 3)}</a> {_words(r, n)}</p>')
    for kind in ("ad", "share", "side", "notice", "comments", "form"):
        if r.random() < 0.09:
            parts.insert(r.randint(1, len(parts)), _noise(r, kind))
    return f'<{tag}{_attributes(r, MAIN_NAMES, 0.35 if tag in ("article", "main") else 0.8)} data-keep=1>{"".join(parts)}</{tag}>'


def training_page(seed: int) -> str:
    """A page from random templates; data-keep and data-drop mark what is main text."""
    r = random.Random(seed)
    before = [k for k in ("nav", "header", "notice", "ad", "form") if r.random() < 0.45]
    after = [k for k in ("comments", "side", "ad", "share", "form", "footer", "notice") if r.random() < 0.4]
    r.shuffle(before)
    main = _main(r)
    if r.random() < 0.35:
        inside = [_noise(r, k) for k in ("side", "ad", "comments") if r.random() < 0.4]
        main = f"<div{_attributes(r, NEUTRAL_NAMES, 0.8)}>{main}{''.join(inside)}</div>"
    body = "".join(_noise(r, k) for k in before) + main + "".join(_noise(r, k) for k in after)
    if r.random() < 0.3:
        body = f"<div{_attributes(r, NEUTRAL_NAMES, 0.8)}>{body}</div>"
    return f"<html><head><title>{_words(r, 5)}</title></head><body>{body}</body></html>"


def measure(nodes: list[Node]) -> None:
    """Subtree sums, bottom up: characters, linked ones, elements, runs, punctuation, list items, inputs."""
    for node in nodes:
        node.stats = [0] * 7
    for node in reversed(nodes):
        s = node.stats
        if node.tag == "#text":
            s[0], s[1], s[3] = len(node.text), node.linked, 1
            s[4] = sum(map(node.text.count, ".,;:!?"))
        else:
            s[2] += 1
            s[5] += node.tag == "li"
            s[6] += "has:input" in node.tokens or node.tag in ("button", "label", "form")
        if node.parent is not None:
            up = node.parent.stats
            for k in range(7):
                up[k] += s[k]


def features(nodes: list[Node], token_score: dict[str, float]) -> np.ndarray:
    """One row a node; ``measure`` comes first."""
    whole = max(1, nodes[0].stats[0])
    rows, before = [], 0
    low: dict[int, tuple[float, float]] = {}
    place: dict[int, tuple[int, float, int]] = {}
    for node in nodes:
        kids = node.children
        if kids:
            total = sum(k.stats[0] for k in kids)
            same: dict[str, int] = {}
            for k in kids:
                same[k.tag] = same.get(k.tag, 0) + 1
            for i, k in enumerate(kids):
                place[id(k)] = (i, (total - k.stats[0]) / max(1, len(kids) - 1), same[k.tag])
        s, parent = node.stats, node.parent
        scores = [token_score.get(t, 0.0) for t in (f"tag:{node.tag}", *node.tokens)]
        own_low, own_high = min(scores), max(scores)
        up_low, up_high = low[id(parent)] if parent is not None else (0.0, 0.0)
        low[id(node)] = (min(own_low, up_low), max(own_high, up_high))
        index, others, alike = place.get(id(node), (0, 0.0, 1))
        siblings = len(parent.children) if parent is not None else 1
        chars = s[0]
        rows.append((
            own_low, own_high, up_low, up_high, np.log1p(chars), chars / (s[2] + 1), s[1] / max(1, chars), np.log1p(s[2]), chars / max(1, s[3]),
            s[4] / max(1, chars), s[5], s[6], node.depth, index, siblings, alike / siblings, np.log1p(others), chars / whole, before / whole,
            chars / max(1, parent.stats[0]) if parent is not None else 1.0, parent.stats[1] / max(1, parent.stats[0]) if parent is not None else 0.0,
            float(_TAGS.index(node.tag)) if node.tag in _TAGS else -1.0, float(_TAGS.index(parent.tag)) if parent is not None and parent.tag in _TAGS else -1.0,
        ))
        if node.tag == "#text":
            before += chars
    return np.array(rows, dtype=np.float64)


def _labels(nodes: list[Node]) -> list[int]:
    """A run is main text if its nearest marked ancestor says so; an element, if it holds such a run."""
    state: dict[int, int] = {}
    out = {}
    for node in nodes:
        state[id(node)] = node.mark if node.mark is not None else state.get(id(node.parent), 0)
    for node in reversed(nodes):
        out[id(node)] = state[id(node)] if node.tag == "#text" else int(any(out[id(k)] for k in node.children))
    return [out[id(n)] for n in nodes]


class Extractor:
    """Token scores and trees."""

    def __init__(self, token_score: dict[str, float], trees: Boosted):
        self.token_score, self.trees = token_score, trees

    def texts(self, pages: list[str]) -> list[str]:
        parsed = [parse(p) for p in pages]
        for nodes in parsed:
            measure(nodes)
        margins = self.trees.margin(np.concatenate([features(n, self.token_score) for n in parsed]))
        out, at = [], 0
        for nodes in parsed:
            out.append("\n\n".join(n.text for n in decode(nodes, margins[at : at + len(nodes)])))
            at += len(nodes)
        return out


def decode(nodes: list[Node], margins: np.ndarray) -> list[Node]:
    """The kept runs of the best consistent labelling.

    ``rejected[i]``: the subtree's score if all of it is rejected; ``kept[i]``: if the node is kept, with the best choice
    below.  An element counts as kept only with a kept run below, so an empty one has no say.
    """
    bound = np.clip(margins, -12, 12)
    number = {id(n): i for i, n in enumerate(nodes)}
    yes, no = -np.log1p(np.exp(-bound)), -np.log1p(np.exp(bound))
    rejected, kept = no.copy(), np.full(len(nodes), -np.inf)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            kept[i] = yes[i]
            continue
        kids = [number[id(k)] for k in node.children]
        if kids:
            rejected[i] += rejected[kids].sum()
            best = np.maximum(kept[kids], rejected[kids])
            lost = (best - kept[kids]).min()  # at least one child is kept
            kept[i] = yes[i] + best.sum() - lost if np.isfinite(kept[kids]).any() else -np.inf
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = kept[0] > rejected[0]
    for i, node in enumerate(nodes):
        if chosen[i] and node.children:
            kids = np.array([number[id(k)] for k in node.children])
            take = kept[kids] > rejected[kids]
            if not take.any():
                take[np.argmax(kept[kids] - rejected[kids])] = True
            chosen[kids[take]] = True
    return [n for i, n in enumerate(nodes) if chosen[i] and n.tag == "#text"]


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> Extractor:
    """The model, from a bounded number of generated pages; the same each time."""
    parsed = [parse(training_page(seed)) for seed in range(pages)]
    labels = [_labels(nodes) for nodes in parsed]
    seen: dict[str, list[int]] = {}
    for nodes, wanted in zip(parsed, labels):
        for node, y in zip(nodes, wanted):
            for t in {f"tag:{node.tag}", *node.tokens}:
                seen.setdefault(t, [0, 0])[y] += 1
    base = np.log(sum(map(sum, labels)) / sum(len(w) - sum(w) for w in labels))
    token_score = {t: float(np.log((y + 1) / (n + 1)) - base) for t, (n, y) in seen.items() if n + y >= 5}
    for nodes in parsed:
        measure(nodes)
    x = np.concatenate([features(n, token_score) for n in parsed])
    return Extractor(token_score, Boosted().fit(x, np.array([y for w in labels for y in w], dtype=np.float64)))


CHARS_AT_ONCE = 1 << 20  # of html that is parsed before the trees score its nodes


def _grouped(source: list[str], most: int) -> Iterator[list[str]]:
    """Pages in groups of about ``most`` characters; a longer page is a group of its own."""
    held, size = [], 0
    for page in source:
        if held and size + len(page) > most:
            yield held
            held, size = [], 0
        held.append(page)
        size += len(page)
    if held:
        yield held


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", chars_at_once: int = CHARS_AT_ONCE) -> DataFrame:
    """``pages`` with the main text in ``out``: blocks in page order, joined by two line feeds.

    Null and empty html give the empty text.  No page is cut.  Rows, repeated ones too, and columns stay as they are; if
    ``out`` is taken, its value is replaced.  One narrow step: no shuffle, and the model's size is fixed.  A page takes time
    in proportion to its length, however deep its elements are nested.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            source = [h.as_py() or "" for h in batch.column(html_col)]
            texts = []
            for some in _grouped(source, chars_at_once):
                texts += model.value.texts(some)
            columns = {n: batch.column(n) for n in batch.schema.names} | {out: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return pages.mapInArrow(run, pages.withColumn(out, F.lit(None).cast("string")).schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``; null html gives an empty text, repeated rows the same one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("html"))
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
