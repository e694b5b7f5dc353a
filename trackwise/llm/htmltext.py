"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks.

A page is parsed to leaf blocks, runs of text under one block-level element. Each block
has features of its ancestors (tags, words of their class and id) and of its text
(length, share of link text, punctuation). A two-label linear-chain CRF, fitted by
gradient ascent on labelled pages, tells main text from the rest, and Viterbi decoding
takes the best labelling of the whole page. The labelled pages are composed here: known
page layouts, filled with words of a bounded number of the table's own pages, so the
label of every block is known.

Defined results: null or empty html, and pages without main text, give the empty text;
text in elements that never show (scripts, styles, head, form controls) is no block;
character references are decoded, white space in a block becomes one space, blocks are
joined by a line feed. Unclosed and stray tags are repaired by the usual implied ends.
Rows that repeat an id are treated as rows of their own.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.text import light, slim

# Groups of HTML elements.
HIDDEN = frozenset("script style noscript template head title svg math canvas iframe object audio video select option datalist textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LANDMARKS = ("nav", "header", "footer", "aside", "article", "main", "form", "section")
#: An element of the first kind is ended by the start of one of the second.
IMPLIED = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Parts of class names and ids that are features wherever they stand.
PARTS = "nav menu foot header sidebar comment cookie consent banner promo sponsor related share social newsletter subscri breadcrumb widget login search popup modal disclaim copyright recommend trending advert reply respon content article post entry story main".split()
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple  # of (tag, class and id)
    link_chars: int


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.hidden = 0
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.in_link = False
        self.link_chars = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append(Block(text, tuple(self.stack), self.link_chars))
            self.parts = []
        self.link_chars = 0
        self.in_link = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = True
            return
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in HIDDEN:
            if not self.hidden or tag != "head":
                self.hidden += 1
                self.stack.append((tag, ""))
            return
        self.flush()
        if tag == "body":
            self.hidden, self.stack = 0, []
        while self.stack and tag in IMPLIED.get(self.stack[-1][0], ()):
            self.stack.pop()
        self.stack.append((tag, " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = False
            return
        if not any(x[0] == tag for x in self.stack):
            return
        if tag not in HIDDEN:
            self.flush()
        while self.stack:
            top = self.stack.pop()[0]
            if top in HIDDEN:
                self.hidden = max(0, self.hidden - 1)
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.parts.append(data)
        if self.in_link:
            self.link_chars += len(data)


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.found


def path_features(path: tuple) -> list[str]:
    """Features of a block's ancestors."""
    out = {f"t:{tag}" for tag, _ in path}
    for tag, names in path:
        if names:
            out |= {f"c:{w.lower()}" for w in _WORDS.findall(names)}
            low = names.lower()
            out |= {f"p:{x}" for x in PARTS if x in low}
    out.add(f"n:{path[-1][0] if path else ''}")
    near = next(((t, c) for t, c in reversed(path) if t in LANDMARKS), ("", ""))
    out.add(f"l:{near[0]}")
    out |= {f"lp:{x}" for x in PARTS if x in near[1].lower()}
    named = next((c.lower() for _, c in reversed(path) if c), "")
    out |= {f"np:{x}" for x in PARTS if x in named}
    return sorted(out)


def text_features(b: Block) -> tuple[str, ...]:
    """Features of a block's text."""
    t = b.text
    n = t.count(" ") + 1
    size = 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 12 else 3 if n <= 30 else 4 if n <= 80 else 5
    share = min(b.link_chars / len(t), 1.0)
    link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3
    stop = "s" if t[-1] in ".!?…:;\"'”»" else "n"
    tag = b.path[-1][0] if b.path else ""
    return (f"w:{size}", f"a:{link}", f"e:{stop}", f"wa:{size}:{link}", f"nw:{tag}:{size}", "copy" if "©" in t else "nocopy", f"d:{min(3, sum(map(t.count, '0123456789')) * 20 // len(t))}")


@dataclass
class Crf:
    """Weights of label 1 (main) against 0, and scores of first labels and label pairs."""

    weights: dict[str, float]
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    known: dict = field(default_factory=dict)

    def scores(self, found: list[Block]) -> list[float]:
        out, w = [], self.weights
        for b in found:
            s = self.known.get(b.path)
            if s is None:
                if len(self.known) > 20_000:
                    self.known.clear()
                s = self.known[b.path] = sum(w.get(f, 0.0) for f in path_features(b.path))
            out.append(s + sum(w.get(f, 0.0) for f in text_features(b)))
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels, by Viterbi."""
        if not scores:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for s in scores[1:]:
            from0, from1 = a + p00 < b + p10, a + p01 < b + p11
            back.append((int(from0), int(from1)))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + s
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        found = blocks(html) if isinstance(html, str) else []
        return "\n".join(b.text for b, y in zip(found, self.decode(self.scores(found)), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], *, steps: int = 150, rate: float = 0.3, l2: float = 0.5) -> Crf:
    """Maximum likelihood by full-batch adaptive gradient steps; forward and backward run over all pages at once."""
    pages = [p for p in pages if p[0]]
    feats = [[[*path_features(b.path), *text_features(b)] for b in found] for found, _ in pages]
    names = sorted({f for page in feats for fs in page for f in fs})
    number = {f: i for i, f in enumerate(names)}
    n, t = len(pages), max(len(p[0]) for p in pages)
    flat = np.array([number[f] for page in feats for fs in page for f in fs])
    per = np.array([len(fs) for page in feats for fs in page])
    where = np.array([i * t + k for i, page in enumerate(feats) for k in range(len(page))])
    owner = np.repeat(where, per)
    size = np.array([len(p[0]) for p in pages])
    there = np.arange(t) < size[:, None]
    gold = np.zeros((n, t), int)
    for i, (_, y) in enumerate(pages):
        gold[i, : len(y)] = y
    w, first, pair = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
    sq = [np.full_like(x, 1e-6) for x in (w, first, pair)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    gold_pair = np.zeros((2, 2))
    both = there[:, 1:]
    np.add.at(gold_pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for _ in range(steps):
        em = np.zeros((n, t, 2))
        em[:, :, 1] = np.bincount(owner, w[flat], n * t).reshape(n, t)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = first + em[:, 0]
        for k in range(1, t):
            nxt = lse(alpha[:, k - 1, :, None] + pair, 1) + em[:, k]
            alpha[:, k] = np.where(there[:, k, None], nxt, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            prv = lse(pair + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(there[:, k + 1, None], prv, 0.0)
        logz = lse(alpha[:, -1], 1)
        prob = np.exp(alpha[:, :, 1] + beta[:, :, 1] - logz[:, None]) * there
        edge = np.exp(alpha[:, :-1, :, None] + pair + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None]) * both[:, :, None, None]
        miss = (gold * there - prob).ravel()
        p0 = np.array([(1 - prob[:, 0]).sum(), prob[:, 0].sum()])
        g0 = np.bincount(gold[:, 0], minlength=2)
        for x, s, g in zip((w, first, pair), sq, (np.bincount(flat, miss[owner], len(names)) - l2 * w, g0 - p0, gold_pair - edge.sum((0, 1)) - l2 * pair), strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Crf({f: float(w[i]) for f, i in number.items()}, first, pair)


# The layouts of labelled pages. Each entry wraps content of one kind; the label of a block is that of its innermost entry.
MAIN_WRAPS = ["<article>{}</article>", "<main>{}</main>", "<main><article class='post'>{}</article></main>", "<div id='content'>{}</div>", "<div class='post-content'>{}</div>", "<div class='entry-content'>{}</div>", "<div class='article-body'>{}</div>", "<section class='story'>{}</section>", "<div class='container'><div class='main-text'>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "{}"]
LINKS = ["<nav>{}</nav>", "<div class='menu'>{}</div>", "<div id='navbar'>{}</div>", "<div class='breadcrumbs'>{}</div>", "<header class='site-header'><nav>{}</nav></header>", "<div class='social-share'>{}</div>", "<aside class='related'>{}</aside>", "<div class='related-posts'>{}</div>", "<div class='tags'>{}</div>", "<footer>{}</footer>"]
NOTES = ["<div class='ad'>{}</div>", "<div class='advert'>{}</div>", "<div class='ads sponsored'>{}</div>", "<div class='promo-box'>{}</div>", "<div id='cookie-banner'>{}</div>", "<div class='cookie-notice'>{}</div>", "<div class='consent' role='dialog'>{}</div>", "<div class='popup modal'>{}</div>", "<header><div class='tagline'>{}</div></header>", "<div id='header'>{}</div>", "<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div id='sidebar-left'><div class='widget'>{}</div></div>", "<div class='notice'>{}</div>", "<div class='disclaimer'>{}</div>", "<form class='newsletter'>{}</form>", "<form action='/s'><label>{}</label><input name='q'></form>", "<div class='subscribe'>{}</div>"]
FEET = ["<footer>&copy; {}</footer>", "<footer><p>{}</p></footer>", "<div id='footer'>&copy; {}</div>", "<div class='site-footer copyright'>{}</div>"]
COMMENTS = ["<section class='comments'>{}</section>", "<div id='comments'>{}</div>", "<ol class='comment-list'>{}</ol>", "<div class='user-comments'>{}</div>", "<div id='respond' class='replies'>{}</div>"]


def labelled_pages(vocabulary: list[list[str]], *, n: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages of the layouts above, filled with runs of the vocabulary's words, with the label of each block."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = vocabulary[i % len(vocabulary)]

        def say(lo: int, hi: int, words: list[str] = words) -> str:
            k = rng.randint(lo, hi)
            at = rng.randrange(len(words))
            return " ".join((words[at:] + words * (k // len(words) + 1))[:k]).replace("<", "").replace("&", "")

        # "\x01" marks text of the article, so that labels follow from the parsed blocks
        own = lambda lo, hi: "\x01" + say(lo, hi)
        links = lambda: "<ul>" + "".join(f"<li><a href='/x'>{say(1, 3)}</a></li>" for _ in range(rng.randint(2, 8))) + "</ul>" if rng.random() < 0.7 else " ".join(f"<a href='/x'>{say(1, 3)}</a>" for _ in range(rng.randint(2, 6)))
        note = lambda: rng.choice(NOTES).format(say(2, 25) if rng.random() < 0.6 else f"<p>{say(3, 60)}</p>")
        side = lambda: rng.choice(LINKS).format(links())
        talk = lambda: rng.choice(COMMENTS).format("".join(f"<{t}>{say(3, 60)}</{t}>" for t in rng.choices(["p", "li", "div"], k=rng.randint(1, 6))))
        body = []
        if rng.random() < 0.8:
            h = f"<h1>{own(1, 12)}</h1>"
            body.append(f"<header>{h}</header>" if rng.random() < 0.15 else h)
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            kind = rng.random()
            if kind < 0.72:
                p = own(*rng.choice([(1, 3), (3, 20), (20, 90), (40, 200)]))
                body.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>"]).format(p))
            elif kind < 0.78:
                body.append(f"<h{rng.randint(2, 4)}>{own(1, 8)}</h2>")
            elif kind < 0.84:
                body.append("<ul>" + "".join(f"<li>{own(2, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                body.append(f"<blockquote>{own(5, 40)}</blockquote>")
            elif kind < 0.90:
                body.append(f"<pre>{own(3, 20)}</pre>")
            elif kind < 0.92:
                body.append("<table>" + "".join(f"<tr><td>{own(1, 4)}</td><td>{own(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                body.append(note())
            else:
                body.append(side())
        if rng.random() < 0.15:
            body.append(talk())
        parts = [side() for _ in range(rng.randint(0, 2))] + [note() for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        parts.append(rng.choice(MAIN_WRAPS).format("".join(body)))
        parts += [talk()] if rng.random() < 0.3 else []
        parts += [x() for x in rng.choices([side, note], k=rng.randint(0, 2))]
        if rng.random() < 0.85:
            parts.append(rng.choice(FEET).format(say(2, 30)))
        found = blocks(f"<html><head><title>{say(1, 9)}</title></head><body>{''.join(parts)}</body></html>")
        y = [int("\x01" in b.text) for b in found]
        for b in found:
            b.text = b.text.replace("\x01", "") or "x"
        out.append((found, y))
    return out


def train(pages: DataFrame, *, html: str = "html", sample_pages: int = 200, sample_words: int = 2000, layouts: int = 700) -> Crf | None:
    """Fit the CRF; ``sample_pages`` pages, chosen by a hash of their html, lend their words (at most ``sample_words`` runs each) to the labelled pages."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&\w+;", " ")
    some = pages.filter(F.length(html) > 0).select(html).orderBy(F.xxhash64(html)).limit(sample_pages)
    rows = [r["w"] for r in some.select(F.slice(F.split(F.trim(bare), r"\s+"), 1, sample_words).alias("w")).collect()]
    vocabulary = [w for w in rows if len(w) > 5]
    return fit(labelled_pages(vocabulary, n=layouts)) if vocabulary else None


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", model: Crf | None = None, **training) -> DataFrame:
    """Per row of ``pages``: ``page_id url text``; without a model one is trained on labelled pages."""
    light(pages.sparkSession)
    crf = model or train(pages, html=html, **training) or Crf({})
    shared = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            yield pdf.assign(text=[m.main_text(h) for h in pdf["_html"]]).drop(columns="_html")

    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    return named.mapInPandas(slim(run), "page_id long, url string, text string")
