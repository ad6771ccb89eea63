"""Main text of web pages by boosted trees over DOM nodes.

A page becomes a tree of block elements and runs of text. Trees score every
node on its subtree's text density, links and punctuation, its depth, its
siblings, and the tags and attribute words of itself and its ancestors. The
scores are decoded down the tree at once: below a node that is main text
everything is, below one that is not nothing is, and only a node marked mixed
leaves the choice to its children, so no choice contradicts another.

The trees are trained here, on pages made from page-layout rules with seeded
random words, so no words of any corpus are learned. Attribute words are hashed
into buckets. Some training pages have no attributes or meaningless ones, only
``div`` for every kind of section, tables for layout, or no element around the
article at all, so that no single mark is relied on.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tangency.llm import boosting

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template title svg math iframe object canvas select button textarea audio video datalist".split())
#: What a head may hold; anything else ends it.
HEAD_PARTS = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Starts of these end a skipped element that is never closed.
RESUMING = frozenset("article blockquote h1 h2 h3 h4 h5 h6 main p section table".split())
#: An element of the key ends open elements of the values, up to a table, list or section around them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
ENDS |= {"tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
TAGS = tuple("#text a article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 header li main nav ol p pre section table td tr ul body".split())

_SPACE = re.compile(r"\s+")
_TOKENS = re.compile(r"[a-z]+")
_END_TAGS = re.compile(r"</([a-z]+)")
_MARKS = re.compile(r"[.,;:!?。，]")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    words: frozenset[str] = frozenset()
    text: list[str] = field(default_factory=list)
    linked: int = 0


class PageParser(HTMLParser):
    """Builds ``nodes``, parents before children; a node of tag ``#text`` holds one block's text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("body", -1)]
        #: Open elements, how many of each tag, and the places in ``open`` of blocks.
        self.open: list[tuple[str, int]] = [("body", 0)]
        self.count: Counter[str] = Counter(("body",))
        self.blocks = [0]
        self.run: int | None = None
        self.skipping: list[str] = []
        #: End tags that are still to come, and whether what is skipped is never closed.
        self.ends: Counter[str] = Counter()
        self.loose = False

    def _resume(self, tag: str) -> None:
        """Ends skipped elements that the start of ``tag`` ends, whether or not they were closed."""
        if tag == "body" and self.skipping[:1] == ["head"]:
            self.skipping.clear()
        elif self.skipping == ["head"] and tag not in HEAD_PARTS:
            self.skipping.clear()
        elif self.loose and self.skipping and tag in RESUMING:
            self.skipping.clear()
        elif self.skipping and self.skipping[-1] in ("svg", "math") and tag in BLOCKS:
            while self.skipping and self.skipping[-1] in ("svg", "math"):
                self.skipping.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._resume(tag)
        if self.skipping:
            if tag in SKIPPED or tag in BLOCKS or tag in ("foreignobject", "desc"):
                self.skipping.append(tag)
            return
        if tag in VOID:
            if tag in ("br", "wbr"):
                self._add(" " if tag == "br" else "")
            elif tag == "hr":
                self.run = None
            return
        if tag in SKIPPED:
            self.skipping.append(tag)
            self.loose = tag != "head" and self.ends[tag] <= 0
            return
        if tag in BLOCKS:
            self.run = None
            self._close("p", ("table", "article", "section", "main", "body"))
            for old in ENDS.get(tag, ()):
                self._close(old, FENCES[tag])
            words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label")).lower()
            self.nodes.append(Node(tag, self._block(), frozenset(_TOKENS.findall(words))))
            self.blocks.append(len(self.open))
            self.open.append((tag, len(self.nodes) - 1))
        else:
            self.open.append((tag, -1))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._resume(tag)
        if not self.skipping and tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.ends[tag] -= 1
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
                return
            if tag not in BLOCKS or not self.count[tag]:
                return
            self.skipping.clear()
        if tag in BLOCKS:
            self.run = None
        self._close(tag, ())

    def handle_data(self, data: str) -> None:
        if self.skipping == ["head"] and data.strip():
            self.skipping.clear()
        if not self.skipping:
            self._add(data)

    def _block(self) -> int:
        return self.open[self.blocks[-1]][1]

    def _close(self, tag: str, fences: tuple[str, ...]) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag:
                while len(self.open) > i:
                    self.count[self.open.pop()[0]] -= 1
                while self.blocks[-1] >= i:
                    self.blocks.pop()
                return
            if name in fences:
                return

    def _add(self, data: str) -> None:
        if self.run is None:
            if not data.strip():
                return
            self.nodes.append(Node("#text", self._block()))
            self.run = len(self.nodes) - 1
        node = self.nodes[self.run]
        node.text.append(data)
        if self.count["a"]:
            node.linked += len(data.strip())


def parse(html: str | None) -> list[Node]:
    parser = PageParser()
    parser.ends.update(_END_TAGS.findall((html or "").lower()))
    parser.feed(html or "")
    parser.close()
    for node in parser.nodes:
        if node.tag == "#text":
            node.text = [_SPACE.sub(" ", "".join(node.text)).strip()]
    return parser.nodes


#: Buckets of attribute words, and the bits of a node's flags: its own tag and words, then those around it.
BUCKETS = 64
_OWN = len(TAGS) + BUCKETS
_FLAG_BYTES = 8 * -(-2 * _OWN // 64)
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}


@lru_cache(maxsize=1 << 16)
def _word_bit(word: str) -> int:
    return 1 << (len(TAGS) + zlib.crc32(word.encode()) % BUCKETS)


@dataclass(frozen=True)
class Features:
    """Of many nodes: columns of numbers, and flags as bits of 64-bit words."""

    numbers: np.ndarray
    flags: np.ndarray

    @property
    def width(self) -> int:
        return self.numbers.shape[1] + 2 * _OWN

    def columns(self, wanted: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
        numbers, flags = self.numbers[rows], self.flags[rows]
        out = np.empty((len(numbers), len(wanted)), np.float32)
        for at, j in enumerate(wanted.tolist()):
            bit = j - numbers.shape[1]
            out[:, at] = numbers[:, j] if bit < 0 else (flags[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out

    @classmethod
    def joined(cls, parts: list[Features]) -> Features:
        return cls(np.concatenate([x.numbers for x in parts]), np.concatenate([x.flags for x in parts]))


#: Runs of text of this many characters or more count as long.
LONG = 80


def features(nodes: list[Node]) -> Features:
    """Numbers per node, and flags of own tag and words, and of those around it. Time and memory grow with the nodes alone."""
    n = len(nodes)
    chars, links, marks, runs, long, heads, below, before, depth, nth = ([0] * n for _ in range(10))
    own, around, seen, holds = [0] * n, [0] * n, [0] * n, [0] * n
    landmark = _TAG_BIT["article"] | _TAG_BIT["main"]
    kinds: Counter[tuple[int, str]] = Counter()
    total = 0
    for i, node in enumerate(nodes):
        before[i] = total
        bits = _TAG_BIT.get(node.tag, 0)
        if node.tag == "#text":
            text = node.text[0]
            size = len(text)
            chars[i], links[i], marks[i], runs[i] = size, min(node.linked, size), len(_MARKS.findall(text)), 1
            long[i] = size if size >= LONG else 0
            total += size
        for w in node.words:
            bits |= _word_bit(w)
        own[i] = bits
        p = node.parent
        if p >= 0:
            depth[i], nth[i] = depth[p] + 1, seen[p]
            seen[p] += 1
            kinds[p, node.tag] += 1
            around[i] = around[p] | own[p]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for v in (chars, links, marks, runs, long, heads):
            v[p] += v[i]
        heads[p] += nodes[i].tag in ("h1", "h2", "h3")
        holds[p] += holds[i] + (nodes[i].tag in ("article", "main"))
        below[p] += below[i] + 1
    parent = np.array([max(0, x.parent) for x in nodes])
    # Beside the elements that say where main text is, if the page has any.
    beside = np.array([holds[0] > 0 and not h and not (a | b) & landmark for h, a, b in zip(holds, own, around)])
    alike = np.array([1, *(kinds[x.parent, x.tag] for x in nodes[1:])])
    chars, links, marks, runs, long, heads, below, before, depth, nth, seen = (np.array(v, np.float64) for v in (chars, links, marks, runs, long, heads, below, before, depth, nth, seen))
    size, share = np.maximum(chars, 1), links / np.maximum(chars, 1)
    siblings = np.r_[1, seen[parent[1:]]]

    def mean_of_siblings(v: np.ndarray) -> np.ndarray:
        return np.r_[v[0], (np.bincount(parent[1:], v[1:], n) / np.maximum(seen, 1))[parent[1:]]]

    numbers = np.stack(
        [
            depth, np.log1p(chars), share, marks / size, np.log1p(below), chars / (below + 1), np.log1p(runs), chars / np.maximum(runs, 1),
            before / max(total, 1), chars / max(total, 1), chars / size[parent], nth / siblings, np.log1p(siblings), np.log1p(alike),
            mean_of_siblings(np.log1p(chars)), mean_of_siblings(share), share[parent], np.log1p(long), long / size, long[parent] / size[parent],
            heads, heads[parent], mean_of_siblings(long / size), np.full(n, float(holds[0] > 0)), beside,
        ],
        axis=1,
    ).astype(np.float32)
    flags = b"".join((a | (b << _OWN)).to_bytes(_FLAG_BYTES, "little") for a, b in zip(own, around))
    return Features(numbers, np.frombuffer(flags, "<u8").reshape(n, -1))


@dataclass(frozen=True)
class NodeModel:
    """Trees for the kind of a node that is not mixed, and for whether it is."""

    main: boosting.Trees
    mixed: boosting.Trees

    def logits(self, found: Features, at_once: int = 20_000) -> np.ndarray:
        """Two columns of logits, main and mixed, from the features that the trees read, ``at_once`` rows at a time."""
        out = np.empty((len(found.numbers), 2))
        for k, trees in enumerate((self.main, self.mixed)):
            wanted, small = trees.compact()
            for i in range(0, len(out), at_once):
                out[i : i + at_once, k] = small.logits(found.columns(wanted, slice(i, i + at_once)))
        return out


def decode(nodes: list[Node], logits: np.ndarray, mixed: np.ndarray, limit: float = 4.0, change: float = 2.0) -> np.ndarray:
    """True for every node that is main text, by the likeliest labelling that agrees along every path.

    A node is main text, none of it, or mixed. ``mixed`` holds the logits of
    being mixed, ``logits`` those of being main text if not mixed; both count
    within ``limit``. Text runs cannot be mixed. Neighbours of one tag of which
    one is main text and the other is not pay ``change``.
    """
    s, m = np.clip(logits, -limit, limit), np.clip(mixed, -limit, limit)
    n = len(nodes)
    m[[x.tag == "#text" for x in nodes]] = -np.inf
    pure = -np.logaddexp(0, m)
    main, other, either = (pure - np.logaddexp(0, -s)).tolist(), (pure - np.logaddexp(0, s)).tolist(), (-np.logaddexp(0, -m)).tolist()
    # Per parent the best of its children from the last one seen on, by the label of that one (main, other, mixed).
    rest: list[tuple[str, float, float, float]] = [("", 0.0, 0.0, 0.0)] * n
    follow: list[tuple[int, int, int]] = [(0, 0, 0)] * n
    for i in range(n - 1, 0, -1):
        p, tag = nodes[i].parent, nodes[i].tag
        main[p] += main[i]
        other[p] += other[i]
        next_tag, a, b, c = rest[p]
        pay = change if tag == next_tag else 0.0
        after_main = max((a, 0), (b - pay, 1), (c, 2))
        after_other = max((b, 1), (a - pay, 0), (c, 2))
        after_mixed = max((a, 0), (b, 1), (c, 2))
        own = either[i] + max(rest[i][1:])
        follow[i] = (after_main[1], after_other[1], after_mixed[1])
        rest[p] = (tag, main[i] + after_main[0], other[i] + after_other[0], own + after_mixed[0])
    keep = np.zeros(n, bool)
    state = [2] * n
    coming: list[int | None] = [None] * n
    for i, node in enumerate(nodes):
        p = node.parent
        if p < 0:
            best = (main[0], other[0], either[0] + max(rest[0][1:]))
            state[0] = best.index(max(best))
        elif state[p] < 2:
            state[i] = state[p]
        else:
            values = rest[p][1:]
            state[i] = values.index(max(values)) if coming[p] is None else coming[p]
            coming[p] = follow[i][state[i]]
        keep[i] = state[i] == 0
    return keep


def main_text(nodes: list[Node], keep: np.ndarray) -> str:
    return "\n\n".join(x.text[0] for x, k in zip(nodes, keep) if k and x.tag == "#text" and x.text[0])


# Layout rules of the training pages: kinds of parts and the names such parts go by.
LAYOUT = {
    "page": ("container", "wrapper", "page", "site", "row", "inner", "layout", "grid", "col", "box", "block", "section"),
    "main": ("content", "main", "article", "post", "entry-content", "post-body", "article-body", "story", "page-content", "blog-post", "text", "body", "articleBody"),
    "nav": ("nav", "navbar", "menu", "main-menu", "breadcrumb", "breadcrumbs", "navigation", "links", "pagination", "toc"),
    "header": ("header", "site-header", "masthead", "banner", "topbar", "logo", "branding", "tagline"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "legal", "bottom", "contentinfo"),
    "side": ("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "tags", "archive", "complementary", "more", "teaser"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adslot", "banner-ad"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "overlay", "disclaimer"),
    "social": ("share", "social", "follow", "toolbar", "buttons", "meta", "byline-links"),
    "comments": ("comments", "comment", "comment-list", "reply", "replies", "discussion", "respond", "responses", "feedback", "user-comments"),
    "form": ("form", "search", "login", "signup", "contact", "survey", "poll"),
}


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A random page and the set of its words that are main text; main words begin with ``m``, others with ``x``."""
    words = iter(range(10**9))
    used: set[str] = set()

    def text(low: int, high: int, main: bool = False, stops: float = 0.12) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            w = ("m" if main else "x") + str(next(words)) + "e" * rng.randint(0, 6)
            if main:
                used.add(w)
            out.append(w + (rng.choice(".,;!?") if rng.random() < stops else ""))
        return " ".join(out)

    def name(kind: str) -> str:
        if rng.random() < 0.25:
            return ""
        own = rng.choice(LAYOUT[kind])
        return f' {rng.choice(("class", "class", "id"))}="{own + (" " + rng.choice(LAYOUT["page"]) if rng.random() < 0.3 else "")}"'

    def tag(choices: str, attrs: str, inner: str) -> str:
        t = rng.choice(choices.split())
        return f"<{t}{attrs}>{inner}</{t}>"

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{next(words)}">{text(1, 3, stops=0.05)}</a>' for _ in range(rng.randint(low, high))]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice((" | ", " ", "<br>")).join(items)

    def paragraph(main: bool, low: int = 5, high: int = 120) -> str:
        body = text(low, high, main, stops=rng.choice((0.0, 0.1, 0.2, 1.0)))
        if main and rng.random() < 0.2:
            body += f' <a href="/">{text(1, 4, True)}</a> ' + text(2, 20, True)
        if rng.random() < 0.15:
            body = f"<b>{body}" + ("</b>" if rng.random() < 0.5 else "<br>")
        kind = rng.random()
        if kind < 0.75:
            return f"<p>{body}" + ("</p>" if rng.random() < 0.85 else "")
        return tag("div section blockquote p pre", "", body)

    def boilerplate(kind: str) -> str:
        if kind == "nav":
            return tag("nav nav div ul", name(kind), links(3, 12))
        if kind == "header":
            return tag("header div", name(kind), tag("h1 h2 div p span", "", text(1, 5)) + (links(2, 8) if rng.random() < 0.6 else "") + (tag("p div", "", text(3, 12)) if rng.random() < 0.3 else ""))
        if kind == "footer":
            return tag("footer footer div", name(kind), "".join(rng.sample(["&copy; " + text(2, 15), links(2, 8), f"<p>{text(4, 30)}</p>"], rng.randint(1, 3))))
        if kind == "side":
            return tag("aside aside div section", name(kind), "".join(rng.choice((lambda: f"<h3>{text(1, 4)}</h3>" + links(3, 8), lambda: links(2, 6) if plain else f"<p>{text(4, 30)}</p>"))() for _ in range(rng.randint(1, 3))))
        if kind == "ad":
            own = name(kind) or ' class="ad"'
            return f"<!-- ad --><div{own}>{text(2, 40, stops=0.15)}</div>"
        if kind == "notice":
            own = name(kind) or ' class="cookie"'
            return tag("div div section aside p", own, f"<p>{text(5, 40)}</p>" + (f"<button>{text(1, 2)}</button>" if rng.random() < 0.5 else ""))
        if kind == "social":
            return tag("div ul", name(kind) or ' class="share"', links(2, 6))
        if kind == "form":
            return f"<form{name(kind)}><label>{text(1, 6)}</label><input name=q><p>{text(1, 20)}</p><button>{text(1, 2)}</button></form>"
        items = "".join(tag("div li article", name("comments"), tag("span h4 b div", "", text(1, 2)) + paragraph(False, 3, 60)) for _ in range(rng.randint(1, 6)))
        return tag("section div div ol", name(kind) or ' id="comments"', f"<h3>{text(1, 4)}</h3>" + items)

    # A share of pages is without telling names or tags; there only parts that their shape tells are not main text.
    plain = rng.random() < 0.45
    kinds = ("nav", "header", "footer", "side", "social", "form") if plain else ("nav", "header", "footer", "side", "ad", "notice", "social", "form", "comments")
    title = tag("h1 h1 h2", "", text(2, 14, True))
    parts = [title] if rng.random() < 0.85 else []
    for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
        parts.append(paragraph(True, *rng.choice(((1, 12), (5, 60), (20, 200)))))
        if rng.random() < 0.12:
            parts.append(tag("h2 h3", "", text(1, 8, True)))
        if rng.random() < 0.08:
            parts.append("<ul>" + "".join(f"<li>{text(2, 25, True)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        if rng.random() < 0.06:
            parts.append("<table>" + "".join(f"<tr><td>{text(1, 4, True)}</td><td>{text(1, 6, True)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        if rng.random() < 0.1:
            parts.append(boilerplate(rng.choice(("social", "form") if plain else ("ad", "social", "notice", "side", "form"))))
    if rng.random() < 0.25:
        parts.append(boilerplate(rng.choice(("social", "nav") if plain else ("comments", "social", "side", "nav", "footer"))))
    if rng.random() < 0.08:
        parts = [*parts[:1], "<br><br>".join(re.sub(r"</?(?:p|div|section|blockquote|pre)>", "", x) for x in parts[1:])]
    own = name("main")
    bare = rng.random() < (0.3 if plain else 0.08)
    if bare:
        article = "".join(parts)
    else:
        article = tag("article article article main", own, "".join(parts)) if rng.random() < 0.7 or not own else tag("div section", own, "".join(parts))
    if rng.random() < 0.25:
        article = tag("main div section", name("main"), article)
    before = [boilerplate(k) for k in rng.sample(kinds[:2], rng.randint(0, 2))] + [boilerplate(rng.choice(kinds)) for _ in range(rng.choice((0, 0, 1, 2)))]
    after = [boilerplate(rng.choice(kinds)) for _ in range(rng.choice((0, 0, 1, 2)))] + [boilerplate("comments")] * (not plain and rng.random() < 0.25) + [boilerplate("footer")] * (rng.random() < 0.8)
    middle = article + "".join(after[:-1])
    if rng.random() < 0.12:
        cells = [boilerplate(rng.choice(("nav", "side")))] * (rng.random() < 0.8) + [article] + [boilerplate("side")] * (rng.random() < 0.5)
        middle = "<table><tr>" + "".join(f"<td{name('page') if rng.random() < 0.3 else ''}>{x}</td>" for x in cells) + "</tr></table>" + "".join(after[:-1])
    elif rng.random() < 0.4:
        middle = tag("div", name("page"), middle if rng.random() < 0.5 else boilerplate("side") + middle)
    if bare and rng.random() < 0.5:
        before, after, middle = [], after[-1:] * (rng.random() < 0.5), article
    body = "".join(before) + middle + "".join(after[-1:])
    if plain and rng.random() < 0.6:
        body = re.sub(r' (?:class|id)="[^"]*"', "", body)
    elif rng.random() < 0.25:
        body = re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="{"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 7)))}{rng.randint(0, 99)}"', body)
    if plain and rng.random() < 0.6:
        body = re.sub(r"<(/?)(?:article|main|section|nav|header|footer|aside)\b", r"<\1div", body)
    elif rng.random() < 0.3:
        body = re.sub(r"<(/?)(?:article|main|section)\b", r"<\1div", body)
    return f"<!DOCTYPE html><html><head><title>{text(2, 9)}</title></head><body>{body}</body></html>", used


@lru_cache(maxsize=2)
def trained(pages: int = 800, seed: int = 17) -> NodeModel:
    """Trees fitted on ``pages`` layout pages: main text or not on nodes of one kind of text, mixed or not on all elements."""
    rng = random.Random(seed)
    rows, goods, bads, texts, weights = [], [], [], [], []
    for _ in range(pages):
        html, main = training_page(rng)
        nodes = parse(html)
        good, bad = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == "#text":
                found = re.findall(r"[mx]\d+e*", nodes[i].text[0])
                good[i] = sum(w in main for w in found)
                bad[i] = len(found) - good[i] + (not found)
            if i:
                good[nodes[i].parent] += good[i]
                bad[nodes[i].parent] += bad[i]
        own = features(nodes)
        rows.append(own.columns(np.arange(own.width)))
        goods.append(good > 0)
        bads.append(bad > 0)
        texts.append([x.tag == "#text" for x in nodes])
        weights.append(np.full(len(nodes), 30 / len(nodes)))
    x, good, bad, text, weight = (np.concatenate(v) for v in (rows, goods, bads, texts, weights))
    pure, whole = good ^ bad, ~text & (good | bad)
    kind = boosting.fit(x[pure], good[pure].astype(np.float64), weight[pure])
    return NodeModel(kind, boosting.fit(x[whole], (good & bad)[whole].astype(np.float64), weight[whole]))


def extract(html: str | None, model: NodeModel) -> str:
    nodes = parse(html)
    if not any(x.tag == "#text" for x in nodes):
        return ""
    return main_text(nodes, decode(nodes, *model.logits(features(nodes)).T))


def extracted(pages: DataFrame, model: NodeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``, of the whole html.

    A null or empty html, and a page without main text, give an empty text.
    Null ids and urls and repeated rows stay; an empty table gives no rows.
    Other columns are not read. Broken markup is read as far as it goes.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            html = batch.column(2)
            texts: list[str] = []
            held: list[list[Node]] = []
            sizes = 0
            for row in range(batch.num_rows):
                held.append(parse(html[row].as_py()))
                sizes += len(held[-1])
                if sizes > 20_000 or row == batch.num_rows - 1:
                    scores = fitted.logits(Features.joined([features(n) for n in held]))
                    for nodes, own in zip(held, np.split(scores, np.cumsum([len(n) for n in held])[:-1])):
                        texts.append(main_text(nodes, decode(nodes, *own.T)))
                    held, sizes = [], 0
            sizes_out = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes_out], ["page_id", "url", "text", "n_chars"])

    ids = [T.StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, T.StructType([*ids, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
