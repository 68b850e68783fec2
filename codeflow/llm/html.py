"""Main text of web pages from a linear-chain conditional random field over their leaf blocks.

A tolerant scan of the page (comments, scripts, styles and other invisible elements fall out, open paragraphs, items and
cells are closed by what follows them) gives its leaf blocks: stretches of text between borders of block elements. A
block's features are its ancestors' tags and the words of their classes and ids, and its text: length, share of linked
text, ending, and the length of its neighbours. The field is trained on labelled pages and its best labelling
is found by Viterbi. By default the labelled pages come from ``training_pages``, a generator of page layouts.

Defined results: a null or empty page has the empty text; references are decoded once; white space (also no-break) in a
block becomes one space; blocks are joined in page order by one space; a null page_id or url stays null; repeated rows
are extracted each; an empty table gives an empty result. Only page_id, url and html are read, so further columns may
have any name.
"""

from __future__ import annotations

import html as html_
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .quality import marginals

#: Labelled pages that the generator makes for training.
TRAINING_PAGES = 1600
_STEPS, _RATE = 150, 0.15

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: The end of a tag, or a quote that begins a value (elsewhere a quote is a sign like others).
_NEXT = re.compile(r">|=[ \t\n\r\f]*([\"'])")
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# Element names of HTML.
_UNSEEN = frozenset("head script style template noscript svg math iframe object canvas audio video select textarea".split())
_RAW = frozenset("script style template noscript svg math iframe select textarea".split())
_AFTER_VALUE = frozenset(["", " ", "\t", "\n", "\r", "\f", "/", ">"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the first kind is closed by the start of one of the second, unless a border stands between.
_CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
_BORDER = {"li": frozenset(["ul", "ol"]), "p": frozenset(["div", "td", "th", "li", "section", "article", "body"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select"])}


@dataclass
class Block:
    path: tuple[str, ...]  # ancestors as "tag" or "tag word word"
    text: str
    linked: int  # characters inside links


@lru_cache(65536)
def _named(tag: str, attributes: str) -> str:
    words = [w.lower() for m in _NAME.finditer(attributes) for w in _PART.findall(m[2] or m[3] or m[4] or "")]
    return " ".join([tag, *dict.fromkeys(words)]) if words else tag


def _tag_end(page: str, at: int, nearest: dict[str, int]) -> int:
    """Behind the tag whose attributes begin at ``at``. A quoted value reaches to the next such quote; if a '>' stands in it
    and what follows that quote can't follow a value (or there is none), the quote was never closed, and the tag ends at
    the '>'. ``nearest`` keeps where the next quotes stand, so that a page is searched once, however many are unclosed."""
    n = len(page)
    while m := _NEXT.search(page, at):
        quote = m[1]
        if not quote:
            return m.end()
        if nearest[quote] < m.end():
            nearest[quote] = page.find(quote, m.end()) % (n + 1)  # none: n
        close = nearest[quote]
        inner = page.find(">", m.end(), close)
        if inner >= 0 and not (close < n and page[close + 1 : close + 2] in _AFTER_VALUE):
            return inner + 1
        if close == n:
            break
        at = close + 1
    return n


def _token(page: str, at: int, nearest: dict[str, int]) -> tuple[int, int, str, str, str] | None:
    """Begin, end, slash, name and attributes of the next tag; a comment or the like has no name."""
    if not (m := _OPEN.search(page, at)):
        return None
    if m[5]:
        end = _tag_end(page, m.end(), nearest)
        return m.start(), end, m[4], m[5].lower(), page[m.end() : end - (page[end - 1] == ">")]
    stop = "-->" if m[1] else "]]>" if m[2] else ">"
    end = page.find(stop, m.start() + 2)
    return m.start(), len(page) if end < 0 else end + len(stop), "", "", ""


#: Elements around a block that its features come from: of deeper ones, the outer and the inner half.
DEPTH = 128


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order; in time proportional to its length, whatever its markup."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, links, unseen, at = 0, 0, 0, 0
    lower = None

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html_.unescape("".join(text)).split())
            if joined:
                around = stack if len(stack) <= DEPTH else stack[: DEPTH // 2] + stack[-DEPTH // 2 :]
                out.append(Block(tuple(n for _, n in around), joined, linked))
            text.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal unseen
        flush()
        for tag, _ in stack[i:]:
            unseen -= tag in _UNSEEN
            inside[tag] -= 1
        del stack[i:]

    n, nearest, inside = len(page), {'"': -1, "'": -1}, Counter()
    while at < n:
        token = _token(page, at, nearest)
        stop = token[0] if token else n
        if stop > at and not unseen:
            part = page[at:stop]
            text.append(part)
            if links:
                linked += len(part)
        if not token:
            break
        _, at, slash, tag, attributes = token
        if not tag:
            continue
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in _INLINE:
                if inside[tag]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                else:
                    flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _RAW:
            flush()
            if not attributes.endswith("/"):
                lower = lower or page.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == n else page.find(f"</{tag}", at)
                gt = page.find(">", end) if end >= 0 else -1
                at = gt + 1 if gt >= 0 else n
            continue
        if tag in _INLINE:
            links += tag == "a"
            continue
        flush()
        if tag in _VOID:
            continue
        links = 0
        if tag == "body":
            stack = [s for s in stack if s[0] not in _UNSEEN]
            unseen, inside = 0, Counter(t for t, _ in stack)
        if any(inside[name] for name, closers in _CLOSES.items() if tag in closers):
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if tag in _CLOSES.get(name, ()):
                    close(i)
                    if name not in ("td", "th"):
                        break
                elif tag in _BORDER and name in _BORDER[tag]:
                    break
        if not attributes.endswith("/"):
            stack.append((tag, _named(tag, attributes)))
            inside[tag] += 1
            unseen += tag in _UNSEEN
    flush()
    return out


@lru_cache(65536)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    out = {"bias"}
    for name in path:
        tag, *words = name.split()
        out.add(f"in {tag}")
        out.update(f"named {w}" for w in words)
    if path:
        out.add(f"leaf {path[-1].split()[0]}")
        out.update(f"leaf named {w}" for w in path[-1].split()[1:])
    inner = next((name.split()[1:] for name in reversed(path) if " " in name), [])
    leaf = path[-1].split()[0] if path else ""
    for w in inner:  # the innermost names say more than those around
        out.update((f"inner {w}", f"inner {w} {leaf}"))
    for name in path[-3:]:
        out.add(f"{leaf} in {name.split()[0]}")
    out.add(f"depth {min(len(path), 8)}")
    return tuple(sorted(out))


def _size(n: int) -> int:
    return min(12, int(math.log2(n + 1)))


_SIGNS = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|advert|sponsor|subscribe|newsletter|log ?in|sign ?(?:in|up)|comment|repl(?:y|ies)|share|read more|related", re.I)


def _text_features(all_: list[Block], i: int) -> list[str]:
    b = all_[i]
    n = len(b.text)
    share = b.linked / max(n, 1)
    links = 0 if not b.linked else 1 if share < 0.3 else 2 if share < 0.8 else 3
    out = [f"size {_size(n)}", f"links {links}", f"links {links} size {_size(n) // 2}", f"end {b.text[-1] in '.!?…:;'}", f"end {b.text[-1] in '.!?'} size {_size(n) // 2}", f"words {min(10, b.text.count(' ') // 3)}"]
    out += [f"before {_size(len(all_[i - 1].text)) // 2}" if i else "first", f"after {_size(len(all_[i + 1].text)) // 2}" if i + 1 < len(all_) else "last"]
    if n < 400 and (m := _SIGNS.search(b.text)):
        out.append("sign")
        out.append(f"sign {m[0].lower()[:4]}")
    return out


@dataclass
class Model:
    weights: dict[str, float]
    transitions: np.ndarray

    def __post_init__(self):
        self.paths: dict[tuple[str, ...], float] = {}

    def emission(self, all_: list[Block], i: int) -> float:
        path = all_[i].path
        if path not in self.paths:
            if len(self.paths) > 100_000:
                self.paths.clear()
            self.paths[path] = sum(self.weights.get(f, 0.0) for f in _path_features(path))
        get = self.weights.get
        return self.paths[path] + sum(get(f, 0.0) for f in _text_features(all_, i))

    def labels(self, all_: list[Block]) -> list[bool]:
        """The likeliest labelling of the blocks (Viterbi)."""
        (t00, t01), (t10, t11) = self.transitions.tolist()
        back, a, b = [], 0.0, 0.0
        for i in range(len(all_)):
            e = self.emission(all_, i)
            if not i:
                a, b = 0.0, e
                continue
            from0, from1 = b + t10 > a + t00, b + t11 > a + t01
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + e
        label = b > a
        out = [label]
        for from0, from1 in reversed(back):
            label = from1 if label else from0
            out.append(label)
        return out[::-1] if all_ else []

    def text(self, page: str | None) -> str:
        all_ = blocks(page) if page else []
        return " ".join(b.text for b, good in zip(all_, self.labels(all_), strict=True) if good)


def train(pages: list[tuple[list[Block], list[bool]]]) -> Model:
    """A field from pages whose blocks are labelled: gradient steps (Adam) on the exact likelihood."""
    names: dict[str, int] = {}
    cols, size, y, first = [], [], [], [0]
    for all_, good in pages:
        if not all_:
            continue
        for i in range(len(all_)):
            own = (*_path_features(all_[i].path), *_text_features(all_, i))
            cols += [names.setdefault(f, len(names)) for f in own]
            size.append(len(own))
            y.append(bool(good[i]))
        first.append(len(y))
    cols, size = np.array(cols, np.int32), np.array(size)
    start, row = np.cumsum(size) - size, np.repeat(np.arange(len(size), dtype=np.int32), size)
    label, first = np.array(y, float), np.array(first)
    seen = np.zeros((2, 2))
    inside = np.ones(len(y), bool)
    inside[first[:-1]] = False
    now = np.flatnonzero(inside)
    np.add.at(seen, (label[now - 1].astype(int), label[now].astype(int)), 1)
    w = np.zeros(len(names) + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, _STEPS + 1):
        good, expected = marginals(np.add.reduceat(w[cols], start), first, w[-4:].reshape(2, 2))
        g = np.concatenate([np.bincount(cols, (label - good)[row], len(names)), (seen - expected).ravel()]) / len(y) - 5e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(w[i]) for f, i in names.items()}, w[-4:].reshape(2, 2))


# ---------------------------------------------------------------- labelled pages

_NAMES = {
    "nav": "nav menu navbar navigation topmenu mainmenu links breadcrumb breadcrumbs crumbs toc pagination pager tabs".split(),
    "header": "header masthead top banner site-header branding logo topbar page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal credits foot imprint".split(),
    "side": "sidebar side aside widget rail secondary related recommended popular trending more tags archive".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle ad-slot commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay disclaimer newsletter subscribe signup".split(),
    "comments": "comments comment discussion replies responses commentlist thread disqus feedback reader-comments".split(),
    "form": "form search login signup subscribe contact newsletter searchbox".split(),
    "share": "share social sharing buttons tools actions follow".split(),
    "main": "content main article post entry story body post-body entry-content article-body text main-content page hentry".split(),
}


@lru_cache(16)
def _vocabulary(seed: int) -> list[str]:
    rng = random.Random(seed)
    letters = ["an", "be", "che", "do", "er", "fi", "gen", "ha", "in", "lo", "ma", "no", "ou", "pre", "re", "sti", "ta", "un", "ver", "wi", "é", "ü", "ñ"]
    return ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(3000)]


class _Writer:
    def __init__(self, rng: random.Random):
        self.r, self.good, self.words = rng, set(), _vocabulary(rng.randrange(16))

    def say(self, low: int, high: int, stop: bool = True) -> str:
        w = self.r.choices(self.words, k=self.r.randint(low, high))
        for i in range(1, len(w)):
            if self.r.random() < 0.08:
                w[i - 1] += self.r.choice([",", ".", ",", " &amp;"])
        return " ".join(w).capitalize() + ("." if stop else "")

    def keep(self, text: str) -> str:
        self.good.add(" ".join(html_.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:a|b|i|em|strong|span)\b[^>]*>", "", text))).split()))
        return text

    def name(self, kind: str) -> str:
        r = self.r.random()
        if r < 0.2:
            return ""
        if r < 0.3:
            return f' class="{"".join(self.r.choices("bcdfghjkmpqrstvwxz", k=6))}"'
        words = _NAMES[kind][min(self.r.randrange(len(_NAMES[kind])), self.r.randrange(len(_NAMES[kind])))]  # the first are the most common
        return f' {self.r.choice(["class", "class", "id"])}="{words}{self.r.choice(["", "", "", " wide", "-1", " block", "-box"])}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.say(1, 4, self.r.random() < 0.15)}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.95 else f"<li>{x}" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(items)

    def box(self, kind: str, tags: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.name(kind)}>{inner}</{tag}>"

    def inline(self, text: str) -> str:
        w = text.split(" ")
        if len(w) > 6 and self.r.random() < 0.3:
            i = self.r.randrange(len(w) - 3)
            tag = self.r.choice(['a href="/x"', "b", "em", "span", "i"])
            w[i], w[i + 2] = f"<{tag}>{w[i]}", f"{w[i + 2]}</{tag.split()[0]}>"
        return " ".join(w)

    def body(self) -> str:
        """What belongs to the article, with a few things that do not."""
        r, out = self.r, []
        if r.random() < 0.85:
            h = r.choice(["h1", "h1", "h2"])
            out.append(f"<{h}>{self.keep(self.say(2, 14, r.random() < 0.4))}</{h}>")
        plain, boxes = r.random() < 0.2, r.choice([0.03, 0.1, 0.25])
        for k in range(r.choice([1, 2, 3, 4, 5, 6, 8, 10, 15])):
            kind, size = r.random(), r.choice([(1, 4), (4, 15), (15, 60), (20, 80), (40, 150)])
            text = self.inline(self.say(*size, r.random() < 0.9))
            if r.random() < 0.08:  # an article, too, can speak of such things
                text = r.choice(["All rights reserved.", "Copyright 2020.", "Comments", "Share", "(c) 2021", "Log in", "Subscribe", f"{self.say(2, 8, False)} {r.choice(['comment', 'reply', 'cookies', 'newsletter', 'sponsor', 'copyright', 'related'])} {self.say(2, 12)}"])
            if r.random() < boxes:
                out.append(r.choice([self.ad, self.share, self.notice, self.form, self.aside])())
            if plain:
                out.append(f"<div>{self.keep(text)}</div>")
            elif kind < 0.75:
                if not k and r.random() < 0.4:
                    text = f"<b>{text}<br>"
                    out.append("<p>" + self.keep(text))
                else:
                    out.append(f"<p>{self.keep(text)}" + "</p>" * (r.random() < 0.9))
            elif kind < 0.8:
                out.append(f"<h{r.choice('23')}>{self.keep(self.say(1, 8, False))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.say(2, 25, r.random() < 0.6))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.keep(text)}</blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.say(1, 5, False))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f"<pre>{self.keep(text)}</pre>")
            else:
                out.append(f"<figure><img src='a.png'><figcaption>{self.keep(self.say(3, 15))}</figcaption></figure>")
        return "".join(out)

    def ad(self) -> str:
        return self.box("ad", ["div", "div", "aside", "section", "ins"], f"{'<p>' * (self.r.random() < 0.3)}{self.say(2, 30)}")

    def aside(self) -> str:
        return self.box("side", ["aside", "aside", "div"], f"<p>{self.say(3, 30)}</p>" if self.r.random() < 0.6 else self.links(1, 5))

    def share(self) -> str:
        return self.box("share", ["div", "ul", "p"], self.links(2, 5))

    def notice(self) -> str:
        return self.box("notice", ["div", "div", "section", "dialog", "p"], self.say(4, 40) + "<button>" * (self.r.random() < 0.5) + self.say(1, 2, False))

    def form(self) -> str:
        return f"<form{self.name('form')}>" + "".join(f"<label>{self.say(1, 3, False)}</label><input name='q'>" for _ in range(self.r.randint(1, 3))) + f"<p>{self.say(2, 20)}</p><button>{self.say(1, 2, False)}</button></form>"

    def comments(self) -> str:
        r, out = self.r, [f"<{(h := self.r.choice(['h2', 'h3', 'h3', 'h4']))}>{self.say(1, 4, False)}</{h}>"] if self.r.random() < 0.7 else []
        tag = r.choice(["div", "li", "article", "p"])
        for _ in range(r.randint(1, 8)):
            who = r.choice(["<b>{}</b>", "<div class='author'>{}</div>", "<span class='user'>{}</span>: ", "{}: "]).format(self.say(1, 2, False))
            own = f' class="{r.choice(["comment", "reply", "comment-body", "response"])}"' if r.random() < 0.6 else ""
            out.append(f"<{tag}{own}>{who}{'<p>' if tag != 'p' else ''}{self.say(2, 60)}</{tag}>")
        if r.random() < 0.4:
            out.append(self.form())
        return self.box("comments", ["section", "div", "div", "ol", "aside"], "".join(out))

    def page(self) -> str:
        r, out = self.r, []
        if r.random() < 0.5:
            out.append(self.box("header", ["header", "div"], f"<div>{self.say(1, 4, False)}</div>" + r.choice([f"<p>{self.say(3, 12)}</p>", ""]) + r.choice([self.links(2, 6), ""])))
        if r.random() < 0.75:
            out.append(self.box("nav", ["nav", "nav", "div", "ul"], self.links(2, 10)))
        for make, chance in ((self.notice, 0.3), (self.ad, 0.6), (self.form, 0.2)):
            if r.random() < chance:
                out.append(make())
        side = self.box("side", ["aside", "div", "section"], r.choice([f"<h3>{self.say(1, 4, False)}</h3>", ""]) + r.choice([self.links(2, 8), "".join(f"<p>{self.say(3, 40)}</p>" for _ in range(r.randint(1, 4))), "".join(f"<div>{self.say(3, 40)}</div>" for _ in range(r.randint(1, 4)))])) if r.random() < 0.5 else ""
        before = r.random() < 0.4
        out.append(side if before else "")
        inner, kind = self.body(), r.random()
        comments = self.comments() if r.random() < 0.45 else ""
        if r.random() < 0.3:
            inner, comments = inner + comments, ""
        if kind < 0.45:
            if r.random() < 0.3:
                inner = f"<div{self.name('main')}>{inner}</div>"
            main = f"<article{self.name('main') if r.random() < 0.4 else ''}>{inner}</article>"
        elif kind < 0.6:
            main = f"<main>{inner}</main>"
        elif kind < 0.93:
            main = f"<{(t := r.choice(['div', 'div', 'section']))}{self.name('main')}>{inner}</{t}>"
        else:
            main = inner
        if r.random() < 0.25:
            main = f"<div{self.name('main')}>{main}{comments}</div>"
            comments = ""
        if r.random() < 0.1:  # a page of the article alone
            return f"<!DOCTYPE html><html><body>{main}</body></html>"
        out += [main, "" if before else side, comments]
        if r.random() < 0.3:
            out.append(self.ad())
        if r.random() < 0.8:
            mark = r.choice(["&copy; ", "&copy; 2020 ", "Copyright ", ""])
            out.append(self.box("footer", ["footer", "footer", "div"], r.choice(["<p>", ""]) + mark + self.say(2, 25, r.random() < 0.6) + r.choice([self.links(2, 5), ""])))
        return "<!DOCTYPE html><html><head><title>x</title><script>a('<p>')</script></head><body>" + "".join(out) + "</body></html>"


def training_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[str, list[Block], list[bool]]]:
    """Pages of many layouts with the labels of their blocks."""
    out = []
    for i in range(n):
        w = _Writer(random.Random(seed * 1_000_003 + i))
        page = w.page()
        all_ = blocks(page)
        out.append((page, all_, [b.text in w.good for b in all_]))
    return out


@lru_cache(1)
def default_model() -> Model:
    return train([(b, y) for _, b, y in training_pages()])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = model or default_model()
    weights, transitions = model.weights, model.transitions
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, transitions)
        for batch in batches:
            texts = [own.text(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
