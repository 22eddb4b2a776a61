"""Main text of web pages by a tree-structured graphical model (operator 12).

A page becomes a tree of its block elements (inline ones are part of their block). Each node has a label, content or not;
each edge from parent to child has potentials over both labels, log-linear in the child's features (tag, words of class, id
and role, lengths, share of links, place in the page). Sum-product messages pass upward and downward, for all pages of a
block at once, level by level; a node's text is kept if its content marginal reaches 0.5 (or, on a page
where none does, half of the best, if that reaches DOUBT).

Training: labelled pages, by the gradient of the exact likelihood, from two sources. Pages of the corpus whose one article
element tells what is content (each also with its telling tags and names taken away, so that the model learns from
structure and text); and pages laid out at random from parts with known labels around the corpus's own sentences, for the
parts that a corpus may lack (reader comments, notices, forms, sidebars). Both are a bounded sample: SAMPLE pages of at
most SAMPLE_CHARS characters, chosen by a hash.

Defined results: null and empty pages have the empty text; a tag that isn't closed by the end, a comment or script without
an end swallow the rest, as in browsers; white space is whatever str.split takes for it; br counts as white space; repeated
rows are rows of their own; an empty table gives no rows; only page_id, url and html are read, so other columns may have any
name.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.shared import mapped

#: Corpus pages that are learned from, their size at most, and pages laid out at random.
SAMPLE, SAMPLE_CHARS, LAID_OUT = 200, 20_000, 1600
#: If no text of a page reaches 0.5, but some this much, what has half of the best marginal is kept.
DOUBT = 0.05
#: Pages whose messages are passed at a time, and characters of them, one page at least.
SLICE, SLICE_CHARS = 64, 1 << 20

# Element names of the HTML standard by what a parser does with them.
BLOCKS = frozenset(
    "article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form "
    "fieldset legend figure figcaption blockquote pre address details summary center hr menu dir hgroup search dialog ins".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
SKIPPED = frozenset("template noscript svg math select datalist button object audio video canvas map".split())
CELLS = frozenset("td th caption table".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag ends an open one of these, unless one of the second set was opened since.
ENDS = {
    "li": (("li",), LISTS | CELLS),
    "dt": (("dt", "dd"), frozenset(["dl"]) | CELLS),
    "dd": (("dt", "dd"), frozenset(["dl"]) | CELLS),
    "tr": (("tr",), frozenset(["table"])),
    "td": (("td", "th"), frozenset(["table", "tr"])),
    "th": (("td", "th"), frozenset(["table", "tr"])),
    "thead": (("thead", "tbody", "tfoot"), frozenset(["table"])),
    "tbody": (("thead", "tbody", "tfoot"), frozenset(["table"])),
    "tfoot": (("thead", "tbody", "tfoot"), frozenset(["table"])),
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STOPS = re.compile(r"[.!?,;:…。、]")


class Page:
    """Block elements in page order (node 0 is the page) and the blocks of text, each with its node."""

    def __init__(self, html: str):
        self.tag, self.parent, self.words, self.hidden, self.mark = ["#page"], [-1], [()], [False], [None]
        self.links: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]
        places: dict[str, list[int]] = {}  # where each name lies on the stack
        text: list[str] = []
        skipping, link, n, at = 0, -1, len(html), 0

        def flush() -> None:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                self.blocks.append((stack[-1][1], whole))

        def pop_to(depth: int) -> None:
            nonlocal skipping, link
            while len(stack) > depth:
                name, _ = stack.pop()
                places[name].pop()
                skipping -= name in SKIPPED
            if link >= len(stack):
                link = -1

        def last(names) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=0)

        while at < n:
            cut = html.find("<", at)
            if cut < 0:
                cut = n
            if cut > at and not skipping:
                piece = html[at:cut]
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if link >= 0:
                    self.links[stack[-1][1]] += len(piece)
            if cut >= n:
                break
            nxt = html[cut + 1 : cut + 2]
            if nxt == "!" or nxt == "?":
                if html.startswith("<!--", cut):
                    if html.startswith((">", "->"), cut + 4):
                        at = html.index(">", cut + 4) + 1
                    else:
                        end = html.find("-->", cut + 4)
                        other = html.find("--!>", cut + 4, end if end >= 0 else n)
                        at = n if max(end, other) < 0 else other + 4 if other >= 0 else end + 3
                else:
                    end = html.find(">", cut)
                    at = end + 1 if end >= 0 else n
                continue
            if nxt == "/":
                name = NAME.match(html, cut + 2)
                end = html.find(">", cut)
                at = end + 1 if end >= 0 else n
                if name is None:
                    if cut + 2 >= n:
                        text.append("</")
                    continue
                name = name[0].lower()
                if name == "a":
                    link = -1
                elif places.get(name) and (name in CELLS or name == "tr" or places[name][-1] > last(CELLS)):
                    if name in BLOCKS:
                        flush()
                    pop_to(places[name][-1])
                elif name == "br" or name in BLOCKS:
                    text.append(" ")
                continue
            name = NAME.match(html, cut + 1)
            if name is None:
                if not skipping:
                    text.append("<")
                at = cut + 1
                continue
            at, name = name.end(), name[0].lower()
            held: dict[str, str] = {}
            if html[at : at + 1] != ">":
                wanted = name in BLOCKS
                while at < n:
                    found = ATTRIBUTE.match(html, at)
                    if found is None:
                        break
                    at = found.end()
                    if wanted:
                        held.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
            end = html.find(">", at)
            if end < 0:
                break
            at = end + 1
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                at = n if close is None else close.start()
            elif name == "br":
                text.append(" ")
            elif name == "a":
                link = len(stack) - 1
            elif name in BLOCKS:
                if not skipping:
                    flush()
                elif stack[-1][0] in ("select", "svg", "math", "datalist"):
                    pop_to(len(stack) - 1)
                if places.get("p") and places["p"][-1] > last(CELLS):
                    pop_to(places["p"][-1])
                if name in ENDS:
                    ends, until = ENDS[name]
                    where = last(ends)
                    if where and where > last(until - set(ends)):
                        pop_to(where)
                elif name[0] == "h" and name[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                    pop_to(len(stack) - 1)
                self._add(name, stack[-1][1], held)
                if name not in VOID:
                    places.setdefault(name, []).append(len(stack))
                    stack.append((name, len(self.tag) - 1))
            elif name in SKIPPED and html[end - 1] != "/":
                places.setdefault(name, []).append(len(stack))
                stack.append((name, stack[-1][1]))
                skipping += 1
        flush()

    def _add(self, name: str, parent: int, held: dict[str, str]) -> None:
        self.tag.append(name)
        self.parent.append(parent)
        words: tuple = ()
        hidden = False
        if held:
            named = " ".join(held.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop"))
            words = tuple(w.lower() for w in WORD.findall(named[:1000]))
            style = held.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in held or "display:none" in style or "visibility:hidden" in style or held.get("aria-hidden") == "true"
        self.words.append(words)
        self.hidden.append(hidden)
        self.mark.append(held.get("data-y"))
        self.links.append(0)


#: Words that sites name their parts by.
NAMED = {
    "content": "article content post entry story main body text page single prose copy",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainnav pagination pager tabs toc links sitemap skip",
    "header": "header masthead banner logo brand branding top topbar tagline title",
    "footer": "footer contentinfo copyright bottom legal colophon imprint foot",
    "side": "sidebar aside side widget widgets related recommended recommendations rail popular trending secondary complementary more teaser archive",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription disclaimer warning privacy paywall banner message toast announcement",
    "share": "share sharing social follow like likes buttons toolbar tools tags meta byline rating",
    "comment": "comment comments commentlist reply replies respond response responses discussion disqus thread feedback reader readers reviews guestbook",
    "form": "form search login signin signup register registration contact input field",
}
GROUP = {}
for _number, (_group, _names) in enumerate(NAMED.items()):
    for _name in _names.split():
        GROUP.setdefault(_name, []).append(_number)
TAGS = {t: i for i, t in enumerate(["#page", *sorted(BLOCKS)])}
HASHED = 128
#: Numbered features: (name, how many values).
LAYOUT = [
    ("bias", 1), ("tag", len(TAGS)), ("parent", len(TAGS)), ("size", 16), ("own", 16), ("linked", 8), ("share", 8), ("stops", 6), ("children", 6), ("depth", 10),
    ("starts", 6), ("ends", 6), ("hidden", 2), ("sign", 2), ("unnamed", 2), ("prose", 6), ("group", len(NAMED)), ("above", len(NAMED)), ("word", HASHED),
]
START = dict(zip((n for n, _ in LAYOUT), np.cumsum([0] + [k for _, k in LAYOUT]).tolist()))
FEATURES = sum(k for _, k in LAYOUT)
FIXED = 16


def bins(x: np.ndarray, edges: tuple) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


class Trees:
    """Nodes of some pages, one after another: parents, depths, and sparse binary features."""

    def __init__(self, pages: list[Page], plain: bool = False):
        """plain: without the tags and words that tell a page's parts."""
        sizes = [len(p.tag) for p in pages]
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n, page = int(self.begin[-1]), np.repeat(np.arange(len(pages)), sizes)
        base = self.begin[page]
        parent = np.array([q for p in pages for q in p.parent], np.int64)
        self.parent = np.where(parent < 0, -1, parent + base)
        own, stops, sign, seen, starts = (np.zeros(n) for _ in range(5))
        links = np.array([x for p in pages for x in p.links], float)
        for i, p in enumerate(pages):
            at, b = 0, int(self.begin[i])
            for node, text in p.blocks:
                k = b + node
                if not seen[k]:
                    seen[k], starts[k] = 1, at
                own[k] += len(text)
                at += len(text)
                stops[k] += len(STOPS.findall(text))
                sign[k] += "©" in text
        # children follow their parents, so one pass back and one forth are enough; levels make both vectorised
        self.levels = self._levels(n)
        self.depth = np.zeros(n, np.int64)
        total, linked, marks, signs, kids, prose = own.copy(), links.copy(), stops.copy(), sign.copy(), np.zeros(n), np.zeros(n)
        tag = np.array([TAGS[t] for p in pages for t in p.tag], np.int64)
        prose[tag == TAGS["p"]] = own[tag == TAGS["p"]]
        for level, nodes in enumerate(self.levels):
            self.depth[nodes] = level
        for nodes in reversed(self.levels[1:]):
            up = self.parent[nodes]
            for values in (total, linked, marks, signs, prose):
                np.add.at(values, up, values[nodes])
            np.add.at(kids, up, 1)
        # text before a node: before its first own block or that of a node after it
        starts[seen == 0] = np.inf
        starts = np.minimum.accumulate((starts + 1e12 * page)[::-1])[::-1] - 1e12 * page
        whole = np.maximum(total[base], 1)
        starts = np.minimum(starts, whole)
        above = tag[np.maximum(self.parent, 0)]
        if plain:
            telling = np.isin(tag, [TAGS[t] for t in ("article", "section", "nav", "aside", "header", "footer", "main", "form")])
            tag = np.where(telling, TAGS["div"], tag)
            above = tag[np.maximum(self.parent, 0)]
        words = [() if plain else w for p in pages for w in p.words]
        lengths = (1, 10, 25, 50, 80, 120, 200, 350, 600, 1000, 1800, 3500, 8000, 20000)
        fixed = [
            np.zeros(n, np.int64), tag, above, bins(total, lengths), bins(own, lengths), bins(linked / np.maximum(total, 1), (0.01, 0.1, 0.3, 0.5, 0.8, 0.95)),
            bins(total / whole, (0.02, 0.1, 0.25, 0.5, 0.75, 0.95)), bins(marks / np.maximum(total, 1), (0.001, 0.008, 0.015, 0.03)), bins(kids, (1, 2, 4, 8, 20)),
            np.minimum(self.depth, 9), bins(starts / whole, (0.02, 0.1, 0.3, 0.6, 0.9)), bins((starts + total) / whole, (0.05, 0.2, 0.5, 0.8, 0.98)),
            np.array([h for p in pages for h in p.hidden], np.int64), (signs > 0).astype(np.int64), np.array([not w for w in words], np.int64),
            bins(prose / np.maximum(total, 1), (0.01, 0.3, 0.6, 0.9, 0.99)),
        ]
        names = [n for n, _ in LAYOUT[:FIXED]]
        rows = np.stack([f + START[name] for f, name in zip(fixed, names, strict=True)], 1)
        where, what, groups = [], [], {}
        for k, held in enumerate(words):
            own_groups = set()
            for w in set(held):
                own_groups.update(GROUP.get(w, ()))
                where.append(k)
                what.append(START["word"] + zlib.crc32(w.encode()) % HASHED)
            if own_groups:
                groups[k] = own_groups
        for k, own_groups in groups.items():
            where += [k] * len(own_groups)
            what += [START["group"] + g for g in own_groups]
        for k, p in enumerate(self.parent.tolist()) if groups else ():
            for g in groups.get(p, ()):
                where.append(k)
                what.append(START["above"] + g)
        at = np.concatenate([np.repeat(np.arange(n), FIXED), np.array(where, np.int64)])
        index = np.concatenate([rows.reshape(-1), np.array(what, np.int64)])
        order = np.argsort(at, kind="stable")
        self.index, self.node = index[order], at[order]
        self.first = np.searchsorted(self.node, np.arange(n))

    def _levels(self, n: int) -> list[np.ndarray]:
        depth = [0] * n
        parent = self.parent.tolist()
        for k in range(n):
            if parent[k] >= 0:
                depth[k] = depth[parent[k]] + 1
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []

    def potentials(self, weights: np.ndarray) -> np.ndarray:
        """log potentials (node, label of parent, own label); (not, not) is 0. weights: (FEATURES, 3)."""
        out = np.zeros((len(self.parent), 2, 2))
        if len(out):
            sums = np.add.reduceat(weights[self.index], self.first)
            out[:, 0, 1], out[:, 1, 0], out[:, 1, 1] = sums.T
        return out

    def messages(self, phi: np.ndarray) -> tuple[np.ndarray, float]:
        """Sum-product: marginals (node, label of parent, own label) and the log of the sum over all labellings.

        A page's own parent is not content.
        """
        n = len(phi)
        below, up, out = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
        for nodes in reversed(self.levels):
            x = phi[nodes] + below[nodes][:, None, :]
            up[nodes] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            inner = nodes[self.parent[nodes] >= 0]
            if len(inner):
                np.add.at(below, self.parent[inner], up[inner])
        down = np.zeros((n, 2))  # of a node's parent without the node, normalised
        total = 0.0
        for level, nodes in enumerate(self.levels):
            if level == 0:
                down[nodes] = [0.0, -np.inf]
                total = float(up[nodes, 0].sum())
            else:
                p = self.parent[nodes]
                x = phi[p] + down[p][:, :, None]
                down[nodes] = np.logaddexp(x[:, 0], x[:, 1]) + below[p] - up[nodes]
                down[nodes] -= down[nodes].max(1, keepdims=True)
            x = down[nodes][:, :, None] + phi[nodes] + below[nodes][:, None, :]
            x = np.exp(x - x.max((1, 2), keepdims=True))
            out[nodes] = x / x.sum((1, 2), keepdims=True)
        return out, total

    def gradient(self, weights: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
        """Log likelihood of the labels and its slope by the weights."""
        phi = self.potentials(weights)
        edges, total = self.messages(phi)
        above = np.where(self.parent >= 0, labels[np.maximum(self.parent, 0)], 0)
        n = np.arange(len(labels))
        likelihood = float(phi[n, above, labels].sum()) - total
        off = -edges
        off[n, above, labels] += 1
        each = off.reshape(-1, 4)[:, 1:][self.node]
        return likelihood, np.stack([np.bincount(self.index, each[:, j], FEATURES) for j in range(3)], 1)


def own_labels(page: Page) -> np.ndarray | None:
    """Labels of a page with one article: what lies in it, but for parts that are named otherwise."""
    if page.tag.count("article") != 1:
        return None
    out = np.zeros(len(page.tag), np.int64)
    other = {g for g, name in enumerate(NAMED) if name in ("menu", "advert", "share", "comment", "form", "side", "notice", "footer")}
    for k in range(1, len(out)):
        if page.tag[k] == "article":
            out[k] = 1
        elif out[page.parent[k]]:
            named = {g for w in page.words[k] for g in GROUP.get(w, ())}
            out[k] = not (page.tag[k] in ("nav", "aside", "footer", "form") or named & other or page.hidden[k])
    return out


def marked_labels(page: Page) -> np.ndarray:
    """Labels of a laid-out page: data-y of the node or of the nearest above it."""
    out = np.zeros(len(page.tag), np.int64)
    for k in range(1, len(out)):
        out[k] = out[page.parent[k]] if page.mark[k] is None else int(page.mark[k])
    return out


class Layouts:
    """Pages laid out at random from labelled parts around given sentences."""

    def __init__(self, sentences: list[str], seed: int = 5):
        self.rng, self.sentences = random.Random(seed), sentences or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]

    def said(self, low: int, high: int) -> str:
        if self.dull and self.rng.random() < 0.7:  # one word over and over, lists of words
            words = self.few(4).strip(".").split() * self.rng.choice([1, 5, 30, 200, 600])
            return " ".join(words[: self.rng.choice([3, 20, 100, 600, 1500])])
        return " ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(low, high)))

    def few(self, words: int) -> str:
        return " ".join(self.rng.choice(self.sentences).split()[: self.rng.randint(1, words)])

    def part(self, tags: str, named: str, inner: str, mark: int = 0) -> str:
        rng = self.rng
        tag = "div" if self.plain and rng.random() < 0.8 else rng.choice(tags.split())
        name = rng.choice(named.split())
        other = rng.choice(["", "", "-" + rng.choice("box inner wrap area list block section site page".split()), "_" + str(rng.randint(1, 9))])
        held = "" if rng.random() < self.unnamed else f' {rng.choice(["class", "class", "id", "role"])}="{name}{other}"'
        return f'<{tag}{held} data-y="{mark}">{inner}</{tag}>'

    def links(self) -> str:
        some = [f'<a href="/{i}">{self.few(3)}</a>' for i in range(self.rng.randint(2, 9))]
        return self.rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>", " | ".join(some), " ".join(some)])

    def chrome(self, kind: str) -> str:
        rng, N = self.rng, NAMED
        if kind == "menu":
            return self.part("nav nav div ul", N["menu"], self.links())
        if kind == "header":
            inner = rng.choice([f"<h1>{self.few(4)}</h1>", f"<h2>{self.few(4)}</h2><p>{self.few(8)}</p>", f'<a href="/">{self.few(3)}</a>', f"<p>{self.said(1, 1)}</p>", self.few(5)])
            return self.part("header header div", N["header"], inner + (self.chrome("menu") if rng.random() < 0.3 else ""))
        if kind == "footer":
            inner = rng.choice(["&copy; ", "© 2020 ", "", "Copyright "]) + rng.choice([self.few(8), f"<p>{self.said(1, 2)}</p>", self.links()])
            return self.part("footer footer div", N["footer"], inner)
        if kind == "side":
            inner = f"<h3>{self.few(4)}</h3>" * rng.randint(0, 1) + rng.choice([self.links(), "".join(f"<p>{self.said(1, 2)}</p>" for _ in range(rng.randint(1, 4))), f"<p>{self.said(1, 4)}</p>", self.said(1, 2)])
            return self.part("aside aside div section", N["side"], inner)
        if kind == "notice":
            inner = rng.choice([f"<p>{self.said(1, 3)}</p>", self.said(1, 3), self.few(10)]) + rng.choice(["", "<button>OK</button>", ' <a href="/p">OK</a>'])
            return self.part("div div section aside dialog", N["notice"], inner)
        if kind == "advert":
            return self.part("div div aside ins section", N["advert"], rng.choice([self.said(1, 3), f"<p>{self.said(1, 3)}</p>", f'<a href="/x">{self.said(1, 2)}</a>']))
        if kind == "form":
            inner = "".join(f'<label>{self.few(2)}</label><input name="a">' for _ in range(rng.randint(1, 4))) + f"<p>{self.said(1, 2)}</p>" * rng.randint(0, 1)
            return self.part("form", N["form"], inner + rng.choice(["<button>Go</button>", '<input type="submit">']))
        if kind == "share":
            return self.part("div ul section", N["share"], rng.choice([self.links(), self.few(6)]))
        one = lambda: self.part("div div article li section", rng.choice(["comment", "reply", "comment comment-body"]), rng.choice(["", f"<h4>{self.few(2)}</h4>", f"<b>{self.few(2)}</b> "]) + rng.choice([f"<p>{self.said(1, 3)}</p>", self.said(1, 3)]))
        return self.part("section div ol", N["comment"], f"<h3>{self.few(3)}</h3>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 5))) if rng.random() < 0.7 else "".join(f"<p>{self.said(1, 3)}</p>" for _ in range(rng.randint(1, 4))))

    def article(self) -> str:
        rng = self.rng
        heads = [f"<h1>{self.few(9)}</h1>"] * rng.choice([0, 1, 1, 1])
        body = []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 12, 25])):
            kind = rng.random()
            if kind < 0.72:
                body.append(f"<p>{self.said(1, rng.choice([1, 3, 6]))}</p>")
            elif kind < 0.8:
                body.append(f"<h2>{self.few(5)}</h2><p>{self.said(1, 4)}</p>")
            elif kind < 0.87:
                body.append("<ul>" + "".join(f"<li>{self.few(12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                body.append(f"<blockquote><p>{self.said(1, 2)}</p></blockquote>")
            elif kind < 0.94:
                body.append(f"<figure><img><figcaption>{self.few(8)}</figcaption></figure>")
            elif kind < 0.97:
                body.append("<table>" + "".join(f"<tr><td>{self.few(3)}</td><td>{self.few(3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                body.append(f"<pre>{self.few(20)}</pre>")
        for kind in ("advert", "share", "side", "notice", "form"):
            if rng.random() < 0.12:
                body.insert(rng.randint(0, len(body)), self.chrome(kind))
        if rng.random() < 0.25:
            body.append(self.chrome("comment"))
        inner = "".join(heads + body)
        if rng.random() < 0.2:
            inner = f"<div>{inner}</div>"
        tags = "article article div main section td"
        whole = self.part(tags, NAMED["content"], inner, 1)
        return f"<table><tr>{whole}</tr></table>" if whole.startswith("<td") else whole

    def page(self) -> str:
        rng = self.rng
        self.dull = rng.random() < 0.2
        self.plain, self.unnamed = rng.random() < 0.4, rng.choice([0.05, 0.05, 0.3, 1.0]) if rng.random() < 0.6 else 0.0
        bare = rng.random() < 0.12  # an article and little else
        around = lambda kinds, share: [self.chrome(k) for k in kinds if rng.random() < (share / 4 if bare else share)]
        parts = around(("notice",), 0.25) + around(("header", "menu"), 0.65) + around(("advert", "notice", "form"), 0.25)
        middle = around(("side",), 0.25) + [self.article()] + around(("share", "advert"), 0.15) + around(("comment", "side", "form"), 0.35)
        middle = "".join(middle)
        wrap = rng.random()
        if wrap < 0.3:
            middle = f'<div class="{rng.choice("container wrapper row page site layout main".split())}" data-y="0">{middle}</div>'
        parts.append(middle if wrap < 0.9 else f'<main data-y="0">{middle}</main>')
        parts += around(("side", "advert", "notice"), 0.15) + around(("footer",), 0.75) + around(("notice",), 0.1)
        whole = "".join(parts)
        if rng.random() < 0.08:
            return f'<form id="f{rng.randint(1, 9)}" data-y="0">{whole}</form>'
        return f'<div id="{rng.choice("app root page wrapper outer".split())}" data-y="0">{whole}</div>' if rng.random() < 0.15 else whole


def fit(corpus: list[str], laid_out: int = LAID_OUT, rounds: int = 120, step: float = 0.3, ridge: float = 0.1, seed: int = 5) -> np.ndarray:
    """Weights from corpus pages and laid-out ones, by full-batch Adam on the exact likelihood."""
    own = [(p, y) for p in map(Page, corpus) if (y := own_labels(p)) is not None]
    sentences = sorted({s for p, _ in own for _, text in p.blocks for s in re.split(r"(?<=[.!?]) ", text) if 2 < len(s) < 400})
    layouts = Layouts(sentences, seed)
    made = [Page(layouts.page()) for _ in range(laid_out)]
    pages = [p for p, _ in own]
    sets = [(Trees(made), [marked_labels(p) for p in made])]
    if own:
        sets += [(Trees(pages, plain), [y for _, y in own]) for plain in (False, True)]
    sets = [(t, np.concatenate(y)) for t, y in sets]
    weights, first, second = np.zeros((FEATURES, 3)), np.zeros((FEATURES, 3)), np.zeros((FEATURES, 3))
    n = sum(len(y) for _, y in sets)
    for k in range(1, rounds + 1):
        slope = sum(t.gradient(weights, y)[1] for t, y in sets) - ridge * weights
        slope /= n
        first, second = 0.9 * first + 0.1 * slope, 0.98 * second + 0.02 * slope**2
        weights += step * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.98**k)) + 1e-8)
    return weights


def trained(pages: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Weights learned from a bounded sample of the pages (html), chosen by a hash of the whole page."""
    rows = pages.select("html").filter(F.length("html").between(1, chars)).select(F.xxhash64("html").alias("h"), "html")
    least = [r["h"] for r in rows.select("h").orderBy("h").limit(sample).collect()]
    if not least:
        return fit([])
    # equal pages have equal hashes and are one, combined before they are moved
    chosen = rows.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
    return fit([r["html"] for r in chosen.collect()])


def marginals(pages: list[Page], weights: np.ndarray) -> list[np.ndarray]:
    """The content marginal of each node of each page."""
    trees = Trees(pages)
    edges, _ = trees.messages(trees.potentials(weights))
    content = edges[:, :, 1].sum(1)
    return [content[a:b] for a, b in zip(trees.begin[:-1], trees.begin[1:])]


def texts_of(htmls: list[str | None], weights: np.ndarray) -> list[str]:
    """The main text of each page."""
    pages = [Page(h or "") for h in htmls]
    out = []
    for p, m in zip(pages, marginals(pages, weights), strict=True):
        best = max((m[node] for node, _ in p.blocks), default=0.0)
        least = min(0.5, best / 2) if best >= DOUBT else 0.5
        out.append("\n".join(text for node, text in p.blocks if m[node] >= least))
    return out


def extracted(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars of each page. pages: page_id, url, html."""

    def parts(column: pa.Array) -> Iterator[tuple[int, int]]:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        at = size = 0
        for i, s in enumerate(sizes):
            if i > at and (i - at >= SLICE or size + s > SLICE_CHARS):
                yield at, i
                at, size = i, 0
            size += s
        if at < len(sizes):
            yield at, len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column(2)):
                some = batch.slice(a, b - a)
                found = texts_of(some.column(2).to_pylist(), weights)
                chars = pa.array([len(t) for t in found], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(found, pa.string()), chars], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op12_tree_model_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages, trained(pages))
