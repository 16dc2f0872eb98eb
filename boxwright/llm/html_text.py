"""Main text of web pages: boosted trees over DOM-node features, then a decoding that keeps the tree consistent.

Every block of a page is a node. The trees give each node the probability that its subtree holds article text, given
that its parent's does, from its tag and attribute tokens, those of its ancestors, text and link density of the subtree,
depth and siblings. Decoding multiplies these along the path from the root, which gives each node's posterior in the
whole tree, and keeps what is likelier article text than not. A node's posterior is never above its parent's, so no
kept text has a dropped ancestor and nothing is kept below a dropped node.

The trees are fitted on the driver on ``layouts``: pages drawn from a seeded grammar of common page parts whose text is
known to be article or not. They depend on nothing in the input, so every run scores pages alike.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Trees, fit_trees, log_odds
from .shared import map_batches, text_steps

#: Fixed values of HTML: elements that break a line of text, whose content is raw text, that hold no article text, that have no content, and whose start ends an open one.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SKIPPED = frozenset("noscript template svg object canvas audio video select button annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
_SCOPES = frozenset("table ul ol dl td th tr div section article body".split())
_ENDS_P = BLOCKS - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot"}
#: Quotes hold a '>' only where they begin a value; a tag that has no end that way ends at its first '>'.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>]*))*+(?=>)|[^>]*)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_PART = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}\s*/?>|</{name}\s[^>]*>", re.I) for name in RAW}
_SKIPPED_TAG = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I) for name in SKIPPED}
TAGS = ("html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "tr", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "dt", "#text")
_TAG_ID = {t: i for i, t in enumerate(TAGS)}


class Node:
    """A block element, or a run of text between blocks."""

    __slots__ = ("tag", "tokens", "parent", "children", "text", "links", "truth")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Node | None):
        self.tag, self.tokens, self.parent, self.children, self.text, self.links, self.truth = tag, tokens, parent, [], "", 0, False
        if parent is not None:
            parent.children.append(self)


def _tokens(attributes: str) -> tuple[str, ...]:
    if not attributes.strip(" /"):
        return ()
    found = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found += _PART.findall(html.unescape(a or b or c).lower())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c):
            found.append("hidden")
    return tuple(found)


def _skipped_ends(page: str, tag: str) -> dict[int, int]:
    """Start of each closed element of this name to its end."""
    ends, starts = {}, []
    for match in _SKIPPED_TAG[tag].finditer(page):
        if not match[1]:
            if not match[0].endswith("/>"):
                starts.append(match.start())
        elif starts:
            ends[starts.pop()] = match.end()
    return ends


def parse(page: str) -> Node:
    """The tree of blocks. Unclosed, misnested and cut-off markup is closed as browsers mostly do."""
    root = Node("html", (), None)
    at, node, run, linked, anchors = 0, root, [], 0, 0
    open_tags: list[tuple[str, Node]] = []
    opened: Counter[str] = Counter()
    skipped: dict[str, dict[int, int]] = {}

    def close_run() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                leaf = Node("#text", (), node)
                leaf.text, leaf.links = text, min(linked, len(text))
            run.clear()
        linked = 0

    def close(tag: str, scopes: frozenset[str] = frozenset()) -> None:
        nonlocal node
        if not opened[tag]:
            return
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] == tag:
                close_run()
                node = open_tags[k][1].parent or root
                opened.subtract(name for name, _ in open_tags[k:])
                del open_tags[k:]
                return
            if open_tags[k][0] in scopes:
                return

    size, last = len(page), page.rfind(">")
    while at < size:
        # beyond the last '>' no tag ends, so there is text only, up to a comment that stays open
        match = _TOKEN.search(page, at) if at <= last else None
        piece = page[at : match.start() if match else size if at <= last or (cut := page.find("<!--", at)) < 0 else cut]
        if piece:
            run.append(piece)
            if anchors:
                linked += len(piece.strip())
        if not match:
            break
        at = match.end()
        start, attributes, end = match.groups()
        if start:
            tag = start.lower()
            if tag in RAW:
                if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                    stop = _RAW_END[tag].search(page, at)
                    at = stop.end() if stop else size
                run.append(" ")
            elif tag in SKIPPED:  # one that is never closed is no reason to leave out what follows it
                if not attributes.endswith("/"):
                    if tag not in skipped:
                        skipped[tag] = _skipped_ends(page, tag)
                    at = max(at, skipped[tag].get(match.start(), at))
                run.append(" ")
            elif tag == "br":
                run.append(" ")
            elif tag == "a":
                anchors = 1
            elif tag in BLOCKS and tag != "html":
                if tag in _ENDS_P:
                    close("p", _SCOPES)
                for other in CLOSES.get(tag, ()):
                    close(other, _SCOPES - {"div", "section", "article", other} if tag in ("tr", "td", "th", "tbody") else _SCOPES)
                close_run()
                anchors = 0
                if tag not in VOID:
                    node = Node(tag, _tokens(attributes), node)
                    open_tags.append((tag, node))
                    opened[tag] += 1
            elif tag in ("img", "input"):
                run.append(" ")
        elif end:
            tag = end.lower()
            if tag == "a":
                anchors = 0
            elif tag in BLOCKS and tag not in ("html", "body"):
                close(tag)
    close_run()
    return root


class Page:
    """Nodes of a page in document order with the sums that the features need."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        stack = [root]
        while stack:
            node = stack.pop()
            self.nodes.append(node)
            if len(node.children) == 1 and node.children[0].tag == "#text":  # a block of text is one node
                only = node.children[0]
                node.text, node.links, node.truth, node.children = only.text, only.links, only.truth or node.truth, []
            stack.extend(reversed(node.children))
        at = {id(n): i for i, n in enumerate(self.nodes)}
        self.parent = np.array([at[id(n.parent)] if n.parent is not None else -1 for n in self.nodes])

    def features(self, tag_odds: dict[str, float], token_odds: dict[str, float]) -> np.ndarray:
        n, parent = len(self.nodes), self.parent.tolist()
        chars, links, blocks, paras = [len(x.text) for x in self.nodes], [x.links for x in self.nodes], [1] * n, [int(x.tag == "p" and len(x.text) > 40) for x in self.nodes]
        # headings that are links lead to other articles
        heads = [int(x.tag in ("h1", "h2", "h3", "h4") and x.links > 0.8 * len(x.text) > 0) for x in self.nodes]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            blocks[p] += blocks[i]
            paras[p] += paras[i]
            heads[p] += heads[i]
        total, out = max(1, chars[0]), np.zeros((n, 26))
        own = [(tag_odds.get(x.tag, 0.0), [token_odds[t] for t in x.tokens if t in token_odds]) for x in self.nodes]
        path = [(0.0, 0.0, 0.0, 0.0, 0)] * n
        order = [0] * n
        index = {id(x): i for i, x in enumerate(self.nodes)}
        for x in self.nodes:
            for k, child in enumerate(x.children):
                order[index[id(child)]] = k
        for i, x in enumerate(self.nodes):
            tag, tokens = own[i]
            low, high = min(tokens, default=0.0), max(tokens, default=0.0)
            p = parent[i]
            up = path[p] if p >= 0 else (0.0, 0.0, 0.0, 0.0, 0)
            path[i] = (min(up[0], tag), max(up[1], tag), min(up[2], low), max(up[3], high), up[4] + 1)
            siblings = self.nodes[p].children if p >= 0 else [x]
            around = chars[p] - chars[i] if p >= 0 else 0
            size = chars[i]
            out[i] = (
                _TAG_ID.get(x.tag, len(TAGS)), tag, low, high, *up[:4], up[4],
                np.log1p(size), size / total, links[i] / max(1, size), size / blocks[i], np.log1p(paras[i]), np.log1p(blocks[i]),
                len(siblings), order[i] / max(1, len(siblings) - 1), around / max(1, len(siblings) - 1), size / max(1, size + around),
                links[p] / max(1, chars[p]) if p >= 0 else 0, np.log1p(paras[p]) if p >= 0 else 0, own[p][0] if p >= 0 else 0,
                heads[i], heads[p] if p >= 0 else 0, paras[i] / max(1, paras[0]), own[p][1][0] if p >= 0 and own[p][1] else 0.0,
            )
        return out

    def keep(self, z: np.ndarray) -> np.ndarray:
        """Which nodes hold article text: those whose posterior, the product of the probabilities from the root, is over one half."""
        posterior = -np.logaddexp(0, -z)
        for i in range(1, len(z)):
            posterior[i] += posterior[self.parent[i]]
        return posterior > np.log(0.5)


# --- training pages -----------------------------------------------------------------------------------------------

_SYLLABLES = "ba de fi go ku la me ni po ra se ti vo za br el st on ar".split()
#: Names that sites commonly give to the parts of a page.
ARTICLE_NAMES = ("article", "content", "post content", "entry content", "article body", "story", "main content", "post", "text", "article text", "body copy", "page content", "post body", "entry", "single", "prose", "blog post", "")
OTHER_NAMES = {
    "nav": ("nav", "menu", "navbar", "main menu", "breadcrumb", "breadcrumbs", "pagination", "navigation", "top nav", "toc links", "tabs", ""),
    "header": ("header", "site header", "masthead", "banner", "top bar", "logo", "branding", "page header", ""),
    "footer": ("footer", "site footer", "copyright", "bottom", "legal", "colophon", "credits", ""),
    "sidebar": ("sidebar", "side", "aside", "widget", "related", "related posts", "popular", "trending", "recommended", "rail", "archive list", "tags", "see also", ""),
    "notice": ("cookie", "cookie notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "warning", "subscribe banner", "paywall"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad slot", "ad container", "banner ad", "sponsor", "affiliate"),
    "comments": ("comments", "comment list", "comment", "discussion", "replies", "reply", "responses", "disqus thread", "user comments", "respond"),
    "form": ("search", "search form", "newsletter", "signup", "login", "contact form", "subscribe", "feedback", ""),
    "share": ("share", "social", "share buttons", "follow us", "author bio", "byline", "meta", "post meta", "tools"),
}
_SECTION_TAG = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside", "p"), "ad": ("div", "aside", "section", "p"), "comments": ("section", "div", "aside", "ol"), "form": ("form", "form", "div"), "share": ("div", "ul", "p")}


@lru_cache(maxsize=2)
def _prose(sentences: bool) -> list[str]:
    """Made-up words in a row; what they are doesn't matter, only their lengths."""
    rng = random.Random(1)
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(20_000)]
    return [w + rng.choice(".,.,.!?") if sentences and rng.random() < 0.09 else w for w in words]


def _words(rng: random.Random, n: int, sentence: bool = True) -> str:
    words = _prose(sentence)
    at = rng.randrange(len(words) - n)
    text = " ".join(words[at : at + n])
    return text.capitalize() + rng.choice("...!?") if sentence else text


def _name(rng: random.Random, name: str) -> str:
    if not name:
        return ""
    return f' {rng.choice(("class", "class", "id"))}="{name.replace(" ", rng.choice(("-", "-", "_", " ")))}"'


def _made_up(rng: random.Random) -> str:
    """A name that no list has."""
    return _words(rng, rng.randint(1, 2), False) + rng.choice(("", "", "", "-1", " x2"))


def _teasers(rng: random.Random) -> str:
    """Previews of other articles: headings that are links, each with some text."""
    tag = rng.choice(("h2", "h3", "h3", "h4"))
    one = lambda: f"<{tag}>{_link(rng)}</{tag}><p>{_words(rng, rng.randint(4, 40))}</p>" + _link(rng) * (rng.random() < 0.3)
    wrap = rng.choice(("<div>{}</div>", "<li>{}</li>", "<div>{}</div>", "{}", '<div class="%s">{}</div>' % _made_up(rng)))
    return "".join(wrap.format(one()) for _ in range(rng.randint(2, 6)))


def _link(rng: random.Random) -> str:
    return f'<a href="/x">{_words(rng, rng.randint(1, 4), False)}</a>'


def _other(rng: random.Random, kind: str) -> str:
    if kind == "teasers":
        return f"<{(tag := rng.choice(('div', 'div', 'section', 'aside', 'ul')))}{_name(rng, rng.choice((_made_up(rng), _made_up(rng), 'related', 'more', 'latest', '')))}>{_teasers(rng)}</{tag}>"
    tag, name = rng.choice(_SECTION_TAG[kind]), rng.choice(OTHER_NAMES[kind])
    if kind in ("nav", "header", "footer", "comments") and rng.random() < 0.1:
        name = _made_up(rng)
    text = lambda a, b: _words(rng, rng.randint(a, b))
    links = lambda a, b: "".join(f"<li>{_link(rng)}</li>" for _ in range(rng.randint(a, b)))
    if kind == "nav":
        if tag == "div" and not name:
            name = "menu"
        inner = links(3, 12) if tag == "ul" else rng.choice((f"<ul>{links(3, 12)}</ul>", " ".join(_link(rng) for _ in range(rng.randint(2, 8)))))
    elif kind == "header":
        if tag == "div" and not name:
            name = "header"
        inner = rng.choice((f"<div>{_words(rng, 2, False)}</div>", f"<h1>{_words(rng, 3, False)}</h1><p>{text(3, 12)}</p>", f"<p>{text(2, 9)}</p><ul>{links(2, 5)}</ul>"))
    elif kind == "footer":
        if tag == "div" and not name:
            name = "footer"
        inner = rng.choice((text(2, 20), f"<p>{text(3, 30)}</p>", f"<ul>{links(2, 8)}</ul><p>{text(3, 15)}</p>", f"<div><p>{text(3, 9)}</p></div><div>{_link(rng)} {_link(rng)}</div>"))
    elif kind == "sidebar":
        if tag == "div" and not name:
            name = "sidebar"
        inner = f"<h3>{_words(rng, 2, False)}</h3>" * rng.randint(0, 1) + rng.choice((f"<ul>{links(2, 9)}</ul>", f"<p>{text(6, 60)}</p>", f"<div><p>{text(5, 40)}</p>{_link(rng)}</div>", text(5, 50)))
    elif kind == "comments":
        one = lambda: rng.choice((f'<div class="comment"><p>{text(4, 70)}</p></div>', f'<li class="comment"><div>{_words(rng, 2, False)}</div><p>{text(4, 60)}</p></li>', f"<p>{text(4, 70)}</p>", f"<article><p>{text(4, 60)}</p></article>"))
        inner = f"<h3>{_words(rng, 2, False)}</h3>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 6)))
    elif kind == "form":
        if tag == "div" and not name:
            name = "search-form"
        inner = f"<label>{_words(rng, 2, False)}</label><input><p>{text(3, 20)}</p>" * rng.randint(1, 2)
    else:
        inner = rng.choice((text(3, 50), text(3, 50), f"<p>{text(3, 50)}</p>", f"<div>{text(3, 30)}</div>", f"<p>{text(2, 30)}</p>{_link(rng)}"))
        if tag == "ul":
            inner = f"<li>{inner}</li>"
        if tag == "p":  # blocks would end it
            inner = text(3, 50) + rng.choice(("", f" {_link(rng)}"))
    return f"<{tag}{_name(rng, name)}>{inner}</{tag}>"


#: A private character that marks article text in training pages.
_MARK = "\ue000"


def _article(rng: random.Random) -> str:
    marked = lambda a, b: _MARK + _words(rng, min(rng.randint(a, b), int(600 ** rng.random()) + a) if b > 14 else rng.randint(a, b), rng.random() < 0.85)
    parts = []
    if rng.random() < 0.9:
        title = f"<h1>{marked(2, 12)}</h1>"
        if rng.random() < 0.2:  # title and lead may have a header of their own
            title = f"<header{_name(rng, rng.choice(('', '', 'entry header', 'article header', 'title')))}>{title}" + f"<p>{marked(4, 40)}</p>" * rng.randint(0, 1) + _other(rng, "share") * (rng.random() < 0.3) + "</header>"
        parts.append(title)
    tiny = rng.random() < 0.12
    for _ in range(1 if tiny else rng.choice((1, 1, 1, 2, 2, 3, 4, 5, 8, 12, 20, 40, 100))):
        kind = rng.random() if not tiny else 1.0
        if tiny:
            parts.append(rng.choice((f"<p>{marked(1, 12)}</p>", f"<p><b>{marked(2, 12)}<br>")))
        elif kind < 0.72:
            parts.append(rng.choice((f"<p>{marked(1, 400)}</p>", f"<p>{marked(20, 120)}</p>", f"<p>{marked(1, 6)}</p>", f"<p>{marked(1, 14)}</p>", f"<p><b>{marked(10, 60)}<br>", f"<p>{marked(20, 60)} {_link(rng)} {_words(rng, 12)}</p>", f"<div>{marked(20, 90)}</div>")))
        elif kind < 0.78:
            parts.append(f"<h2>{marked(1, 8)}</h2>")
        elif kind < 0.84:
            parts.append("<ul>" + "".join(f"<li>{marked(3, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.88:
            parts.append(f"<blockquote>{rng.choice((marked(8, 50), f'<p>{marked(8, 50)}</p>'))}</blockquote>")
        elif kind < 0.91:
            parts.append(f"<table><tr><td>{marked(1, 6)}</td><td>{marked(1, 9)}</td></tr><tr><td>{marked(1, 6)}</td><td>{marked(1, 9)}</td></tr></table>")
        elif kind < 0.94:
            parts.append(f"<pre>{marked(4, 30)}</pre>")
        elif kind < 0.96:
            parts.append(f"<figure><figcaption>{marked(3, 15)}</figcaption></figure>")
        else:
            parts.append(_other(rng, rng.choice(("ad", "share", "notice", "sidebar", "form"))))
    if rng.random() < 0.1:
        parts.append(f"<footer>{_words(rng, rng.randint(2, 12))}</footer>")
    inner = "".join(parts)
    if rng.random() < 0.22:  # no container of its own
        return inner
    tag, name = rng.choice(("article", "article", "main", "div", "div", "section", "td")), rng.choice(ARTICLE_NAMES) if rng.random() < 0.75 else _made_up(rng)
    if tag == "td":  # a table that lays the page out, perhaps with a menu beside
        beside = [f"<td{_name(rng, rng.choice(('', 'left', 'menu', 'side')))}>{rng.choice((' '.join(_link(rng) for _ in range(rng.randint(2, 9))), _other(rng, 'nav'), _other(rng, 'sidebar')))}</td>" for _ in range(rng.choice((0, 1, 1, 2)))]
        cut = rng.randint(0, len(beside))
        top = f"<tr><td colspan=2>{_other(rng, 'header')}</td></tr>" * (rng.random() < 0.3)
        return f"<table{_name(rng, rng.choice(('', '', 'layout')))}>{top}<tr>{''.join(beside[:cut])}<td{_name(rng, name)}>{inner}</td>{''.join(beside[cut:])}</tr></table>"
    return f"<{tag}{_name(rng, name)}>{inner}</{tag}>"


def layouts(n: int, seed: int) -> list[Page]:
    """Parsed training pages; ``truth`` of a node says that its subtree holds article text."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        before = [_other(rng, k) for k in ("header", "nav", "notice", "ad", "form", "teasers") if rng.random() < (0.45 if k != "teasers" else 0.12)]
        after = [_other(rng, k) for k in ("share", "comments", "ad", "sidebar", "nav", "form", "notice", "teasers") if rng.random() < 0.35] + [_other(rng, "footer")] * (rng.random() < 0.8)
        rng.shuffle(before)
        middle = _article(rng)
        if rng.random() < 0.35:
            inside = [_other(rng, k) for k in ("sidebar", "comments", "share", "ad", "nav", "teasers") if rng.random() < 0.35]
            cut = rng.randint(0, len(inside))
            middle = f"<{(tag := rng.choice(('div', 'main', 'section')))}{_name(rng, rng.choice(('wrapper', 'container', 'page', 'row', 'layout', '')))}>{''.join(inside[:cut])}{middle}{''.join(inside[cut:])}</{tag}>"
        body = "".join(before) + middle + "".join(after)
        if rng.random() < 0.08:  # some frameworks put the whole page into a form
            body = f"<form{_name(rng, rng.choice(('form1', 'page form', 'aspnet form', '')))}>{body}</form>"
        page = Page(parse(f"<html><body>{body}</body></html>"))
        for i in range(len(page.nodes) - 1, -1, -1):
            node = page.nodes[i]
            node.truth = node.truth or _MARK in node.text
            node.text = node.text.replace(_MARK, "")
            if node.truth and node.parent is not None:
                node.parent.truth = True
        pages.append(page)
    return pages


def _odds(pages: list[Page], names) -> dict[str, float]:
    """Smoothed log-odds of article text for each tag or attribute token."""
    yes: dict[str, int] = {}
    seen: dict[str, int] = {}
    for page in pages:
        for node in page.nodes:
            for name in names(node):
                seen[name] = seen.get(name, 0) + 1
                yes[name] = yes.get(name, 0) + node.truth
    return {name: float(np.log((yes[name] + 1) / (n - yes[name] + 1))) for name, n in seen.items() if n >= 5}


@lru_cache(maxsize=1)
def model(pages: int = 1000, seed: int = 11) -> tuple[dict[str, float], dict[str, float], Trees]:
    """Tag odds, attribute-token odds and trees; the odds come from other pages than the trees are fitted on."""
    drawn = layouts(2 * pages, seed)
    tags, tokens = _odds(drawn[:pages], lambda n: (n.tag,)), _odds(drawn[:pages], lambda n: n.tokens)
    tokens["hidden"] = -6.0
    x = np.concatenate([p.features(tags, tokens) for p in drawn[pages:]])
    nodes = [n for p in drawn[pages:] for n in p.nodes]
    below_kept = np.array([n.parent is None or n.parent.truth for n in nodes])
    return tags, tokens, fit_trees(x[below_kept], np.array([n.truth for n in nodes], float)[below_kept], rounds=90)


def main_texts(pages: list[str | None], fitted) -> list[str]:
    """The article text of each page: kept blocks in page order, joined by a newline."""
    tags, tokens, trees = fitted
    parsed = [Page(parse(p)) if p else None for p in pages]
    x = [p.features(tags, tokens) for p in parsed if p is not None]
    z = log_odds(trees, np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for p in parsed:
        if p is None:
            out.append("")
            continue
        kept = p.keep(z[at : at + len(p.nodes)])
        at += len(p.nodes)
        out.append("\n".join(n.text for n, k in zip(p.nodes, kept, strict=True) if k and n.text))
    return out


def _extracting(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch, "html"):
                texts = main_texts(step.column("html").to_pylist(), fitted)
                yield pa.record_batch([step.column("page_id").cast(pa.int64()), step.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html; further columns are ignored).

    Null and empty html, and pages without article text, give '' and 0. Text outside any element counts as a block of
    the page. Rows that repeat a page_id are extracted each on its own; an empty table gives an empty result.
    """
    return map_batches(pages.select("page_id", "url", "html"), _extracting(model()), "page_id long, url string, text string, n_chars long")
