"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree (inline elements belong to their block).
Every node is content or not; unary potentials score its features, pairwise
potentials its parent and itself.  Sum-product messages, first from the leaves
up, then from the root down, give each node's exact marginal; a node's text is
kept where content is likelier.  The potentials are those of a conditional
random field, fitted by gradient ascent on the likelihood of labelled pages:
a few written ones below that hold every kind of block, and pages of the table
whose own mark-up tells the article (a bounded number).

A batch of pages is one forest of arrays, so that messages pass level by level
in NumPy.  Pages are independent: one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table that the fit uses at most, about.
LABELLED_PAGES = 200
STEPS, RATE, PENALTY, SEED = 400, 0.1, 0.0002, 7

INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span "
             "strike strong sub sup time tt u var wbr picture source object param track "
             # what a browser may show in their place
             "noscript audio video canvas "
             # formulas in MathML
             "math maction merror menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
             "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no text of the page at all.
NO_TEXT = set("head script style template svg iframe select textarea annotation annotation-xml".split())
#: What a head may hold, of that what may hold text, and the tags that end any head.
_IN_HEAD = set("html head title meta link base basefont bgsound script style template noscript noframes".split())
_HEAD_TEXT = set("title script style template noscript noframes".split())
_ENDS_HEAD = {"head", "body", "html"}
_CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                "ol p pre section table ul details summary dialog".split())
#: An element of the first kind ends an open one of the second, up to the third.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
             "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAGS = ["root", "html", "body", "article", "main", "section", "div", "p", "heading", "ul", "li", "table", "quote", "figure",
         "nav", "header", "footer", "aside", "form", "control", "other"]
_GROUP = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ol": "ul",
          "menu": "ul", "dl": "ul", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table",
          "thead": "table", "tfoot": "table", "caption": "figure", "figcaption": "figure", "blockquote": "quote", "pre": "quote",
          "button": "control", "label": "control", "fieldset": "form", "legend": "control", "dialog": "aside", "details": "div",
          "summary": "p", "hgroup": "header", "address": "p"}
#: Parts of class, id and role that tell what a block is for, by kind.  Each kind
#: is evidence of its own beside the block's tag, links and amount of text; the
#: words under "maybe" are as common on content as beside it.
_WORDS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "header": "header masthead topbar logo",
    "footer": "footer copyright colophon",
    "side": "sidebar side aside rail complementary",
    "notice": "cookie cookies consent notice gdpr popup modal overlay paywall",
    "comments": "comment comments reply replies disqus respond",
    "share": "share sharing social follow",
    "form": "form login signup subscribe newsletter subscription",
    "maybe": "widget widgets related recommended trending popular more message warning alert toast tabs discussion search register legal",
    "content": "article content post entry story main body text articlebody page",
}
_KIND = {w: k for k, ws in _WORDS.items() for w in ws.split()}
_KINDS = list(_WORDS)
_BOUNDS = {"nav", "header", "footer", "aside", "form", "control"}
_SIZES = {"tag": len(_TAGS), **{f"kind {k}": 2 for k in _KINDS}, "links": 4, "length": 5, "ending": 3, "shape": 2, "mass": 5}
_FIRST = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()]).tolist()))
N_FEATURES = sum(_SIZES.values())


def _kinds_of(attrs: list[tuple[str, str | None]]) -> set[str]:
    found = set()
    for name, value in attrs:
        if name in ("class", "id", "role", "itemprop") and value:
            for w in value.lower().replace("-", " ").replace("_", " ").split():
                found.add(_KIND.get(w) or _KIND.get(w.rstrip("0123456789")))
    return found - {None}


class _Page(HTMLParser):
    """Builds the tree: parents, tags, kinds, and runs of text by node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.kinds, self.mark = [-1], ["root"], [set()], [None]
        self.stack = [0]
        self.names = ["root"]
        self.runs: list[tuple[int, list[str]]] = []
        self.open = False          # whether the last run goes on
        self.skip: list[str] = []  # elements without text that are open
        self.cut = False           # whether a tag or text ended the head, so that a title may follow
        self.link = 0
        self.linked = [0]          # characters in links, by node

    def _push(self, tag, attrs):
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.kinds.append(_kinds_of(attrs))
        self.mark.append(dict(attrs).get("data-label"))
        self.linked.append(0)
        self.stack.append(len(self.tag) - 1)
        self.names.append(tag)
        self.open = False

    def _pop(self, to: int):
        del self.stack[to:], self.names[to:]
        self.open = False
        self.link = 0

    def _cut_head(self):
        """</head> may be left out: what a head cannot hold ends it."""
        self.skip.clear()
        self.cut = True

    def handle_starttag(self, tag, attrs):
        if self.skip == ["head"] and tag in _IN_HEAD:
            if tag in _HEAD_TEXT:
                self.skip.append(tag)
            return
        if self.skip == ["head"] or (tag == "body" and self.skip and self.skip[0] in ("head", "title")):
            self._cut_head()
        if self.skip:
            if tag == self.skip[-1] and tag not in VOID:
                self.skip.append(tag)
            return
        if tag in NO_TEXT or (tag == "title" and self.cut):
            self.skip.append(tag)
            return
        if tag in INLINE:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "a":
                self.link = 1
            return
        if tag in _CLOSES_P and "p" in self.names:
            at = len(self.names) - 1 - self.names[::-1].index("p")
            if not {"td", "th", "li", "button"} & set(self.names[at:]):
                self._pop(at)
        if tag in _SIBLINGS:
            ends, within = _SIBLINGS[tag]
            for at in range(len(self.names) - 1, 0, -1):
                if self.names[at] in within:
                    break
                if self.names[at] in ends:
                    self._pop(at)
        if tag in VOID:
            self.open = False
            return
        self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in NO_TEXT or self.skip[-1:] == [tag]:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            elif self.skip[0] in ("head", "title") and tag in _ENDS_HEAD:
                self.skip.clear()
            return
        if tag == "a":
            self.link = 0
        if tag in INLINE or tag not in self.names:
            return
        self._pop(len(self.names) - 1 - self.names[::-1].index(tag))

    def handle_data(self, data):
        if self.skip == ["head"] and data.strip():
            self._cut_head()
        if self.skip:
            return
        node = self.stack[-1]
        if self.open:
            self.runs[-1][1].append(data)
        else:
            self.runs.append((node, [data]))
            self.open = True
        if self.link:
            self.linked[node] += len("".join(data.split()))


@dataclass
class Tree:
    """One page: parent and features of each node (parents first), runs of
    text, and, of a labelled page, the labels (-1: none)."""

    parent: np.ndarray
    features: np.ndarray
    bound: np.ndarray
    runs: list[tuple[int, str]]
    labels: np.ndarray = field(default_factory=lambda: np.empty(0, np.int8))


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def page_tree(html: str | None, label: str = "") -> Tree:
    """The tree of a page; ``label``: "marks" reads data-label attributes (a
    node's holds for those below), "markup" takes what the page's one article
    element holds besides boundaries (no labels if there is not one)."""
    page = _parsed(html)
    n = len(page.tag)
    runs = [(i, " ".join("".join(parts).split())) for i, parts in page.runs]
    runs = [(i, t) for i, t in runs if t]
    own, last = [0] * n, [""] * n
    for i, t in runs:
        own[i] += len(t)
        last[i] = t[-1]
    under, linked = own[:], page.linked[:]
    for i in range(n - 1, 0, -1):
        under[page.parent[i]] += under[i]
        linked[page.parent[i]] += linked[i]
    features = np.empty((n, len(_SIZES)), np.int16)
    bound = np.zeros(n, np.int8)
    for i in range(n):
        tag = _GROUP.get(page.tag[i], page.tag[i])
        group = tag if tag in _TAGS else "other"
        kinds = page.kinds[i]
        share = linked[i] / under[i] if under[i] else -1
        features[i] = (_FIRST["tag"] + _TAGS.index(group), *[_FIRST[f"kind {k}"] + (k in kinds) for k in _KINDS],
                       _FIRST["links"] + (0 if share < 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3),
                       _FIRST["length"] + (0 if not own[i] else 1 if own[i] < 20 else 2 if own[i] < 60 else 3 if own[i] < 200 else 4),
                       _FIRST["ending"] + (0 if not own[i] else 1 if last[i] in ".!?…\"”»)" else 2),
                       _FIRST["shape"] + (under[i] > own[i]),
                       _FIRST["mass"] + sum(under[i] >= n for n in (1, 60, 200, 800)))
        bound[i] = group in _BOUNDS or bool(kinds - {"maybe", "content"} and "content" not in kinds)
    labels = np.full(n, -1, np.int8)
    if label == "marks":
        for i in range(1, n):
            m = page.mark[i]
            labels[i] = int(m) if m in ("0", "1") else labels[page.parent[i]]
    elif label == "markup":
        tops = [i for i in range(n) if page.tag[i] == "article"]
        if len(tops) == 1:
            labels[:] = 0
            for i in range(tops[0], n):
                labels[i] = i == tops[0] or (labels[page.parent[i]] == 1 and not bound[i])
    parent = np.array(page.parent, np.int32)
    return Tree(parent, features, bound, runs, labels)


@dataclass
class Forest:
    """Trees as one forest of arrays, with the nodes of each depth."""

    parent: np.ndarray
    features: np.ndarray
    bound: np.ndarray
    levels: list[np.ndarray]
    starts: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.where(t.parent < 0, -1, t.parent + s) for t, s in zip(trees, starts)])
    now = np.flatnonzero(parent < 0)
    levels = [now]
    order = np.argsort(parent, kind="stable")
    keys = parent[order]
    while len(now):
        a, z = np.searchsorted(keys, now, "left"), np.searchsorted(keys, now, "right")
        count = z - a
        now = order[np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        if len(now):
            levels.append(now)
    return Forest(parent, np.concatenate([t.features for t in trees]), np.concatenate([t.bound for t in trees]), levels, starts)


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray):
    """Exact marginals of a forest in the log domain: P(node is content), and
    P(parent, child) for each node with a parent (zeros at roots).  ``unary``
    scores content, ``pair`` is (bound, parent, child)."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = unary
    edge = pair[f.bound]                       # node, state of parent, state of node
    up = own.copy()                            # own score and messages from below
    message = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        m = np.logaddexp(edge[level, :, 0] + up[level, None, 0], edge[level, :, 1] + up[level, None, 1])
        message[level] = m
        np.add.at(up, f.parent[level], m)
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parent[level]
        rest = up[p] - message[level] + down[p]
        down[level] = np.logaddexp(rest[:, 0, None] + edge[level, 0, :], rest[:, 1, None] + edge[level, 1, :])
        both = rest[:, :, None] + edge[level] + up[level][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        both = np.exp(both)
        joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


@dataclass
class PageModel:
    theta: np.ndarray
    pair: np.ndarray

    def marginals(self, f: Forest) -> np.ndarray:
        return sum_product(f, self.theta[f.features].sum(axis=1), self.pair)[0]

    def texts(self, pages: list[str | None]) -> list[str]:
        if not pages:
            return []
        trees = [page_tree(h) for h in pages]
        f = forest(trees)
        keep = self.marginals(f) > 0.5
        return [" ".join(t for i, t in tree.runs if keep[s + i]) for tree, s in zip(trees, f.starts)]


def fit_model(trees: list[Tree], weights: list[float]) -> PageModel:
    """Gradient ascent on the weighted log-likelihood of the labels, with an
    L2 penalty; nodes without a label take no part in the gradient."""
    f = forest(trees)
    labels = np.concatenate([t.labels for t in trees])
    w = np.repeat(weights, [len(t.parent) for t in trees])
    w = np.where(labels >= 0, w, 0.0)
    w /= w.sum()
    known = np.flatnonzero((f.parent >= 0) & (labels >= 0) & (labels[f.parent] >= 0))
    rng = np.random.default_rng(SEED)
    theta, pair = rng.normal(scale=0.01, size=N_FEATURES), np.zeros((2, 2, 2))
    x = [np.zeros(N_FEATURES), np.zeros((2, 2, 2))]
    y = [np.zeros(N_FEATURES), np.zeros((2, 2, 2))]
    for step in range(1, STEPS + 1):
        p, joint = sum_product(f, theta[f.features].sum(axis=1), pair)
        g_theta = -PENALTY * theta
        np.add.at(g_theta, f.features, ((labels - p) * w)[:, None])
        seen = np.zeros((len(known), 2, 2))
        seen[np.arange(len(known)), labels[f.parent[known]], labels[known]] = 1
        g_pair = -PENALTY * pair
        np.add.at(g_pair, f.bound[known], (seen - joint[known]) * w[known, None, None])
        for i, (v, g) in enumerate(((theta, g_theta), (pair, g_pair))):  # Adam
            x[i] = 0.9 * x[i] + 0.1 * g
            y[i] = 0.99 * y[i] + 0.01 * g * g
            v += RATE * (x[i] / (1 - 0.9 ** step)) / (np.sqrt(y[i] / (1 - 0.99 ** step)) + 1e-6)
    return PageModel(theta, pair)


_P = "<p>{}</p>"
_LONG = "It was late in the year when the two of them came back to the town, and nothing there had changed at all. "
_MENU = ('<nav{0}><ul><li><a href="/">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">About us</a></li></ul></nav>')


def labelled_pages() -> list[str]:
    """Written pages: data-label is 1 for content, 0 for the rest."""
    body = ("<h1>A walk along the river</h1><p>" + _LONG * 2 + "</p><p>Short one.</p><h2>The way home</h2><p>" + _LONG +
            '<a href="/x">a link</a> in it.</p><ul><li>first thing to see</li><li>second thing to see</li></ul>'
            "<blockquote>" + _LONG + "</blockquote><table><tr><td>1900</td><td>a town</td></tr></table>"
            "<figure><figcaption>The bridge.</figcaption></figure><p><b>A name</b></p>")
    few = "<h1>Notes</h1><p>One.</p><p>" + _LONG + "</p>"
    menu, top = _MENU.format(""), '<header><h1>The Daily Paper</h1><p>All the news of the day.</p></header>'
    side = ('<aside><h3>Related</h3><p>' + _LONG + '</p><ul><li><a href="/1">Another story</a></li></ul></aside>')
    foot = '<footer><p>&copy; 2020 The Daily Paper. All rights reserved. ' + _LONG + '</p></footer>'
    foot_text = "<footer>&copy; paper.example &middot; " + _LONG + "</footer>"
    ad = '<div class="ad">' + _LONG + "</div>"
    ad_p = '<div class="advertisement"><p>' + _LONG + "</p></div>"
    notice = '<div class="cookie-notice"><p>We use cookies. ' + _LONG + "</p><button>Accept</button></div>"
    alert = '<div id="notice" role="alert">' + _LONG + "</div>"
    comments = ('<section class="comments"><h2>Comments</h2><div class="comment"><p>' + _LONG + "</p></div>"
                '<div class="comment"><p>Nice one!</p></div></section>')
    thread = '<div id="comments"><ol><li><p>' + _LONG + "</p></li><li>Thanks.</li></ol></div>"
    form = ('<form><label>Your mail</label><p>Sign up for our letter. ' + _LONG + '</p><button>Send</button></form>')
    share = '<div class="share"><a href="/f">Share this</a></div>'
    menu_div = '<div class="menu"><a href="/">Home</a> <a href="/b">News</a></div>'
    bar = '<div class="sidebar"><p>' + _LONG + '</p><p>Read more.</p></div>'

    def yes(tag: str, inner: str, rest: str = "") -> str:
        return f'<{tag} data-label="1"{rest}>{inner}</{tag}>'

    def no(*parts: str) -> str:
        """Marks the first element of each part as no content."""
        return "".join(p.replace(">", ' data-label="0">', 1) if ">" in p else p for p in parts)

    def page(*parts: str) -> str:
        return f'<html data-label="0"><head><title>t</title></head><body data-label="0">{"".join(parts)}</body></html>'

    pages = []
    for inner in (body, few):
        pages += [
            page(no(menu, ad), yes("article", inner), no(foot_text)),
            page(no(top, menu), yes("article", inner + no(ad_p, share)), no(side, comments, foot)),
            page(no(notice, top), yes("main", inner), no(bar, thread, foot)),
            page(no(menu_div), yes("div", inner, ' class="content"'), no(ad, form, foot_text)),
            page(no(top), yes("div", inner, ' id="main"'), no(side, alert, comments, foot)),
            page(no(alert, menu), "<div>" + yes("article", no(ad) + inner + no(form, comments)) + no(bar) + "</div>", no(foot)),
            page(no(menu), "<main>" + yes("article", yes("header", "<h1>A title</h1>") + inner + no("<footer>Filed under news</footer>"))
                 + no(side, thread) + "</main>", no(foot_text)),
            page(no(notice, menu), yes("article", yes("div", inner, ' class="post-body"') + no(side, thread)), no(form, foot)),
            page(no(top, menu), "<div>" + yes("div", inner, ' class="entry-content"') + no(thread, share) + "</div>", no(alert, foot)),
            page(no(menu_div, ad_p), "<section>" + yes("article", inner) + no(comments) + "</section>", no(bar, foot_text)),
        ]
    plain = yes("h1", "A plain page") + yes("p", _LONG) + yes("p", "Short one.") + yes("p", _LONG)
    nav_div, foot_div = menu_div.replace("menu", "nav"), '<div id="footer">&copy; 2020. ' + _LONG + "</div>"
    # without a container of its own the body is content, but for what is marked
    bare = [page(x).replace('<body data-label="0">', '<body data-label="1">')
            for x in (plain, no(menu) + plain + no(foot_text), no(ad) + plain + no(foot))]
    pages += bare
    # words that content has as well as what stands beside it
    links = "".join(f'<li><a href="/{i}">Another story of the day {i}</a></li>' for i in range(4))
    two = "<p>" + _LONG + "</p><p>" + _LONG * 2 + "</p>"
    related = f'<div class="related"><h3>Related</h3><ul>{links}</ul></div>'
    more = '<div class="more"><a href="/m">More stories</a></div>'
    widget = f'<div class="widget popular"><h4>Popular now</h4><ul>{links}</ul></div>'
    warn = '<div class="alert message">Please log in first.</div>'
    table = '<table data-label="0"><tr>{}</tr></table>'
    for inner in (body, two):
        pages += [
            page(no(menu), yes("div", inner, ' class="post more-stories"'), no(related, foot)),
            page(no(top, warn), yes("div", inner, ' class="widget text"'), no(widget, foot_text)),
            page(no(menu), yes("section", inner, ' id="search"'), no(more, form, foot)),
            page(no(top), yes("div", "<h2>On it</h2>" + inner, ' class="related"'), no(widget, foot)),
            page(no(menu, ad), yes("article", "<h1>Word</h1>" + yes("div", two, ' class="text more"') + yes("div", "<p>" + _LONG + "</p>", ' class="message"')
                 + yes("section", "<h2>Related work</h2>" + two, ' class="related work"') + no(related, more)), no(bar, foot)),
            page(no(top), yes("article", inner + yes("div", "<p>" + _LONG + "</p>", ' class="warning"') + no(widget, share)), no(comments, foot_text)),
            page(table.format(no(f'<td><ul>{links}</ul></td>') + yes("td", inner)), no(foot)),
            page(table.format(no("<td>" + menu_div + "</td>") + yes("td", inner, ' class="maintext"') + no("<td>" + ad + "</td>")), no(foot_div)),
        ]
    pages += [
        page(no(nav_div), yes("div", "<p>Hello there, this is it.</p><p>More of it.</p>", ' id="content"'), no(foot_div)),
        page(no(nav_div), yes("div", few, ' class="post"'), no(foot_div)),
        page(no(top), yes("div", body, ' class="story"'), no(bar, foot_div)),
        f'<body data-label="0">{no(nav_div)}{yes("div", few, " id=content")}{no(foot_div)}</body>',
        yes("p", _LONG) + yes("p", "One."), yes("article", _LONG),
    ]
    return pages


def train_pages(pages: DataFrame | None = None, id_col: str = "page_id", html_col: str = "html",
                labelled: int = LABELLED_PAGES) -> PageModel:
    """The model from the written pages and, with ``pages``, from about
    ``labelled`` of its pages that have one article element, which together
    weigh as much."""
    trees = [page_tree(h, "marks") for h in labelled_pages()]
    weights = [1.0] * len(trees)
    if pages is not None:
        known = pages.where(F.col(html_col).contains("<article"))
        share = min(1.0, labelled / max(1, known.count()))
        some = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
        own = [page_tree(r[0], "markup") for r in some.select(html_col).orderBy(html_col).collect()]
        own = [t for t in own if (t.labels == 1).any()]
        trees += own  # weighed by the number of written pages, not their own
        weights += [len(weights) / len(own)] * len(own)
    return fit_model(trees, weights)


def extract_text(pages: DataFrame, model: PageModel, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with a string column ``out``: the texts of the content blocks
    in page order, white space inside a block as one space, joined by one
    space; empty for null or empty pages and pages without content.  A column
    of that name is replaced."""
    kept = pages.drop(out) if out != html_col else pages
    names = kept.columns
    place = names.index(html_col)
    name = out if out != html_col else f"{out}_text"
    schema = kept.select("*", F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                got = model.texts([x.as_py() for x in b.column(place)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, name])

    return kept.mapInArrow(run, schema)
