"""Main text of web pages by a tree-structured graphical model.

A page is a tree: its block elements, and under them the runs of text between block borders. Every node is content or not. A
node's potential is linear in its features (element, words of class and id, amount of text, links, punctuation); the
potential between parent and child is a table of two by two for each kind of child. On a tree, messages passed once
upward and once downward give the exact marginals, and the gradient of the likelihood is the difference between labels and
marginals, so the model is trained from labelled pages with the same messages. The text is the runs more likely content
than not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import arrow_batch, sampled, slices

#: Pages of the table that the model is trained on beside the layouts, at most, and the longest taken.
SAMPLE, SAMPLE_CHARS = 150, 50_000
STEPS, RATE, SHRINK = 300, 0.15, 1e-3

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe svg math canvas audio video object head title textarea select datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    """html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure
    figcaption table caption thead tbody tfoot tr td th form fieldset legend address details summary dialog hgroup menu center
    button label option hr""".split()
)
#: What an opening element closes, up to the elements that bound it.
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "label", "option", "legend", "summary"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TAGS = """html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption
    table tr td th form fieldset address details dialog button label""".split()
_BOUNDS_P = ("button", "table", "td", "th")
_THROUGH_TABLES = frozenset("table html body div tr td th tbody".split())
#: Words of class, id and role, by what they speak for.
NAMES = {
    "content": "article content post entry story main body text prose page-content maincontent articlebody".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager toc skip".split(),
    "frame": "header footer masthead topbar bottom banner copyright legal site-header site-footer contentinfo logo".split(),
    "side": "sidebar side aside rail widget related recommended trending complementary tags more popular teaser".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense outbrain taboola commercial".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall signup dialog toast".split(),
    "comment": "comment comments reply replies disqus discussion respond reader feedback".split(),
    "share": "share sharing social follow login search form author-box byline meta".split(),
}
_NAME_OF = {w: k for k, words in NAMES.items() for w in words}

#: Where markup starts, and the rest of a tag after its name: a quote opens a value only after an equals sign, and one that
#: is never closed is a character like others. All repeats are possessive, so a tag is read once.
_START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|["'])*+)>""")
_PLAIN = re.compile(r"([^>]*+)>")
_HEAD = re.compile(r"<!--|</head\b|<body\b|<(?:article|main|div|nav|p|header|section|h1)(?=[\s>])|<(script|style|title|noscript)\b", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[a-z]+")
_END = re.compile(r"[.!?…]")
_CLOSING = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW | DROPPED}

TEXT = len(TAGS)  # the feature of a run of text
FEATURES = [*TAGS, "text", "other", *NAMES, "hidden", "log_words", "links", "ends", "long", "short", "heading_above", "inside_content", "inside_other", "one"]
_AT = {name: i for i, name in enumerate(FEATURES)}
#: Kinds of children by the tables between parent and child.
KINDS = {"text": 0, "p": 1, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "pre": 1, "blockquote": 1, "li": 1, "div": 2, "section": 2}
N_KINDS = 4
_CONTENT_TAGS = frozenset(["article", "main"])
_OTHER_TAGS = frozenset("nav aside header footer form dialog button label menu address".split())


class Page:
    """Nodes in page order: parent, tag, groups of names, hidden, text (of runs), words in links, label if known."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.names: list[frozenset[str]] = []
        self.hidden: list[bool] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.label: list[str | None] = []

    def add(self, parent: int, tag: str, names: frozenset[str] = frozenset(), hidden: bool = False, text: str = "", linked: int = 0, label: str | None = None) -> int:
        for column, value in zip((self.parent, self.tag, self.names, self.hidden, self.text, self.linked, self.label), (parent, tag, names, hidden, text, linked, label)):
            column.append(value)
        return len(self.tag) - 1


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def _named(attributes: dict[str, str]) -> frozenset[str]:
    words = " ".join(attributes.get(a, "") for a in ("class", "id", "role", "itemprop", "aria-label")).lower()
    if not words:
        return frozenset()
    return frozenset(_NAME_OF[w] for w in [*_PART.findall(words), *words.split()] if w in _NAME_OF)


def parse(source: str) -> Page:
    """The page's tree, in one pass. Elements left open end with what holds them; closing tags without an opening one are
    dropped. A tag without any `>` after it is text; where quotes would hide every `>` up to the page's end, tags end at
    the next `>` from there on."""
    page = Page()
    root = page.add(-1, "html")
    open_: list[tuple[str, int]] = [("html", root)]  # element and its nearest block node
    places: dict[str, list[int]] = {"html": [0]}  # where in open_ each element stands
    run: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.add(open_[-1][1], "text", text=text, linked=linked)
        run, linked = [], 0

    def enter(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(open_))
        open_.append((name, node))

    def close(down_to: int) -> None:
        nonlocal links
        if any(name in BLOCK for name, _ in open_[down_to:]):
            flush()
        for name, _ in open_[down_to:]:
            places[name].pop()
            links -= name == "a"
        del open_[down_to:]

    def deepest(names: Iterable[str]) -> int:
        return max((places[name][-1] for name in names if places.get(name)), default=0)

    def last(names: Iterable[str], bounds: Iterable[str]) -> int:
        found = deepest(names)
        return found if found and found >= deepest(bounds) else 0

    at = 0
    for_end = len(source)
    last_end = source.rfind(">")
    rest = _REST
    unclosed: set[str] = set()
    while at < for_end:
        m = _START.search(source, at)
        tag = None
        if m and m[0] != "<!--":
            if m.end() > last_end:  # no tag ends any more: what is left is text, but for a comment
                found = source.find("<!--", at)
                m = _START.match(source, found) if found >= 0 else None
            else:
                tag = (rest if m[2] else _PLAIN).match(source, m.end())
                if not tag:
                    rest = _PLAIN
                    tag = rest.match(source, m.end())
        piece = source[at : m.start()] if m else source[at:]
        if piece:
            run.append(piece)
            if links:
                linked += len(piece.split())
        if not m:
            break
        if not tag:
            end = source.find("-->", m.end())
            at = for_end if end < 0 else end + 3
            continue
        at = tag.end()
        name, given = m[2], tag[1]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            found = last((name,), ("table",) if name in BLOCK and name not in _THROUGH_TABLES else ())
            if found:
                close(found)
            elif name == "p":
                flush()
            continue
        if name == "br" or name == "wbr":
            run.append(" " if name == "br" else "")
            continue
        if name in RAW or name in DROPPED:
            if given.rstrip().endswith("/") and name in ("svg", "math"):
                continue
            if name == "head":
                at = _head_end(source, at)
                continue
            end = None if name in unclosed else _CLOSING[name].search(source, at)
            if not end:
                if name in RAW:
                    break
                unclosed.add(name)
                continue
            at = source.find(">", end.start())
            at = for_end if at < 0 else at + 1
            continue
        if name in VOID and name != "hr":
            continue
        if name in CLOSES_P:
            p = last(("p",), _BOUNDS_P)
            if p:
                close(p)
        if name in CLOSES:
            other = last(CLOSES[name], BOUNDS[name])
            if other:
                close(other)
        if name in ("html", "body") and places.get(name):
            continue
        if name in BLOCK:
            flush()
            if name == "hr":
                continue
            attributes = _attributes(given) if given else {}
            style = attributes.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in attributes or "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden") == "true"
            enter(name, page.add(open_[-1][1], name, _named(attributes), hidden, label=attributes.get("data-label")))
        elif not given.rstrip().endswith("/"):
            links += name == "a"
            enter(name, open_[-1][1])
    flush()
    return page


def _head_end(source: str, at: int) -> int:
    """Where the head ends: at its closing tag, at the body, or at the first element that no head holds; comments and what
    scripts, styles and the title hold are skipped."""
    unclosed: set[str] = set()
    while True:
        m = _HEAD.search(source, at)
        if not m:
            return len(source)
        at = m.end()
        if m[0] == "<!--":
            end = source.find("-->", at)
            at = at if end < 0 else end + 3
        elif m[1]:
            name = m[1].lower()
            end = None if name in unclosed else _CLOSING[name].search(source, at)
            if end:
                at = end.end()
            else:
                unclosed.add(name)
        elif m[0].lower() == "</head":
            end = source.find(">", at)
            return len(source) if end < 0 else end + 1
        else:
            return m.start()


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all nodes of the pages: parent (-1 for roots), depth, kind, and the rows of features."""
    total = sum(len(p.tag) for p in pages)
    x = np.zeros((total, len(FEATURES)), np.float32)
    parent, depth, kind = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    base = 0
    for page in pages:
        n = len(page.tag)
        words, linked, ends, heading = [0] * n, [0] * n, [0] * n, False
        inside = [(False, False)] * n
        for i in range(n):
            up, tag = page.parent[i], page.tag[i]
            parent[base + i] = base + up if up >= 0 else -1
            depth[base + i] = depth[base + up] + 1 if up >= 0 else 0
            kind[base + i] = KINDS.get(tag, 3)
            row = x[base + i]
            row[_AT.get(tag, _AT["other"])] = 1
            for group in page.names[i]:
                row[_AT[group]] = 1
            row[_AT["hidden"]] = page.hidden[i]
            good, bad = inside[up] if up >= 0 else (False, False)
            names = page.names[i]
            good = good or tag in _CONTENT_TAGS or "content" in names
            bad = bad or tag in _OTHER_TAGS or page.hidden[i] or bool(names - {"content"})
            inside[i] = good, bad
            row[_AT["inside_content"]], row[_AT["inside_other"]] = good, bad
            row[_AT["heading_above"]] = heading
            heading = heading or tag == "h1"
            if tag == "text":
                words[i], linked[i] = len(page.text[i].split()), page.linked[i]
                ends[i] = len(_END.findall(page.text[i]))
        for i in range(n - 1, 0, -1):
            up = page.parent[i]
            words[up] += words[i]
            linked[up] += linked[i]
            ends[up] += ends[i]
        own = x[base : base + n]
        w = np.array(words, np.float32)
        own[:, _AT["log_words"]] = np.log1p(w) / 5
        own[:, _AT["links"]] = np.minimum(np.array(linked, np.float32) / np.maximum(w, 1), 1)
        own[:, _AT["ends"]] = np.minimum(np.array(ends, np.float32) / np.maximum(w, 1) * 5, 1)
        own[:, _AT["long"]], own[:, _AT["short"]] = w >= 25, w <= 4
        own[:, _AT["one"]] = 1
        base += n
    return parent, depth, kind, x


def _either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, score: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over a forest: chance of content per node, and per node the joint chances with its parent (2 by 2)."""
    n = len(parent)
    own = np.stack([np.zeros(n), score], 1)
    up = np.zeros((n, 2))  # message to the parent, by the parent's state
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1]) if n else []
    below = own.copy()  # own potential and all messages from children
    for level in levels[:0:-1]:
        t = tables[kind[level]]
        up[level] = _either(t[:, :, 0] + below[level, :1], t[:, :, 1] + below[level, 1:])
        np.add.at(below, parent[level], up[level])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:
        above = below[parent[level]] + down[parent[level]] - up[level]  # all that the parent knows but from this child
        both = tables[kind[level]] + above[:, :, None]
        down[level] = _either(both[:, 0], both[:, 1])
        full = both + below[level][:, None, :]
        full -= full.max((1, 2), keepdims=True)
        e = np.exp(full)
        joint[level] = e / e.sum((1, 2), keepdims=True)
    belief = below + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


def train(pages: list[Page], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and tables between parent and child, by gradient ascent on the likelihood."""
    parent, depth, kind, x = features(pages)
    y = np.concatenate(labels).astype(float)
    w, tables = np.zeros(x.shape[1]), np.zeros((N_KINDS, 2, 2))
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[parent[child]].astype(int), y[child].astype(int)] = 1
    moments = [np.zeros_like(w), np.zeros_like(tables)]
    squares = [np.zeros_like(w), np.zeros_like(tables)]
    for step in range(1, STEPS + 1):
        p, joint = marginals(parent, depth, kind, x @ w, tables)
        both = np.zeros_like(tables)
        np.add.at(both, kind[child], (seen - joint)[child])
        for value, slope, m, v in zip((w, tables), ((y - p) @ x / len(pages) - SHRINK * w, both / len(pages) - SHRINK * tables), moments, squares):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, tables


# Labelled layouts. data-label marks what is content (1) or not (0), for all below it; TEXT stands for a passage.
_CHROME_TOP = [
    '<header class="site-header" data-label="0"><div class="logo">TITLE</div><p>SHORT</p><nav><ul>LINKS</ul></nav></header>',
    '<div id="masthead" data-label="0"><div>SHORT</div><ul class="menu">LINKS</ul></div><div class="breadcrumbs" data-label="0"><a href="/">SHORT</a></div>',
    '<nav data-label="0"><ul>LINKS</ul></nav><div class="ad" data-label="0">PASSAGE</div>',
    '<div role="banner" data-label="0"><span>TITLE</span></div><div role="navigation" data-label="0">LINKS</div>',
    '<div class="cookie-notice" role="alert" data-label="0"><p>PASSAGE</p><button>SHORT</button></div>',
    '<div class="top" data-label="0"><ul>LINKS</ul></div>',
]
_CHROME_END = [
    '<aside class="sidebar" data-label="0"><h3>SHORT</h3><ul>LINKS</ul><p>PASSAGE</p></aside>',
    '<div class="related" data-label="0"><h4>SHORT</h4><ul>LINKS</ul></div><div class="share" data-label="0">LINKS</div>',
    '<section id="comments" class="comments" data-label="0"><h2>SHORT</h2><div class="comment"><p>PASSAGE</p></div><div class="comment"><p>PASSAGE</p></div></section>',
    '<ol class="comment-list" data-label="0"><li><p>PASSAGE</p></li><li><p>PASSAGE</p></li></ol><form data-label="0"><label>SHORT</label><p>SHORT</p></form>',
    '<form class="newsletter" data-label="0"><p>PASSAGE</p><label>SHORT</label><button>SHORT</button></form>',
    '<div class="advertisement" data-label="0"><p>PASSAGE</p></div>',
    '<footer data-label="0">SHORT &copy; PASSAGE</footer>',
    '<div id="footer" data-label="0"><p>SHORT</p><ul>LINKS</ul></div>',
    '<div class="notice" data-label="0">PASSAGE</div>',
]
_INSERTS = [
    "",
    '<div class="ad" data-label="0">PASSAGE</div>',
    '<aside data-label="0"><p>PASSAGE</p></aside>',
    '<div class="promo" data-label="0"><a href="/x">SHORT</a></div>',
    '<form data-label="0"><p>PASSAGE</p><button>SHORT</button></form>',
    '<nav class="toc" data-label="0"><ul>LINKS</ul></nav>',
    '<p class="notice" data-label="0">PASSAGE</p>',
    '<blockquote>PASSAGE</blockquote>',
    "<ul><li>PASSAGE</li><li>SHORT PASSAGE</li></ul>",
    "<h2>SHORT</h2><pre>PASSAGE</pre>",
    "<table><tr><td>SHORT</td><td>PASSAGE</td></tr></table>",
]
_BODIES = [
    '<article data-label="1"><h1>TITLE</h1>BLOCKS</article>',
    '<main data-label="1"><h1>TITLE</h1><div class="content">BLOCKS</div></main>',
    '<div class="post-content" data-label="1"><h1>TITLE</h1>BLOCKS</div>',
    '<div id="content"><div class="entry" data-label="1"><h2>TITLE</h2>BLOCKS</div></div>',
    '<main><article class="story" data-label="1"><header><h1>TITLE</h1></header><section>BLOCKS</section></article></main>',
    '<div data-label="1"><h1>TITLE</h1>BLOCKS</div>',
    '<section data-label="1"><h1>TITLE</h1><div>BLOCKS</div></section>',
    '<div id="main" data-label="1"><div class="article-body"><h1>TITLE</h1>BLOCKS</div></div>',
]


def layouts(passages: list[str], n: int = 160, seed: int = 7) -> list[str]:
    """Labelled pages: layouts put together by number, filled with passages."""
    rng = np.random.default_rng(seed)

    def some(text: str, low: int, high: int) -> str:
        words = text.split() or ["word"]
        size = int(rng.integers(low, high))
        at = int(rng.integers(0, max(1, len(words) - size)))
        return html.escape(" ".join(words[at : at + size]))

    def filled(layout: str) -> str:
        def one(m: re.Match) -> str:
            text = passages[int(rng.integers(len(passages)))]
            if m[0] == "LINKS":
                return "".join(f'<li><a href="/{i}">{some(text, 1, 4)}</a></li>' for i in range(int(rng.integers(3, 8))))
            return some(text, *{"TITLE": (3, 12), "SHORT": (1, 6), "PASSAGE": (6, 40)}[m[0]])

        return re.sub("LINKS|TITLE|SHORT|PASSAGE", one, layout)

    def pick(some: list[str]) -> str:
        return some[int(rng.integers(len(some)))]

    out = []
    for _ in range(n):
        paragraphs = ["<p>PASSAGE PASSAGE</p>" if rng.random() < 0.7 else "<p>SHORT</p>" for _ in range(int(rng.integers(1, 9)))]
        paragraphs.insert(int(rng.integers(len(paragraphs) + 1)), pick(_INSERTS))
        end = "".join(pick(_CHROME_END) for _ in range(int(rng.integers(1, 4))))
        body = pick(_BODIES).replace("BLOCKS", "".join(paragraphs) + (pick(_CHROME_END) if rng.random() < 0.3 else ""))
        out.append(filled(f"<html><body>{pick(_CHROME_TOP)}{pick(_CHROME_TOP)}{body}{end}</body></html>"))
    return out


def _marked(page: Page) -> np.ndarray:
    """Labels by data-label, handed down; what has none above it is content if anything below it is."""
    n = len(page.tag)
    label = np.full(n, -1)
    for i in range(n):
        label[i] = int(page.label[i]) if page.label[i] is not None else label[page.parent[i]] if i else -1
    out = np.maximum(label, 0)
    for i in range(n - 1, 0, -1):
        if out[i] and label[page.parent[i]] < 0:
            out[page.parent[i]] = 1
    return out


def _by_element(page: Page) -> np.ndarray | None:
    """Labels of a page with one article element: that is content but for what is named or made for something else."""
    if page.tag.count("article") != 1:
        return None
    n = len(page.tag)
    state = [0] * n  # 0 outside, 1 content, 2 something else inside it
    for i in range(n):
        above = state[page.parent[i]] if i else 0
        other = page.tag[i] in _OTHER_TAGS - {"header"} or page.hidden[i] or bool(page.names[i] & {"menu", "side", "advert", "notice", "comment", "share"})
        state[i] = 2 if above == 2 or above == 1 and other else 1 if above == 1 or page.tag[i] == "article" else 0
    out = np.array(state) == 1
    for i in range(n - 1, 0, -1):
        if out[i] and state[page.parent[i]] == 0:
            out[page.parent[i]] = True
    return out.astype(np.int64)


def fit(sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trained on labelled layouts, filled with the pages' own text, and on those of the pages that say where their article is."""
    pages = [parse(s) for s in sources]
    passages = [t for p in pages for t in p.text if len(t.split()) > 20][:500] or ["The quick brown fox jumps over the lazy dog. " * 8]
    marked = [parse(s) for s in layouts(passages)]
    labels = [_marked(p) for p in marked]
    for page in pages:
        found = _by_element(page)
        if found is not None:
            marked.append(page)
            labels.append(found)
    return train(marked, labels)


def texts_of(sources: list[str], weights: np.ndarray, tables: np.ndarray) -> list[str]:
    """Main text of each page: its content runs joined by line feeds."""
    pages = [parse(s) for s in sources]
    parent, depth, kind, x = features(pages)
    p, _ = marginals(parent, depth, kind, x @ weights, tables)
    out, base = [], 0
    for page in pages:
        chance = p[base : base + len(page.tag)]
        out.append("\n".join(t for t, c in zip(page.text, chance.tolist()) if t and c > 0.5))
        base += len(page.tag)
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars. A null html is empty and has no text; so has a page without any.

    Repeated rows and null ids and urls stay as they are; other columns are not read; an empty table gives no rows. The model is
    fitted on labelled layouts and on at most SAMPLE pages, first by a hash of page_id; every page is then read whole.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    short = rows.filter(F.length("html").between(1, SAMPLE_CHARS))
    taken = sorted(sampled(short, "page_id", "html", SAMPLE).collect(), key=lambda r: (r.place, r.row))
    model = spark.sparkContext.broadcast(fit([r.value for r in taken]))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, tables = model.value
        for batch in batches:
            for part in slices(batch, 2, 1 << 20, 256):
                found = texts_of(part.column(2).to_pylist(), weights, tables)
                yield arrow_batch(schema, [part.column(0), part.column(1).cast(pa.string()), found, [len(t) for t in found]])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
