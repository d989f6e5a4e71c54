"""Main-text extraction by a tree-structured graphical model of the page.

A tolerant scanner turns a page's HTML into a tree of elements.  Every element
is content or not; unary scores come from its tag, the words of its class and
id, and the text and links below it, and parent-child potentials tie an element
to its parent.  Sum-product messages go up and down the tree (by depth, for all
pages of a batch at once) and give exact marginals.  Weights are learned by
gradient ascent on the labelled trees' likelihood; the labelled pages are
written by a seeded generator in this module that knows every region's role.
The text of elements whose marginal for content is over one half is returned,
one block a line; a line break is white space, and images, word break
opportunities and the like aren't.  Forms, scripts, styles and templates never hold
text of the article, whatever their marginal, nor do what is shown only where an
object, a video, a sound or a canvas can't be, what a drawing or formula keeps
unseen (definitions, descriptions, annotations), dialogs that aren't open, and
elements that their page hides: by the attribute hidden, by aria-hidden="true", or by display: none or
visibility: hidden in their own style (below the latter, visibility: visible
shows an element again).  Formulas, labels of drawings and image maps go with
the element around them, open dialogs are left to the model.  Such words in names and labels are left to the model.

Edge cases: null or empty HTML gives an empty text; unclosed, misnested and
unknown tags are accepted; text outside any tag belongs to the page's root;
repeated rows are treated alike; an empty table gives an empty result; other
columns of the input are ignored; nothing is cut from long pages.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import arrow, texts
from .storage import columns

# Fixed values of the HTML standard: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset({"br", "hr"})
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("script style textarea title noscript iframe xmp noembed noframes template head canvas object select option button datalist form audio video desc metadata defs symbol annotation annotation-xml".split())
FOREIGN = frozenset({"svg", "math"})
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption address header footer nav aside form fieldset details dialog summary hr menu hgroup search center".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot", "figcaption", "summary"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl td th section article div main aside nav header footer form".split())
INLINE_FORMAT = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var map svg g text tspan textpath foreignobject math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup mover munder munderover mtable mtr mtd".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CONCEALS = re.compile(r"hidden|display|visibility|&", re.I)
#: What can hold a semicolon inside a style's declaration, and comments.
_OPAQUE = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|\([^)]*\)""", re.S)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Elements in page order; ``pieces`` are (element, text, is a break)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)
    gone: list[bool] = field(default_factory=list)  # not rendered, with all below
    visible: list[bool | None] = field(default_factory=list)  # None: as the element around


def concealed(attrs: str) -> tuple[bool, bool | None]:
    """Whether an element with these attributes isn't rendered, and whether it is visible (None: not said)."""
    if not _CONCEALS.search(attrs):
        return False, None
    own: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        own.setdefault(name.lower(), entities.unescape(a or b or c))
    style: dict[str, tuple[bool, str]] = {}
    for declaration in _OPAQUE.sub("", own.get("style", "")).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        # The last declaration of a property counts, important ones first.
        if bool(mark) >= style.get(name.strip(), (False, ""))[0]:
            style[name.strip()] = (bool(mark), value.strip())
    at = style.get("visibility", (False, ""))[1]
    gone = "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or style.get("display", (False, ""))[1] == "none"
    return gone, {"hidden": False, "collapse": False, "visible": True}.get(at)


def parse(page: str) -> Tree:
    """The tree of a page; node 0 is the root, breaks are white-space pieces, other void elements aren't."""
    t = Tree(["#root"], [-1], [""], gone=[False], visible=[None])
    stack = [0]
    tags, parents, names, pieces = t.tags, t.parents, t.names, t.pieces
    at, end, find = 0, len(page), _TOKEN.search
    while at < end:
        m = find(page, at)
        start = m.start() if m else end
        if start > at:
            pieces.append((stack[-1], page[at:start]))
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == tag:
                    # A formatting tag doesn't close the block that it was opened around.
                    if tag in INLINE_FORMAT and any(tags[k] in BLOCK for k in stack[i + 1 :]):
                        break
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == "p":
                    del stack[i:]
                    break
                if tags[stack[i]] in SCOPE:
                    break
        if tag in SAME_CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in SAME_CLOSES[tag]:
                    del stack[i:]
                    if tag != "tr" or tags[stack[-1]] != "tr":
                        break
                elif tags[stack[i]] in SCOPE:
                    break
        attrs = m.group(3)
        node = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        names.append(" ".join(f"{k} {a or b or c or ''}" for k, a, b, c in _NAMES.findall(attrs)).lower() if len(attrs) > 3 else "")
        gone, visible = concealed(attrs)
        # A dialog that isn't open isn't rendered.
        gone = gone or tag == "dialog" and not any(k.lower() == "open" for k, *_ in _ATTRIBUTE.findall(attrs))
        t.gone.append(gone)
        t.visible.append(visible)
        if tag in VOID:
            if tag in BREAKS:
                pieces.append((node, "\n"))
            continue
        if attrs.endswith("/") and (tag in FOREIGN or any(tags[k] in FOREIGN for k in stack)):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            pieces.append((node, page[at : close.start() if close else end]))
            at = close.end() if close else end
            continue
        stack.append(node)
    return t


#: Hashed words of tag, class and id, its own and of the elements above; then the numeric features.
WORD_SLOTS = 4096
NUMERIC = 14


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_SLOTS


@lru_cache(100_000)
def _slots(tag: str, names: str, parent: str, above: str) -> tuple[int, ...]:
    words = [f"t:{tag}", f"p:{parent}>{tag}"]
    words += [f"w:{w}" for w in set(_WORD.findall(names)) if len(w) > 1]
    words += [f"a:{w}" for w in set(_WORD.findall(above)) if len(w) > 1]
    return tuple(_slot(w) for w in words)


@dataclass
class Forest:
    """The trees of some pages as arrays over all their nodes."""

    parents: np.ndarray
    depth: np.ndarray
    words: tuple[np.ndarray, np.ndarray]  # (node, slot) pairs
    numeric: np.ndarray
    first: np.ndarray  # of each page


def forest(trees: list[Tree]) -> Forest:
    parents, depth, owners, slots, first = [], [], [], [], [0]
    own_chars, own_link, own_words, stops = [], [], [], []
    for t in trees:
        base, n = len(parents), len(t.tags)
        d, linked, above = [0] * n, [False] * n, [""] * n
        chars, stop, words = [0] * n, [0] * n, [0] * n
        for i in range(n):
            p = t.parents[i]
            if p >= 0:
                d[i] = d[p] + 1
                linked[i] = linked[p] or t.tags[i] == "a"
                up = t.parents[p]
                # Tags and names of up to three elements above.
                above[i] = f"{t.tags[p]} {t.names[p]} {t.tags[up]} {t.names[up]}" if up >= 0 else t.tags[p]
                if up >= 0 and (top := t.parents[up]) >= 0:
                    above[i] += f" {t.tags[top]} {t.names[top]}"
            found = _slots(t.tags[i], t.names[i], t.tags[p] if p >= 0 else "", above[i])
            owners += [base + i] * len(found)
            slots += found
        for i, text in t.pieces:
            if t.tags[i] not in HIDDEN:
                s = text.strip()
                chars[i] += len(s)
                words[i] += s.count(" ") + bool(s)
                stop[i] += s.count(". ") + s.count(", ") + s.endswith((".", "!", "?"))
        parents += [base + p if p >= 0 else -1 for p in t.parents]
        depth += d
        own_chars += chars
        own_words += words
        stops += stop
        own_link += [c if a else 0 for c, a in zip(chars, linked, strict=True)]
        first.append(len(parents))
    parent, deep = np.array(parents, dtype=np.int64), np.array(depth, dtype=np.int64)
    sums = np.array([own_chars, own_link, own_words, stops], dtype=np.float64)
    own = sums.copy()
    kids = np.bincount(parent[parent >= 0], minlength=len(parent)).astype(np.float64)
    for level in range(int(deep.max(initial=0)), 0, -1):
        at = np.flatnonzero(deep == level)
        for row in sums:
            row += np.bincount(parent[at], row[at], len(parent))
    c, link, w, s = sums
    page = np.repeat(np.arange(len(trees)), np.diff(first))
    total = np.maximum(c[np.array(first[:-1], dtype=np.int64)], 1)[page] if len(trees) else c
    up = np.maximum(parent, 0)
    x = np.stack([
        np.log1p(c) / 5, np.log1p(own[0]) / 5, link / np.maximum(c, 1), c > 0, np.log1p(w) / 4, np.minimum(s / np.maximum(w, 1) * 8, 2), c / total, c / np.maximum(c[up], 1),
        link[up] / np.maximum(c[up], 1), np.minimum(deep, 12) / 6, np.log1p(kids) / 3, own[0] > 60, c > 400, np.ones(len(c)),
    ], axis=1).astype(np.float64)
    return Forest(parent, deep, (np.array(owners, dtype=np.int64), np.array(slots, dtype=np.int64)), x, np.array(first, dtype=np.int64))


@dataclass
class Model:
    words: np.ndarray  # a node's score for content, by slot
    numeric: np.ndarray
    pair: np.ndarray  # (parent's label, child's label)

    def unary(self, f: Forest) -> np.ndarray:
        node, slot = f.words
        return np.bincount(node, self.words[slot], len(f.parents)) + f.numeric @ self.numeric


def sum_product(f: Forest, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (nodes, 2) and, for nodes with a parent, the pairs' (nodes, 2, 2), by messages up and down."""
    n = len(f.parents)
    emit = np.stack([np.zeros(n), score], axis=1)
    up, to_parent = emit.copy(), np.zeros((n, 2))
    levels = [np.flatnonzero(f.depth == d) for d in range(int(f.depth.max(initial=0)) + 1)]
    for at in reversed(levels[1:]):
        m = np.logaddexp(pair[None, :, 0] + up[at][:, :1], pair[None, :, 1] + up[at][:, 1:])
        m -= m.max(axis=1, keepdims=True)
        to_parent[at] = m
        for k in (0, 1):
            up[:, k] += np.bincount(f.parents[at], m[:, k], n)
    belief = up.copy()
    pairs = np.zeros((n, 2, 2))
    for at in levels[1:]:
        p = f.parents[at]
        rest = belief[p] - to_parent[at]
        joint = rest[:, :, None] + pair[None] + up[at][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief[at] = np.log(np.maximum(pairs[at].sum(axis=1), 1e-300))
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True), pairs


def text_of(t: Tree, content: np.ndarray) -> str:
    """The content's blocks in page order, joined by newlines."""
    n = len(t.tags)
    hidden, visible, block, skip = [False] * n, [True] * n, [0] * n, [False] * n
    for i in range(n):
        p = t.parents[i]
        hidden[i] = t.tags[i] in HIDDEN or p >= 0 and hidden[p] or t.gone[i]
        visible[i] = p < 0 or visible[p] if t.visible[i] is None else t.visible[i]
        block[i] = i if t.tags[i] in BLOCK or p < 0 else block[p]
        skip[i] = hidden[i] or not content[i] and t.tags[i] not in INLINE_FORMAT and t.tags[i] not in VOID
        # Inline formatting goes with the element around it.
        if not hidden[i] and (t.tags[i] in INLINE_FORMAT or t.tags[i] in VOID) and p >= 0:
            skip[i] = skip[p]
    blocks: list[list[str]] = []
    last = None
    for i, text in t.pieces:
        here = block[i]
        if here != last:
            blocks.append([])
            last = here
        if visible[i] and not skip[i]:
            # References are decoded text by text: what elements join is no reference.
            blocks[-1].append(entities.unescape(text))
    out = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(b for b in out if b)


# ---------------------------------------------------------------------------
# Labelled pages for training
# ---------------------------------------------------------------------------
# Names that public pages commonly give to their regions.
BOILER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager tabs toc skip",
    "header": "header masthead banner topbar site-header logo branding",
    "footer": "footer site-footer copyright legal bottom colophon",
    "aside": "sidebar aside related widget widgets rail recommended popular trending tags share social newsletter subscribe",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp",
    "notice": "cookie cookies notice consent gdpr banner alert popup modal overlay paywall disclaimer",
    "comments": "comments comment comment-list replies reply discussion disqus respond comment-body",
    "form": "search login signup form",
}
CONTENT = "content article post entry story main body text article-body post-content entry-content story-body prose page-content"


def _labelled(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for every element that ``parse`` finds but the root, whether it is content."""
    html, labels = [], []

    def word() -> str:
        return "".join(rng.choice(list("aeioubcdlmnrst"), size=int(rng.integers(2, 10))))

    def sentence(n: int) -> str:
        s = " ".join(word() for _ in range(n)).capitalize()
        return s.replace(" ", ", ", 1) + str(rng.choice([".", ".", "!", "?"]))

    def el(tag: str, label: bool, body, names: str = "") -> None:
        html.append(f"<{tag}{names}>")
        labels.append(label)
        if callable(body):
            body()
        else:
            html.append(body)
        html.append(f"</{tag}>")

    def named(words: str, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        w = str(rng.choice(words.split()))
        return f' {rng.choice(["class", "id"])}="{w}{rng.choice(["", " " + word()])}"'

    def links(n: int, label: bool) -> None:
        el("ul", label, lambda: [el("li", label, lambda: el("a", label, word(), ' href="/x"')) for _ in range(n)])

    def inline(label: bool) -> None:
        for _ in range(int(rng.integers(1, 4))):
            html.append(sentence(int(rng.integers(3, 25))) + " ")
            if rng.random() < 0.3:
                el(str(rng.choice(["b", "i", "em", "strong", "a", "span"])), label, word())
                html.append(" ")

    def prose(label: bool, n: int) -> None:
        for _ in range(n):
            kind = rng.random()
            if kind < 0.75:
                el("p", label, lambda: inline(label))
            elif kind < 0.83:
                el(str(rng.choice(["h2", "h3", "h4"])), label, sentence(4))
            elif kind < 0.9:
                el(str(rng.choice(["ul", "ol"])), label, lambda: [el("li", label, lambda: inline(label)) for _ in range(int(rng.integers(1, 5)))])
            elif kind < 0.94:
                el("blockquote", label, lambda: el("p", label, lambda: inline(label)))
            elif kind < 0.97:
                el("pre", label, lambda: el("code", label, sentence(6)))
            else:
                el("table", label, lambda: [el("tr", label, lambda: [el("td", label, sentence(3)) for _ in range(3)]) for _ in range(2)])

    def boiler(kind: str) -> None:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "div", "aside", "ins", "section"], "notice": ["div", "section", "p", "aside"], "comments": ["section", "div", "ol"], "form": ["form", "div"]}[kind]
        tag = str(rng.choice(tag))
        needed = tag in ("div", "section", "p", "ul", "ol")

        def body() -> None:
            if kind == "nav":
                links(int(rng.integers(2, 9)), False)
            elif kind in ("ad", "notice"):
                if rng.random() < 0.5 or tag == "p":
                    html.append(sentence(int(rng.integers(3, 30))))
                else:
                    prose(False, int(rng.integers(1, 3)))
                if rng.random() < 0.4:
                    el("button", False, word())
            elif kind == "comments":
                el("h3", False, "Comments")
                for _ in range(int(rng.integers(1, 5))):
                    el(str(rng.choice(["div", "li", "article"])), False, lambda: prose(False, int(rng.integers(1, 3))), named(BOILER["comments"], 0.9))
            elif kind == "form":
                el("label", False, word())
                labels.append(False)
                html.append("<input type=text>")
            elif kind == "aside":
                if rng.random() < 0.5:
                    el("h3", False, sentence(2))
                if rng.random() < 0.6:
                    links(int(rng.integers(2, 8)), False)
                else:
                    prose(False, int(rng.integers(1, 4)))
            else:
                if rng.random() < 0.5:
                    el("p", False, sentence(int(rng.integers(2, 14))))
                else:
                    html.append("&copy; " + sentence(int(rng.integers(2, 14))))
                if rng.random() < 0.4:
                    links(3, False)

        el(tag, False, body, named(BOILER[kind], 1.0 if needed else 0.5))

    def some(kinds: list[str], chance: float) -> None:
        for k in kinds:
            if rng.random() < chance:
                boiler(k)

    def article() -> None:
        if rng.random() < 0.85:
            if rng.random() < 0.25:
                el("header", True, lambda: el("h1", True, sentence(6)))
            else:
                el("h1", True, sentence(6))
        for _ in range(int(rng.integers(1, 4))):
            prose(True, int(rng.integers(1, 5)))
            some(["ad", "aside", "notice"], 0.12)
        if rng.random() < 0.2:
            el("section", True, lambda: prose(True, 2))
        if rng.random() < 0.2:
            el("div", True, lambda: prose(True, 2), named(CONTENT, 0.5))
        some(["aside", "comments", "form"], 0.12)

    def main() -> None:
        style = rng.random()
        if style < 0.55:
            el("article", True, article, named(CONTENT, 0.3))
        elif style < 0.75:
            el("main", True, lambda: (el("article", True, article) if rng.random() < 0.5 else article()))
        else:
            el("div", True, article, named(CONTENT, 0.9))

    def body() -> None:
        some(["notice", "header", "nav", "ad", "form"], 0.55)
        if rng.random() < 0.4:
            el("div", True, lambda: (main(), some(["aside", "ad", "comments"], 0.4)), named("wrapper container page layout wrap row", 0.8))
        else:
            main()
        some(["aside", "comments", "ad", "footer", "notice", "nav"], 0.5)

    def head() -> None:
        el("title", False, sentence(5))
        if rng.random() < 0.7:
            el("style", False, "p{margin:0}")
        if rng.random() < 0.7:
            el("script", False, "var a=1;")

    el("html", True, lambda: (el("head", False, head), el("body", True, body)))
    return "<!DOCTYPE html>" + "".join(html), labels


#: Labelled pages and gradient steps of the training.
PAGES, STEPS = 500, 250


@lru_cache(2)
def train(pages: int = PAGES, steps: int = STEPS, seed: int = 5) -> Model:
    """Maximum likelihood by Adam; gradients are differences of labels and marginals."""
    rng = np.random.default_rng(seed)
    trees, labels = [], []
    for _ in range(pages):
        page, known = _labelled(rng)
        t = parse(page)
        if len(t.tags) != len(known) + 1:
            raise ValueError("a generated page isn't parsed as it was written")
        trees.append(t)
        labels += [True, *known]
    f = forest(trees)
    y = np.array(labels, dtype=np.int64)
    model = Model(np.zeros(WORD_SLOTS), np.zeros(NUMERIC), np.zeros((2, 2)))
    node, slot = f.words
    child = np.flatnonzero(f.parents >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[f.parents[child]], y[child]), 1)
    # Features go missing in training now and then, so that none is relied on alone.
    parts = (model.words, model.numeric, model.pair)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for step in range(1, steps + 1):
        keep = rng.random(len(slot)) < 0.8
        score = np.bincount(node[keep], model.words[slot[keep]], len(y)) + f.numeric @ model.numeric
        p, pairs = sum_product(f, score, model.pair)
        d = (y - p[:, 1]) / pages
        grads = (np.bincount(slot[keep], d[node[keep]], WORD_SLOTS) - 0.003 * model.words, f.numeric.T @ d - 0.003 * model.numeric, (seen - pairs[child].sum(axis=0)) / pages - 0.01 * model.pair)
        for w, g, (m, v) in zip(parts, grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def extract_texts(model: Model, pages: list[str]) -> list[str]:
    trees = [parse(p) for p in pages]
    f = forest(trees)
    p, _ = sum_product(f, model.unary(f), model.pair)
    content = p[:, 1] > 0.5
    return [text_of(t, content[a:b]) for t, a, b in zip(trees, f.first[:-1], f.first[1:], strict=True)]


def extract(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    model = model or train()
    rows = columns(df, page_id=id_col, url=url_col, html=html_col)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in texts(batches, 2, 1 << 20):
            out = extract_texts(model, [(t or b"").decode() for t in found])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.transform(arrow(run, f"{kinds}, text string, n_chars long"))
