"""HTML main-text extraction: gradient-boosted trees over DOM-node features, and hierarchical decoding.

A page is parsed to its block elements; text in inline elements belongs to the block around it. Trees give each block a
log-odds of being main text, from subtree density, attribute tokens, depth, siblings and what encloses it. A dynamic
programme over the page's tree then labels whole subtrees as text or not, or as mixed at a price, so that no block
contradicts the ones around it. The trees are fitted in numpy on pages made by rule here, whose blocks are known: layouts,
names of classes, missing end tags and the like vary at random. No column but the html is read.

Scripts, styles, frames, drawings and the controls that hold choices or entries are never text; formulas, buttons and the
fallback content of objects are inline text and go as the block around them goes. A head ends at its end tag or, where that
is left out, at the first element or text that can't stand in it.

A null or empty page, or one without main text, gives the empty text. Malformed markup is read as far as it goes: unclosed
elements end with their parents, unmatched end tags are passed over. Very long and deeply nested pages are read whole, in
time that grows with their length. Blocks of equal features are judged alike (ties go to "not text"). Repeated rows give
equal texts; other columns of the table are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointmill.llm.common import arrow_map

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: The trainer's mark of a block's kind; read on its own pages only.
_TRUTH = re.compile(r'data-truth="([01])"')
_SKIPPED = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title"))
_RAW = frozenset(("script", "style", "textarea", "iframe", "noscript", "template", "title"))
_IN_HEAD = frozenset(("head", "title", "meta", "link", "base", "basefont", "script", "style", "noscript", "template"))
_CLOSE = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in _SKIPPED}
_VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"))
_INLINE = frozenset(("a", "b", "i", "em", "strong", "span", "u", "s", "small", "big", "sub", "sup", "code", "kbd", "samp", "var", "abbr", "cite", "q", "mark", "time", "font", "tt", "del", "ins", "label", "dfn", "bdi", "bdo", "data", "picture", "acronym", "strike", "nobr", "math", "button", "object", "canvas", "ruby", "rt", "rp", "output", *"semantics annotation mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mstyle mspace mfenced mpadded mphantom".split()))
#: An open element of these is ended by a start tag of the others.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"tr", "thead"}}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "main", "aside", "nav", "blockquote"))

#: Pages made for training.
MADE_PAGES = 2000
TAGS = ("article", "main", "section", "div", "p", "heading", "list", "item", "table", "cell", "nav", "aside", "header", "footer", "form", "quote", "pre", "figure", "other")
_TAG = {t: TAGS.index(t) for t in ("article", "main", "section", "div", "p", "nav", "aside", "header", "footer", "form", "pre")}
_TAG |= {t: TAGS.index(k) for k, names in {"heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl menu", "item": "li dt dd", "table": "table tbody thead tr", "cell": "td th", "quote": "blockquote", "figure": "figure figcaption", "form": "fieldset"}.items() for t in names.split()}
#: Groups of words in class, id, role and itemprop. A group is one feature of a node, and one of what encloses it.
TOKENS: dict[str, str] = {
    "text": "article articlebody content main post entry story text body prose copy page-content maincontent blogpost",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead banner topbar logo hero branding",
    "foot": "footer foot colophon copyright legal contentinfo credits",
    "side": "sidebar aside side rail widget complementary secondary related recommended popular trending tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted promotion adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert message popup modal overlay toast warning disclaimer announcement",
    "comment": "comment comments reply replies discussion disqus respond responses feedback reviews commentlist thread",
    "form": "form login signup subscribe newsletter search searchbox register contact",
    "share": "share sharing social follow like buttons toolbar meta byline author date tools print",
}
_TOKEN_BIT = {w: 1 << i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = 1 << len(TOKENS)


@dataclass
class Page:
    """The blocks of a page in document order; runs are stretches of text that no block start or end interrupts."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)
    own: list[list[int]] = field(default_factory=list)  # characters, link characters, words, sentence marks, links
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str, truth_marks: bool = False) -> Page:
    out = Page()
    children: list[int] = []
    open_names: Counter[str] = Counter()
    in_head = False
    stack: list[tuple[str, int]] = []  # open elements and the block that each belongs to
    parts: list[str] = []
    links = 0
    current = -1

    def block(name: str, attributes: str) -> int:
        i = len(out.tag)
        out.tag.append(_TAG.get(name, len(TAGS) - 1))
        out.parent.append(current)
        out.depth.append(out.depth[current] + 1 if current >= 0 else 0)
        bits, truth = 0, -1
        if attributes:
            if truth_marks and (mark := _TRUTH.search(attributes)):
                truth = int(mark[1])
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key == "style":
                    bits |= _HIDDEN * (re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
                elif key == "hidden" or key == "aria-hidden":
                    bits |= _HIDDEN * (key == "hidden" or value == "true")
                else:
                    for w in _SPLIT.split(_CAMEL.sub(" ", value).lower()):
                        bits |= _TOKEN_BIT.get(w, 0)
        out.bits.append(bits)
        out.truth.append(truth if truth >= 0 or current < 0 else out.truth[current])
        out.place.append(children[current] if current >= 0 else 0)
        if current >= 0:
            children[current] += 1
        children.append(0)
        out.own.append([0, 0, 0, 0, 0])
        return i

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.runs.append((current, text))
                own = out.own[current]
                own[0] += len(text)
                own[2] += text.count(" ") + 1
                own[3] += text.count(".") + text.count(",") + text.count("?") + text.count("!")

    def end(upto: int) -> None:
        nonlocal current, links
        flush()
        while len(stack) > upto:
            name, _ = stack.pop()
            open_names[name] -= 1
            if name == "a":
                links -= 1
        current = stack[-1][1] if stack else 0

    current = block("html", "")
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while at < size:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk and in_head and chunk.strip():
            in_head = False
        if chunk and not in_head:
            if "&" in chunk:
                chunk = entities.unescape(chunk)
            parts.append(chunk)
            if links:
                out.own[current][1] += len(chunk.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "head":
                in_head = False
            if name in _VOID or not open_names[name]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in _INLINE:
                        end(k)
                    else:
                        for x in stack[k:]:
                            links -= x[0] == "a"
                            open_names[x[0]] -= 1
                        del stack[k:]
                    break
                if stack[k][0] not in _INLINE and name in _INLINE:
                    break  # an inline end tag doesn't end a block
            continue
        if name == "head":
            in_head = len(out.tag) == 1
            continue
        if in_head and name not in _IN_HEAD:
            in_head = False
        if name in _SKIPPED:
            if not m[3].endswith("/") or name in _RAW:
                close = None if name in unclosed else _CLOSE[name].search(page, at)
                if not close:
                    unclosed.add(name)  # nor has any later one an end
                if close:
                    stop = page.find(">", close.end())
                    at = size if stop < 0 else stop + 1
                elif name in _RAW:
                    at = size
            continue
        if name in _VOID:
            parts.append(" ")
            if name == "hr":
                flush()
            continue
        if name in _INLINE:
            if not m[3].endswith("/"):
                stack.append((name, current))
                open_names[name] += 1
                if name == "a":
                    links += 1
                    out.own[current][4] += 1
            continue
        if name in ("html", "body") and len(out.tag) > 1 and name == "html":
            continue
        ends = _ENDS.get(name, ())
        if open_names["p"] or any(open_names[x] for x in ends):
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph; items and cells end their like
                open_name = stack[k][0]
                if open_name == "p" or open_name in ends:
                    end(k)
                    break
                if open_name in _SCOPE:
                    break
        flush()
        if m[3].endswith("/"):
            continue
        current = block(name, m[3])
        stack.append((name, current))
        open_names[name] += 1
    flush()
    return out


FEATURES = [
    *(f"tag_{t}" for t in TAGS),
    *(f"own_{t}" for t in TOKENS),
    "own_hidden",
    *(f"in_{t}" for t in TOKENS),
    "in_hidden",
    *(f"within_{t}" for t in ("article", "main", "nav", "aside", "header", "footer", "form", "list", "table")),
    "chars",
    "own_chars",
    "link_share",
    "own_link_share",
    "marks",
    "words_a_run",
    "density",
    "blocks",
    "depth",
    "place",
    "siblings",
    "place_share",
    "share_of_parent",
    "share_of_page",
    "siblings_like_it",
    "links",
    "place_on_page",
]


def node_features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """One row for each block of all pages, and offsets by page."""
    counts = np.array([len(p.tag) for p in pages])
    offsets = np.concatenate([[0], np.cumsum(counts)])
    page = np.repeat(np.arange(len(pages)), counts)
    tag = np.concatenate([p.tag for p in pages]).astype(np.int64)
    parent = np.concatenate([p.parent for p in pages]).astype(np.int64)
    root = parent < 0
    parent = np.where(root, np.arange(len(tag)), parent + offsets[page])
    depth = np.concatenate([p.depth for p in pages]).astype(np.int64)
    bits = np.concatenate([p.bits for p in pages]).astype(np.int64)
    place = np.concatenate([p.place for p in pages]).astype(np.float32)
    own = np.concatenate([p.own for p in pages]).astype(np.float64)
    total = np.column_stack([own, np.ones(len(tag)), own[:, 0] > 0])
    enclosing, within = np.zeros(len(tag), np.int64), np.zeros(len(tag), np.int64)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1])
    for at in levels[:0:-1]:
        np.add.at(total, parent[at], total[at])
    for at in levels[1:]:
        enclosing[at] = enclosing[parent[at]] | bits[parent[at]]
        within[at] = within[parent[at]] | (1 << tag[parent[at]])
    siblings = np.bincount(parent[~root], minlength=len(tag)).astype(np.float32)[parent]
    siblings[root] = 1
    like = np.unique(parent * len(TAGS) + tag, return_inverse=True, return_counts=True)
    chars, whole = total[:, 0], total[offsets[:-1], 0][page]
    log = np.log1p
    x = [tag == i for i in range(len(TAGS))]
    x += [(bits >> i) & 1 for i in range(len(TOKENS) + 1)]
    x += [(enclosing >> i) & 1 for i in range(len(TOKENS) + 1)]
    x += [(within >> TAGS.index(t)) & 1 for t in ("article", "main", "nav", "aside", "header", "footer", "form", "list", "table")]
    before = np.cumsum(own[:, 0]) - own[:, 0]
    x += [
        log(chars),
        log(own[:, 0]),
        total[:, 1] / np.maximum(1, chars),
        own[:, 1] / np.maximum(1, own[:, 0]),
        100 * total[:, 3] / np.maximum(1, chars),
        log(total[:, 2] / np.maximum(1, total[:, 6])),
        log(chars / total[:, 5]),
        log(total[:, 5]),
        depth,
        place,
        siblings,
        place / np.maximum(1, siblings),
        chars / np.maximum(1, chars[parent]),
        chars / np.maximum(1, whole),
        like[2][like[1]],
        log(total[:, 4]),
        (before - before[offsets[:-1]][page]) / np.maximum(1, whole),
    ]
    return np.column_stack(x).astype(np.float32), offsets


@dataclass
class Trees:
    """Trees of one depth: for each inner node a feature and a cutoff, for each leaf a value."""

    base: float
    feature: np.ndarray
    cutoff: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        levels = int(np.log2(self.value.shape[1]))
        for f, c, v in zip(self.feature, self.cutoff, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(levels):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (len(v) - 1)]
        return out


def _sums_by_node(node: np.ndarray, n: int, g: np.ndarray, h: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For features of two values: the sums of g and h over each node's rows of the smaller value, as [feature, node]."""
    rows, spread = np.arange(len(node)), np.zeros((len(node), 2 * n), np.float32)
    spread[rows, node], spread[rows, n + node] = g, h
    both = (flags @ spread).astype(np.float64)
    return both[:, :n], both[:, n:]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 24, smooth: float = 2.0) -> Trees:
    """Newton boosting of the log loss; splits are sought among quantiles."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        values = values if len(values) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[:-1], method="lower"))
        cuts.append(values[values < x[:, j].max()] if len(values) > 1 else values)
    coded = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    share = float((weight * y).sum() / weight.sum())
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    inner, width = 2**depth - 1, bins + 2
    two = np.array([j for j, c in enumerate(cuts) if len(c) == 1], np.int64)
    several = [j for j, c in enumerate(cuts) if len(c) > 1]
    flags = np.array([coded[j] == 0 for j in two], np.float32).reshape(len(two), len(y))
    features, cutoffs, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            node = at - first
            all_g, all_h = np.bincount(node, weights=g, minlength=n), np.bincount(node, weights=h, minlength=n)
            best = np.full(n, 1e-6)

            def consider(j: int, left_g: np.ndarray, left_h: np.ndarray, best=best, first=first, n=n, all_g=all_g, all_h=all_h, f=f, c=c) -> None:
                """Takes feature j where one of its cuts, by the sums left of them as [node, cut], gains most so far."""
                gain = left_g**2 / (left_h + smooth) + (all_g[:, None] - left_g) ** 2 / (all_h[:, None] - left_h + smooth) - (all_g**2 / (all_h + smooth))[:, None]
                top = gain.argmax(axis=1)
                better = gain[np.arange(n), top] > best
                best[better] = gain[np.arange(n), top][better]
                f[first : first + n][better] = j
                c[first : first + n][better] = cuts[j][top[better]]

            sums_g, sums_h = _sums_by_node(node, n, g, h, flags)
            for k, j in enumerate(two):
                consider(j, sums_g[k][:, None], sums_h[k][:, None])
            base_key = node * width
            for j in several:
                key = base_key + coded[j]
                sg = np.bincount(key, weights=g, minlength=n * width).reshape(n, width).cumsum(axis=1)
                sh = np.bincount(key, weights=h, minlength=n * width).reshape(n, width).cumsum(axis=1)
                consider(j, sg[:, : len(cuts[j])], sh[:, : len(cuts[j])])
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        leaf = at - inner
        v = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + smooth)
        score += v[leaf]
        features.append(f)
        cutoffs.append(c)
        values.append(v)
    return Trees(base, np.array(features), np.array(cutoffs), np.array(values))


class _Maker:
    """Pages whose blocks are known, for training: every layout, name and slip is drawn at random."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = "ta ri no se lo mi ka du en ar ul to pe va shi gre mon tel bra co ne fi od il".split()
        self.words = ["".join(self.r.choices(syllables, k=self.r.randrange(1, 5))) for _ in range(600)]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def pick(self, *options: str) -> str:
        return options[self.r.randrange(len(options))]

    def name(self, group: str) -> str:
        """An attribute that names the block's kind, or nothing that tells it."""
        u = self.r.random()
        if u < 0.3:
            return f' class="{self.pick(*self.words)}"' if self.chance(0.5) else ""
        word = self.pick(*TOKENS[group].split())
        word = word if self.chance(0.6) else f"{self.pick('site', 'page', 'x', 'block', 'main')}-{word}" if group != "text" else f"{word}-{self.pick('wrap', 'inner', 'area')}"
        return f' {self.pick("class", "class", "id")}="{word}"'

    def words_of(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randrange(lo, hi)))

    def prose(self, lo: int = 1, hi: int = 7) -> str:
        return " ".join(self.words_of(2, 22).capitalize() + self.pick(".", ".", ".", "?", "!", ", " + self.words_of(1, 5) + ".") for _ in range(self.r.randrange(lo, hi)))

    def paragraph(self, truth: int, lo: int = 1, hi: int = 7) -> str:
        text = self.prose(lo, hi)
        if self.chance(0.25):
            text = self.pick("<b>", "<em>", "<b>") + text + self.pick("</b>", "</em>", "<br>")
        if self.chance(0.2):
            text += f' <a href="/x">{self.words_of(1, 4)}</a>.'
        if self.chance(0.05):
            text += self.pick(" <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.", " <button>save</button> it.", " <object>" + self.words_of(1, 6) + "</object>")
        return f'<p data-truth="{truth}">{text}' + ("</p>" if self.chance(0.85) else "")

    def linked_list(self) -> str:
        """Links that are part of the article: works cited, parts of a series."""
        tag = self.pick("ul", "ol")
        items = "".join(f'<li><a href="/{i}">{self.words_of(1, 9)}</a>{self.pick("", "", ", " + self.words_of(1, 6), ".")}' + self.pick("</li>", "</li>", "") for i in range(self.r.randrange(2, 8)))
        return f'<{tag} data-truth="1">{items}</{tag}>'

    def links(self, group: str, tag: str, truth: int = 0) -> str:
        marked = self.chance(0.4)  # labels may end like sentences
        items = "".join(f'<li><a href="/{i}">{self.words_of(1, 4)}{self.pick(".", ",", "") if marked else ""}</a></li>' for i in range(self.r.randrange(1, 10)))
        inner = f"<ul>{items}</ul>" if self.chance(0.7) else items.replace("<li>", "<div>").replace("</li>", "</div>")
        return f'<{tag}{self.name(group)} data-truth="{truth}">{inner}</{tag}>'

    def extra(self, group: str) -> str:
        tag = self.pick("div", "section", {"head": "header", "foot": "footer", "side": "aside", "form": "form", "menu": "nav"}.get(group, "div"))
        if group in ("menu", "share") or group == "side" and self.chance(0.5):
            return self.links(group, tag)
        if group == "comment":
            inner = "".join(f'<div{self.name("comment")}><p>{self.prose(1, 4)}</p><span>{self.words_of(1, 3)}</span></div>' for _ in range(self.r.randrange(1, 6)))
            return f'<{tag} {self.pick("class", "id")}="{self.pick(*TOKENS["comment"].split())}" data-truth="0"><h3>{self.words_of(1, 3)}</h3>{inner}</{tag}>'
        if group == "form":
            return f'<{tag}{self.name("form")} data-truth="0"><label>{self.words_of(1, 4)}</label><input name="q"><p>{self.words_of(2, 9)}</p></{tag}>'
        if group == "foot":
            return f'<{tag}{self.name("foot")} data-truth="0">{self.pick("&copy; ", "")}{self.words_of(2, 14)}.{self.pick("", f" {self.prose(1, 8)}", f"<p>{self.prose(1, 8)}</p>")}</{tag}>'
        if group == "head":
            return f'<{tag}{self.name("head")} data-truth="0"><a href="/">{self.words_of(1, 3)}</a>{self.pick("", f"<h1>{self.words_of(1, 4)}</h1>", f"<p>{self.words_of(3, 9)}</p>")}</{tag}>'
        if group == "side":
            return f'<{tag}{self.name("side")} data-truth="0"><h3>{self.words_of(1, 4)}</h3><p>{self.prose(1, 5)}</p></{tag}>'
        return f'<{tag}{self.name(group)} data-truth="0">{self.pick("", "<p>")}{self.prose(1, 5)}</{tag}>'

    def article(self) -> str:
        parts = []
        if self.chance(0.8):
            title = f'<{(h := self.pick("h1", "h1", "h2"))} data-truth="1">{self.words_of(1, 12)}</{h}>'
            parts.append(title if self.chance(0.9) else f'<header data-truth="1">{title}</header>')
        if self.chance(0.15):
            parts.append(f'<div class="{self.pick("byline", "meta", "author", "share")}" data-truth="0">{self.words_of(2, 6)}</div>')
        brief = self.chance(0.2)
        if brief:
            parts.append(f'<p data-truth="1">{self.words_of(1, 9).capitalize()}{self.pick(".", "")}' + self.pick("</p>", ""))
        short = self.chance(0.25)
        for _ in range(0 if brief and self.chance(0.6) else self.r.randrange(1, 4 if short else 14)):
            u = self.r.random() * (0.72 if short and self.chance(0.7) else 1.0)
            if u < 0.2:
                parts.append(f'<p data-truth="1">{self.words_of(1, 13).capitalize()}{self.pick(".", ".", "")}' + self.pick("</p>", "</p>", ""))
            elif u < 0.72:
                parts.append(self.paragraph(1, 1, 9))
            elif u < 0.78:
                parts.append(f'<{(h := self.pick("h2", "h3"))} data-truth="1">{self.words_of(1, 8)}</{h}>')
            elif u < 0.805:
                parts.append(self.linked_list())
            elif u < 0.83:
                parts.append(f'<ul data-truth="1">{"".join(f"<li>{self.prose(1, 3)}" + self.pick("</li>", "") for _ in range(self.r.randrange(2, 6)))}</ul>')
            elif u < 0.87:
                parts.append(f'<blockquote data-truth="1"><p>{self.prose(1, 4)}</p></blockquote>')
            elif u < 0.90:
                parts.append(f'<pre data-truth="1">{self.words_of(4, 40)}</pre>')
            elif u < 0.93:
                parts.append('<table data-truth="1">' + "".join("<tr>" + "".join(f"<td>{self.words_of(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randrange(2, 5))) + "</table>")
            elif u < 0.96:
                parts.append(f'<div data-truth="1">{self.prose(1, 6)}</div>')
            elif u < 0.98:
                parts.append(self.extra("ad"))
            else:
                parts.append(self.extra(self.pick("share", "side", "notice", "form")))
        return "".join(parts)

    def page(self) -> str:
        if self.chance(0.06):
            return "".join(self.paragraph(1) for _ in range(self.r.randrange(1, 5)))
        if self.chance(0.16):  # hardly anything but the article
            tag = self.pick("article", "article", "main", "div", "section", "body")
            opening = "<!DOCTYPE html><html><head><title>x</title></head>" if self.chance(0.5) else ""
            title = f'<{(h := self.pick("h1", "h1", "h2"))} data-truth="1">{self.words_of(1, 7).capitalize()}</{h}>' if self.chance(0.6) else ""
            one = title + "".join(self.paragraph(1, 1, 5) for _ in range(self.r.randrange(1, 3))) if self.chance(0.6) else self.article()
            frame = "".join(self.extra(k) for k in ("menu", "head", "ad") if self.chance(0.25))
            last = self.extra("foot") if self.chance(0.4) else ""
            return f'{opening}{frame}<{tag}{self.name("text") if self.chance(0.3) else ""} data-truth="1">{one}</{tag}>{last}'
        tag = self.pick("article", "article", "main", "div", "div", "section", "td")
        body = f'<{tag}{self.name("text")} data-truth="1">{self.article()}' + (f"</{tag}>" if self.chance(0.95) else "")
        if tag == "td":
            body = f"<table><tr>{self.links('menu', 'td')}{body}</tr></table>"
        for _ in range(self.r.randrange(0, 3)):
            body = f'<div{self.name("text") if self.chance(0.3) else ""}>{body}</div>'
        before = "".join(self.extra(g) for g, p in (("notice", 0.25), ("head", 0.6), ("menu", 0.75), ("ad", 0.45), ("form", 0.15), ("side", 0.2)) if self.chance(p))
        after = "".join(self.extra(g) for g, p in (("share", 0.25), ("ad", 0.3), ("comment", 0.35), ("side", 0.45), ("form", 0.2), ("menu", 0.15), ("foot", 0.85)) if self.chance(p))
        page = f"<!DOCTYPE html><html><head><title>{self.words_of(1, 8)}</title></head><body>{before}{body}{after}"
        return page + ("</body></html>" if self.chance(0.9) else "")


@lru_cache(maxsize=4)
def fit(pages: int = MADE_PAGES, seed: int = 11) -> Trees:
    """Trees from so many made pages. A block counts as text if most of the characters in it are."""
    maker = _Maker(seed)
    parsed = [parse(maker.page(), truth_marks=True) for _ in range(pages)]
    x, offsets = node_features(parsed)
    y, weight = [], []
    for p in parsed:
        chars = np.array([o[0] for o in p.own], float)
        mine = chars * (np.array(p.truth) == 1)
        for i in range(len(chars) - 1, 0, -1):
            chars[p.parent[i]] += chars[i]
            mine[p.parent[i]] += mine[i]
        y += (mine > 0.5 * chars).tolist()
        weight += np.where(chars > 0, 1.0 + np.log1p(chars) / 4, 0.0).tolist()
    return boost(x, np.array(y, float), np.array(weight))


#: What it costs to judge a block's children one by one: much in a list or menu, little in a container, nothing at the top.
PRICE = np.array([{"article": 2.0, "main": 2.0, "section": 2.0, "div": 2.0, "table": 2.0, "cell": 1.0, "other": 0.0}.get(t, 5.0) for t in TAGS])


def decode(page: Page, score: np.ndarray, price: np.ndarray = PRICE) -> np.ndarray:
    """Which blocks' own text is main text. A block is text with all below it, or not text with all below it, or mixed:
    then its own text is judged by itself and each block below is free, at a price."""
    n = len(page.tag)
    chars = np.array([o[0] for o in page.own], float)
    s = np.clip(score, -8, 8) * np.where(chars > 0, 1 + np.log1p(chars) / 3, 0.3)
    s = s.tolist()
    has_child = [False] * n
    whole, mixed = list(s), [abs(v) - c for v, c in zip(s, price[page.tag].tolist(), strict=True)]
    best, kind = [0.0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if has_child[i] and mixed[i] > abs(whole[i]):
            best[i], kind[i] = mixed[i], 2
        else:
            best[i], kind[i] = abs(whole[i]), int(whole[i] > 0)
        if i:
            p = page.parent[i]
            has_child[p] = True
            whole[p] += whole[i]
            mixed[p] += best[i]
    out, state = np.zeros(n, bool), [2] * n
    for i in range(n):
        above = state[page.parent[i]] if i else 2
        state[i] = kind[i] if above == 2 else above
        out[i] = s[i] > 0 if state[i] == 2 else state[i] == 1
    return out


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    x, offsets = node_features(parsed)
    score = trees(x)
    out = []
    for k, p in enumerate(parsed):
        keep = decode(p, score[offsets[k] : offsets[k + 1]]) if p.runs else ()
        out.append("\n".join(text for at, text in p.runs if keep[at]))
    return out


def extract(pages: DataFrame, html: str = "html", made_pages: int = MADE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    trees = fit(made_pages)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[str] = []
        column = [x or "" for x in batch.column(html).to_pylist()]
        for at in range(0, len(column), 200):
            found += main_texts(column[at : at + 200], trees)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(pages.select("page_id", "url", html), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
