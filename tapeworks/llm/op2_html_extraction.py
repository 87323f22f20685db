"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of its block elements; every run of text between block borders is a leaf. Each node has a
hidden label, content or not. Features of a node give its own potential, and each parent and child share a
potential for their pair of labels that depends on the kind of child. Sum-product messages go up the tree and down
again, level by level for many pages at once, and the leaves' content marginals decide.

The weights maximise the likelihood of labelled pages: pages of the table whose markup says what the article is (an
``article`` or ``main`` element; a bounded sample, ``max_pages`` of fewer than ``max_chars`` characters), and pages
built from layouts that lack such markup or mix adverts, forms, notices and comments into the article
(``labelled_layouts``).

Defined results: null and empty html give an empty text; broken markup is repaired as browsers do for the common cases
(open paragraphs, list items and cells are closed by the next one, unknown end tags are ignored, unknown ``<![``
sections are comments up to ``>``, ``head`` needs no end tag); an element without text of its own, as ``svg`` or
``noscript``, hides what stands before its end tag, or without an end tag what stands before the next block or the end
of an element around it (``script`` and ``style`` without an end tag hide the rest, as in browsers); a page of any
length is one tree; rows are kept one to one and extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.llm.docstats import sample_by_hash
from tapeworks.llm.shared import table
from tapeworks.llm.words import batch_of, slices
from tapeworks.session import staged

# Element names of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
SILENT = frozenset("script style template noscript title iframe object svg math select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end a silent element without an end tag; svg and math end at those of text too.
BREAKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table tbody td th thead tr ul".split()
)
FOREIGN_BREAKS = frozenset("b big br code em embed i img nobr ruby s small span strike strong sub sup tt u var".split())
#: What an opening tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id and role that hint at the use of an element.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "head": "header masthead topbar top logo branding brand hero",
    "foot": "footer foot copyright bottom legal contentinfo colophon",
    "side": "sidebar aside side widget related recommended recommendations trending popular teaser rail complementary more",
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription paywall"
    " toast message warning",
    "talk": "comment comments commentlist reply replies disqus respond discussion thread feedback",
    "share": "share sharing social follow tweet like print tags tag meta byline",
    "form": "form search login signup signin register contact input poll",
    "body": "article content main post entry story articlebody text prose page body maincontent blog",
}
_NAMED = r"<(?P<end>/?)(?P<tag>%s)(?=[\s/>])[^<>]*"
_SILENT = re.compile("<!--|" + _NAMED % "|".join(sorted(SILENT)), re.I | re.A)
#: Silent elements whose content is no markup: they end at the first end tag. The others nest.
_RAW = {t: re.compile(_NAMED % t, re.I | re.A) for t in "script style title textarea iframe noscript".split()}
_CLOSED = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*", re.I | re.A) for t in ("script", "style")}
#: The sections that the library's parser knows; it raises an error on others.
_SECTION = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.I | re.A)
#: Character numbers that int() refuses.
_LONG_NUMBER = re.compile(r"&#([0-9]{4000,})", re.A)
_COMMENT_END = re.compile(r"--\s*>")
_HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
_WORD = re.compile(r"[a-z]+")
KINDS = ["leaf", "heading", "p", "li", "list", "div", "section", "frame", "form", "other"]


def _kind(tag: str) -> str:
    if tag in HEADINGS:
        return "heading"
    if tag in ("nav", "header", "footer", "aside", "dialog", "menu"):
        return "frame"
    if tag in ("form", "fieldset", "button", "legend"):
        return "form"
    if tag in ("ul", "ol", "dl", "table", "tbody", "tr"):
        return "list"
    if tag in ("li", "dt", "dd", "td", "th"):
        return "li"
    if tag in ("article", "section", "main", "body", "html"):
        return "section"
    return tag if tag in ("p", "div") else "other"


def silent_ends(html: str) -> dict[int, int]:
    """Where the silent elements that have an end tag begin, and where what follows them begins."""
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    endless: set[str] = set()
    i = 0
    while found := _SILENT.search(html, i):
        start, i = found.start(), found.end()
        tag = (found["tag"] or "--").lower()
        empty = found[0].endswith("/") and html.startswith(">", i)
        if found["end"]:
            if waiting.get(tag):
                ends[waiting[tag].pop()] = i + html.startswith(">", i)
        elif tag == "--" or tag in _RAW:
            if tag in endless:
                continue
            pattern = _COMMENT_END if tag == "--" else _RAW[tag] if empty or tag not in _CLOSED else _CLOSED[tag]
            close = pattern.search(html, i)
            if close is None:
                endless.add(tag)
            elif tag == "--":
                i = close.end()
            elif pattern is not _RAW[tag] or close["end"]:  # a second start tag comes first: no end tag of its own
                i = close.end()
                ends[start] = i + html.startswith(">", i)
        elif not (empty and tag in ("svg", "math")):
            waiting.setdefault(tag, []).append(start)
    return ends


class Tree(HTMLParser):
    """Nodes of one page in page order: parents, tags, hints, and the text of leaves."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.hints, self.marks = [-1], ["html"], [()], [""]
        self.text: list[str | None] = [None]
        self.links: list[int] = [0]
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # of the open elements of each name, where they stand in ``open``
        self.silent: list[str] = []  # the silent element and, where it has no end tag, what is open inside
        self.ends: dict[int, int] = {}
        self.at = self.passed = self.skip = 0
        self.anchors = 0
        self.run: list[str] = []
        self.run_links = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self._node("leaf", (), "", text)
                self.links[-1] = min(self.run_links, len(text))
            self.run, self.run_links = [], 0

    def _node(self, tag: str, hints: tuple, mark: str, text: str | None = None) -> None:
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.hints.append(hints)
        self.marks.append(mark)
        self.text.append(text)
        self.links.append(0)

    def _last(self, names: set[str]) -> int:
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def _close(self, names: set[str], stops: set[str]) -> None:
        """Close the innermost open element of ``names`` and what is open inside it, unless one of ``stops`` is."""
        at = self._last(names)
        if at and at >= self._last(stops):
            for node in reversed(self.open[at:]):
                self.places[self.tag[node]].pop()
            del self.open[at:]

    def feed(self, data: str) -> None:
        """Takes a whole page: silent elements with an end tag are passed over in one step."""
        self.ends = silent_ends(data)
        super().feed(data)
        self.passed = len(data) - len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        self.at, self.skip = self.passed + i, 0
        k = super().parse_starttag(i)
        return self.skip - self.passed if self.skip else k

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i) and not _SECTION.match(self.rawdata, i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def set_cdata_mode(self, elem: str) -> None:
        if not self.skip:
            super().set_cdata_mode(elem)

    def handle_starttag(self, tag: str, attrs: list, empty: bool = False) -> None:
        empty = empty and (tag in ("svg", "math") or self.at not in self.ends)
        if self.silent and (tag in BREAKS or tag in FOREIGN_BREAKS and self.silent[0] in ("svg", "math")):
            self.silent = []
        if tag in SILENT and not empty:
            self.skip = self.ends.get(self.at, 0)
        if self.silent:
            if not (empty or self.skip or tag in VOID):
                self.silent.append(tag)
            return
        if tag == "head":
            return
        if tag in SILENT:
            if tag != "title":
                self.run.append(" ")
            if not (empty or self.skip):
                self.silent.append(tag)
            return
        if tag == "br":
            self.run.append(" ")
        if tag in INLINE:
            self.anchors += tag == "a"
            return
        self.flush()
        if tag in VOID:
            return
        self.anchors = 0
        self._close({"p"}, {"td", "th", "button", "table"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        known = dict(attrs)
        words = _WORD.findall(" ".join(str(known.get(k) or "") for k in ("class", "id", "role")).lower())
        hints = tuple(sorted({_HINT_OF[w] for w in words if w in _HINT_OF}))
        self._node(tag, hints, known.get("data-label") or "")
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, empty=True)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.silent) - 1, -1, -1):
            if self.silent[i] == tag:
                del self.silent[i:]
                return
        self.silent = []
        if tag == "head":
            return
        if tag in INLINE:
            self.anchors = max(0, self.anchors - (tag == "a"))
            return
        self.flush()
        self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)
            if self.anchors:
                self.run_links += len(data.strip())

    def close(self) -> None:
        super().close()
        self.flush()


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html))
    tree.close()
    return tree


# --- features

TAGS = (
    "html body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead"
    " tr td th form fieldset button legend figure figcaption blockquote pre address details summary dialog center"
).split()
_SIZES, _SHARES = [0, 2, 5, 15, 40, 120], [0.0, 0.3, 0.7]
NAMES = (
    ["leaf", "element", "other tag", "closes sentence", "has comma", "copyright", "one link", "first heading"]
    + [f"tag {t}" for t in TAGS] + [f"hint {k}" for k in HINTS]
    + [f"leaf size {i}" for i in range(len(_SIZES) + 1)] + [f"leaf links {i}" for i in range(len(_SHARES) + 1)]
    + [f"size {i}" for i in range(len(_SIZES) + 1)] + [f"links {i}" for i in range(len(_SHARES) + 1)]
    + [f"depth {i}" for i in range(6)]
)
_AT = {name: i for i, name in enumerate(NAMES)}


@dataclass
class Forest:
    """Trees of several pages as arrays; parents stand before their children."""

    parent: np.ndarray
    page: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    features: np.ndarray  # flat indices of active features
    offsets: np.ndarray
    leaves: np.ndarray
    texts: list[str]


def forest(trees: list[Tree]) -> Forest:
    parent, page, depth, kind, flat, counts, leaves, texts = [], [], [], [], [], [], [], []
    for number, tree in enumerate(trees):
        base, n = len(parent), len(tree.tag)
        words = np.array([len(t.split()) if t else 0 for t in tree.text])
        chars = np.array([len(t) if t else 0 for t in tree.text])
        links = np.array(tree.links)
        for i in range(n - 1, 0, -1):
            up = tree.parent[i]
            words[up] += words[i]
            chars[up] += chars[i]
            links[up] += links[i]
        sizes = np.searchsorted(_SIZES, words, "left")
        shares = np.searchsorted(_SHARES, links / np.maximum(chars, 1), "left")
        levels, headed = [0] * n, False
        for i in range(n):
            tag, up = tree.tag[i], tree.parent[i]
            levels[i] = 0 if up < 0 else levels[up] + 1
            if tag == "leaf":
                text = tree.text[i]
                own = [_AT["leaf"], _AT[f"leaf size {sizes[i]}"], _AT[f"leaf links {shares[i]}"]]
                if text[-1] in ".!?:;…”\"":
                    own.append(_AT["closes sentence"])
                if "," in text:
                    own.append(_AT["has comma"])
                if text[0] == "©" or text[:9].lower() == "copyright":
                    own.append(_AT["copyright"])
                leaves.append(base + i)
                texts.append(text)
            else:
                own = [_AT["element"], _AT[f"size {sizes[i]}"], _AT[f"links {shares[i]}"], _AT[f"depth {min(levels[i], 5)}"]]
                own.append(_AT.get(f"tag {tag}", _AT["other tag"]))
                own += [_AT[f"hint {h}"] for h in tree.hints[i]]
                if tag == "h1" and not headed:
                    own.append(_AT["first heading"])
                    headed = True
            flat += own
            counts.append(len(own))
            kind.append(KINDS.index("leaf" if tag == "leaf" else _kind(tag)))
            parent.append(base + up if up >= 0 else -1)
            page.append(number)
        depth += levels
    depth = np.array(depth, np.int64)
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else [0]
    levels = [order[a:b] for a, b in zip(edges, edges[1:])]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return Forest(
        np.array(parent, np.int64), np.array(page, np.int64), levels, np.array(kind, np.int64),
        np.array(flat, np.int64), offsets, np.array(leaves, np.int64), texts,
    )


# --- the model


@dataclass
class Model:
    unary: np.ndarray  # weight of each feature for the label content
    pair: np.ndarray  # (kind of child, label of parent, label of child)

    def beliefs(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content for each node, and of the label pairs of each node and its parent."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        if n:
            own[:, 1] = np.add.reduceat(self.unary[f.features], f.offsets[:-1])
        pair = self.pair[f.kind]
        up, message = own.copy(), np.zeros((n, 2))
        for level in f.levels[:0:-1]:  # from the leaves to the roots
            joint = pair[level] + up[level][:, None, :]
            message[level] = np.logaddexp(joint[..., 0], joint[..., 1])
            np.add.at(up, f.parent[level], message[level])
        down = np.zeros((n, 2))  # what a node hears from its parent
        both = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            above = f.parent[level]
            rest = (up + down)[above] - message[level] if len(level) * 8 > n else up[above] + down[above] - message[level]
            joint = pair[level] + rest[:, :, None]
            down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[level] = joint + up[level][:, None, :]
        total = up + down
        marginal = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
        both -= both.max(axis=(1, 2), keepdims=True)
        both = np.exp(both)
        both /= both.sum(axis=(1, 2), keepdims=True)
        return marginal, both


def fit_model(f: Forest, labels: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 0.0001) -> Model:
    """Maximum likelihood with an exact gradient: observed counts minus expected ones."""
    model = Model(np.zeros(len(NAMES)), np.zeros((len(KINDS), 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros_like(model.pair)
    np.add.at(seen, (f.kind[child], labels[f.parent[child]], labels[child]), 1.0)
    widths, n = np.diff(f.offsets), len(labels)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (model.unary, model.pair)]
    for step in range(1, steps + 1):
        marginal, both = model.beliefs(f)
        wanted = np.bincount(f.features, np.repeat(labels - marginal, widths), len(NAMES)) / n
        expected = np.zeros_like(model.pair)
        np.add.at(expected, f.kind[child], both[child])
        slopes = [wanted - penalty * model.unary, (seen - expected) / n - penalty * model.pair]
        for k, (w, g) in enumerate(zip((model.unary, model.pair), slopes, strict=True)):
            m, v = moments[k]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.99 * v + 0.01 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


# --- labelled pages


def _labels(tree: Tree) -> np.ndarray:
    """Labels of a page built with ``data-label`` marks, which hold for all that is inside."""
    labels = np.zeros(len(tree.tag), np.int64)
    for i in range(1, len(tree.tag)):
        mark = tree.marks[i]
        labels[i] = {"content": 1, "rest": 0}.get(mark, labels[tree.parent[i]])
    return labels


def _markup_labels(tree: Tree) -> np.ndarray | None:
    """Labels of a page whose only ``article`` (or ``main``) says what the content is, else None."""
    for root in ("article", "main"):
        if tree.tag.count(root) == 1:
            labels = np.zeros(len(tree.tag), np.int64)
            for i in range(1, len(tree.tag)):
                if tree.tag[i] == root:
                    labels[i] = 1
                    continue
                off = _kind(tree.tag[i]) in ("frame", "form") or set(tree.hints[i]) - {"body"}
                labels[i] = 0 if off else labels[tree.parent[i]]
            return labels
    return None


def labelled_layouts(n: int, seed: int = 3) -> list[str]:
    """Pages of several layouts with ``data-label`` marks on content and on what is not content inside it."""
    rng = random.Random(seed)
    parts = "an be con der el for in la men na or pa que ra sen ti un ver we zu".split()

    def word():
        return "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))

    def prose(low, high):
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize().rstrip(",") + rng.choice([".", ".", ".", ""])

    def link_list(count):
        items = "".join(f'<li><a href="/{word()}">{word()} {word() if rng.random() < 0.5 else ""}</a>' for _ in range(count))
        return f"<ul>{items}</ul>"

    def block(tag, name, inner, label="rest"):
        attr = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attr} data-label="{label}">{inner}</{tag}>'

    def extra():
        kind = rng.choice(["ad", "side", "notice", "talk", "share", "form"])
        name = rng.choice([w for w in HINTS[kind].split()])
        tag = {"side": rng.choice(["aside", "div"]), "form": "form"}.get(kind, rng.choice(["div", "section", "div"]))
        inner = {
            "ad": lambda: prose(4, 20), "side": lambda: f"<h3>{prose(1, 3)}</h3>" + link_list(rng.randint(2, 5)),
            "notice": lambda: f"<p>{prose(6, 25)}</p><button>{word()}</button>",
            "talk": lambda: "".join(f"<div><b>{word()}</b><p>{prose(3, 40)}</p></div>" for _ in range(rng.randint(1, 4))),
            "share": lambda: link_list(3), "form": lambda: f"<label>{word()}</label><input><p>{prose(2, 12)}</p>",
        }[kind]()
        plain = tag in ("aside", "form") and rng.random() < 0.4
        return block(tag, "" if plain else name, inner)

    def article_body():
        out, style = [], rng.random()
        # some articles have many lines of a few words, or one line again and again
        count, longest = (rng.randint(5, 40), rng.randint(2, 8)) if style < 0.25 else (rng.randint(1, 9), 70)
        again = prose(1, longest) if style < 0.08 else None
        for _ in range(count):
            r = rng.random() * (0.66 if style < 0.25 else 1)
            if r < 0.62:
                out.append(f"<p>{again or prose(1, longest)}" + rng.choice(["</p>", "</p>", ""]))
            elif r < 0.70:
                out.append(f"<h2>{prose(1, 6)}</h2>")
            elif r < 0.78:
                out.append("<ul>" + "".join(f"<li>{prose(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.84:
                out.append(f"<blockquote><p>{prose(5, 30)}</p></blockquote>")
            elif r < 0.90:
                out.append(f'<p><a href="/{word()}">{prose(1, 4)}</a> {prose(5, 30)}</p>')
            elif r < 0.94:
                out.append(f"<p><b>{prose(3, 30)}<br>")
            else:
                out.append(extra())
        return "".join(out)

    def page():
        title, semantic = prose(1, 9), rng.random() < 0.5
        inner_head = f"<h1>{title}</h1>"
        if rng.random() < 0.2:
            inner_head = f"<header>{inner_head}</header>"
        content = inner_head + article_body()
        if semantic:
            tag = rng.choice(["article", "article", "main", "article"])
            content = block(tag, rng.choice(["", "", "post", "content"]), content, "content")
        else:
            name = rng.choice(["content", "post", "entry-content", "article-body", "main", "story", "page-body", "text"])
            content = block("div", name, content, "content")
        if rng.random() < 0.3:
            content = f"<div>{content}</div>"
        links, foot = link_list(rng.randint(2, 8)), f"&copy; {word()}.example &middot; {prose(3, 14)}"
        top = [block("nav", "", links) if semantic else block("div", rng.choice(HINTS["nav"].split()), links)]
        if rng.random() < 0.5:
            site = f"<p>{prose(1, 6)}</p>" + (link_list(2) if rng.random() < 0.5 else "")
            top.insert(0, block("header", "", site) if semantic else block("div", rng.choice(["header", "masthead"]), site))
        ads = block("div", rng.choice(HINTS["ad"].split()), prose(4, 25))
        side = f"<h3>{prose(1, 3)}</h3>" + link_list(4) + f"<p>{prose(3, 30)}</p>"
        side = block("aside", "", side) if semantic else block("div", rng.choice(["sidebar", "widget", "related"]), side)
        end = [block("footer", "", foot) if semantic else block("div", "footer", foot)]
        around = [ads] * (rng.random() < 0.5) + [side] * (rng.random() < 0.5) + [extra()] * (rng.random() < 0.5)
        rng.shuffle(around)
        cut = rng.randint(0, len(around))
        body = [*top, *around[:cut], content, *around[cut:], *end]
        closing = "</body></html>" if rng.random() < 0.8 else ""
        return f"<html><head><title>{title}</title></head><body>{''.join(body)}{closing}"

    return [page() for _ in range(n)]


def _is_telling(html: str) -> Column:
    """Whether ``_markup_labels`` finds labels: one ``article`` or one ``main`` outside comments and silent elements."""
    hidden = rf"(?is)<!--.*?--\s*>|<({'|'.join(sorted(SILENT))})(?=[\s/>])[^<>]*(?<!/)>.*?</\1(?=[\s/>])"
    bare = F.regexp_replace(html, hidden, " ")
    one = [F.regexp_count(bare, F.lit(rf"(?i)<{tag}(?=[\s/>])")) == 1 for tag in ("article", "main")]
    return one[0] | one[1]


def fit_extractor(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", max_pages: int = 300, layouts: int = 450,
    max_chars: int = 50_000,
) -> Model:
    """Fit on built layouts and on at most ``max_pages`` pages with telling markup, those with the smallest id hashes.

    Only pages of fewer than ``max_chars`` characters are taken, which bounds what the driver fetches; equal
    pages of one id count once.
    """
    short = pages.where(F.length(html) < max_chars)
    names = [F.col(page_id).alias("_id"), F.xxhash64(html).alias("_key")]
    telling = staged(short.where(_is_telling(html)).select(*names), "telling-pages")
    chosen = sample_by_hash(telling, ["_id", "_key"], max_pages)
    found = short.select(*names, F.col(html).alias("_html")).join(F.broadcast(chosen), ["_id", "_key"])
    sample = found.select("_id", "_html").dropDuplicates(["_id", "_html"]).orderBy("_id", "_html")
    trees = [parse(page) for page in labelled_layouts(layouts)]
    labels = [_labels(tree) for tree in trees]
    for row in sample.collect():
        tree = parse(row[1])
        own = _markup_labels(tree)
        if own is not None:
            trees.append(tree)
            labels.append(own)
    return fit_model(forest(trees), np.concatenate(labels))


def page_texts(model: Model, htmls: list[str | None]) -> list[str]:
    """Main texts: the leaves that are content more likely than not, in page order."""
    f = forest([parse(html or "") for html in htmls])
    marginal, _ = model.beliefs(f)
    texts: list[list[str]] = [[] for _ in htmls]
    for leaf, text, p in zip(f.leaves, f.texts, marginal[f.leaves], strict=True):
        if p >= 0.5:
            texts[f.page[leaf]].append(text)
    return ["\n".join(blocks) for blocks in texts]


def extract_texts(pages: DataFrame, model: Model, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` and the main ``text`` of every row."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = page_texts(model, part.column(html).to_pylist())
                columns = [part.column(c) for c in keep] + [pa.array(texts, pa.string())]
                yield batch_of(columns, schema)

    out = StructType([*[pages.schema[c] for c in keep], StructField("text", StringType())])
    schema = to_arrow_schema(out)
    return pages.select(*keep, *([] if html in keep else [html])).mapInArrow(run, out)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = extract_texts(pages, fit_extractor(pages), ["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))
