"""Main text of web pages by a tree-structured graphical model.

A page's markup is read into a tree.  Every element has a hidden label, content or not; its
features give a node potential, and every parent-child pair has a potential that depends on the
two labels and on the child's kind.  Sum-product messages passed from the leaves to the root and
back give the exact marginal of every node, and blocks of text whose marginal reaches a half are
the main text.  Both kinds of potentials are trained in numpy by maximum likelihood: the gradient
is the difference between the labelled and the expected statistics, from the same messages.

Training pages are generated by rule: pages of many layouts whose every block is labelled by the
part of the page that it was made for.  Text is decoded, white space within a block becomes one
space, and blocks are joined in page order by line feeds.

Defined results: null, empty and textless pages give an empty text; a page without markup is one
block of content; unclosed and stray tags are repaired as browsers do; very long pages are read
whole; equal pages give equal texts; repeated rows stay; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import free, table

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg annotation head title iframe object select option textarea button canvas audio video".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BLOCK = frozenset(
    "html body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th "
    "form fieldset figure figcaption blockquote pre address details summary hr center".split()
)
#: Silent elements that end before the next block where the page has no end tag for them.
MEDIA = frozenset("audio video canvas object".split())
#: Open elements that a start tag of another name closes; what may stand in a head.
_CLOSED_BY = {"option": frozenset(("option", "optgroup", "hr", "select"))}
_HEAD = frozenset("head title base basefont link meta script style noscript template".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot".split())
KINDS = "root main article section aside nav header footer div p heading list item table cell form quote other".split()
_KIND_OF = {
    **{k: k for k in KINDS},
    **{f"h{i}": "heading" for i in range(1, 7)},
    **dict.fromkeys(("ul", "ol", "dl"), "list"),
    **dict.fromkeys(("li", "dt", "dd"), "item"),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr"), "table"),
    **dict.fromkeys(("td", "th"), "cell"),
    **dict.fromkeys(("form", "fieldset"), "form"),
    **dict.fromkeys(("blockquote", "pre"), "quote"),
}
#: Hints in class, id and role of elements that are seldom and often content.
BAD_HINT = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|overlay|comments?|replies|reply|disqus|respond|nav\w*|menu|"
    r"breadcrumbs?|sidebar|widget|footer|header|masthead|related|recommend\w*|share|social|subscribe|newsletter|login|search|pager|pagination|toolbar|tags|complementary|navigation|contentinfo|alert|dialog)(?:$|[^a-z])"
)
GOOD_HINT = re.compile(r"(?:^|[^a-z])(?:article|content|main|post|story|entry|body|text)(?:$|[^a-z])")

#: A comment, a declaration or a tag; quotes in a tag count behind an equals sign alone.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))?)*+)(?:>|$)",
    re.S,
)
_HINTS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """An element: its kind, hints, depth in the tree and own runs of text."""

    tag: str
    parent: int
    hint: str
    silent: bool
    letters: int = 0
    linked: int = 0
    words: int = 0
    sentences: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Block elements of a page in order, parents before children, and its blocks of text."""

    nodes: list[Node]
    #: (node, text) in page order
    blocks: list[tuple[int, str]]


def parse(source: str) -> Page:
    """Read markup into a tree of block elements; inline elements belong to their block."""
    nodes = [Node("root", -1, "", False)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("root", 0)]
    run: list[str] = []
    links = 0
    #: open silent elements with the height of the stack they stand at
    hidden: list[tuple[str, int]] = []
    #: places of the last end tags
    last: dict[str, int] = {}
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            run.clear()
            if text:
                at = stack[-1][1]
                node = nodes[at]
                node.letters += len(text)
                node.linked += min(linked, len(text))
                node.words += text.count(" ") + 1
                node.sentences += sum(map(text.count, ".!?;:"))
                blocks.append((at, text))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if hidden and hidden[-1][0] == "head" and raw.strip():
            hidden.pop()
        if raw and not hidden:
            text = entities.unescape(raw)
            run.append(text)
            if links:
                linked += len(text.strip())

    def leave(tag: str) -> None:
        """Close the nearest open ``tag`` and all within it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                flush()
                del stack[i:]
                unhide()
                return

    def unhide() -> None:
        """Silent elements end with the element they stand in."""
        while hidden and hidden[-1][1] > len(stack):
            hidden.pop()

    def opens(name: str) -> None:
        """A start tag ends silent elements that can't hold it."""
        if hidden and hidden[-1][0] == "head" and name not in _HEAD:
            hidden.pop()
        if hidden and name in _CLOSED_BY.get(hidden[-1][0], ()):
            hidden.pop()
        # svg never holds blocks of the page, and a list of options none either
        if name in BLOCK and name != "hr":
            while hidden and (hidden[-1][0] in ("svg", "select", "option") or hidden[-1][0] in MEDIA and not ends(hidden[-1][0])):
                hidden.pop()

    def ends(tag: str) -> bool:
        """Whether an end tag is still to come."""
        if tag not in last:
            last[tag] = max((x.start() for x in re.finditer(rf"</{tag}(?![a-z0-9:-])", source, re.I)), default=-1)
        return last[tag] >= at

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        closing, name = m.group(1), (m.group(2) or "").lower()
        if not name:
            continue
        if not closing:
            opens(name)
        if name in RAW and not closing:
            # raw text ends at its own end tag alone; a self-closed element may have none of its own
            end = re.compile(rf"</{name}(?![a-z0-9:-])[^>]*(?:>|$)", re.I).search(source, at)
            if m.group(3).rstrip().endswith("/"):
                again = re.compile(rf"<{name}(?![a-z0-9:-])", re.I).search(source, at, end.start() if end else n)
                end = None if again else end
                at = end.end() if end else at
            elif end or name in ("script", "style"):
                at = end.end() if end else n
            else:
                cut = source.find("<", at)
                at = cut if cut >= 0 else n
            continue
        if name in BLOCK:
            if closing:
                leave(name)
                continue
            flush()
            if name in CLOSES_P and stack[-1][0] == "p":
                stack.pop()
            if name in ("li", "dt", "dd", "tr", "td", "th"):
                _close_sibling(stack, name)
            unhide()
            if name in VOID:
                continue
            hint = " ".join(a or b or c for a, b, c in _HINTS.findall(m.group(3))).lower() if "=" in m.group(3) else ""
            parent = stack[-1][1]
            nodes.append(Node(name, parent, hint, False))
            nodes[parent].children.append(len(nodes) - 1)
            stack.append((name, len(nodes) - 1))
        elif name == "br":
            say(" ")
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name in SILENT and closing:
            for i in range(len(hidden) - 1, -1, -1):
                if hidden[i][0] == name:
                    del hidden[i:]
                    break
        elif name in SILENT and name not in RAW and not m.group(3).rstrip().endswith("/"):
            hidden.append((name, len(stack)))
        if name == "body" and not closing:
            hidden.clear()
    flush()
    return Page(nodes, blocks)


def _close_sibling(stack: list[tuple[str, int]], name: str) -> None:
    alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
    fence = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}[name]
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in fence:
            return
        if stack[i][0] in alike:
            del stack[i:]
            return


N_SCALARS = 12
_CHROME = frozenset("aside nav footer header form".split())
N_FEATURES = len(KINDS) + N_SCALARS


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node features, parents and kinds."""
    nodes = page.nodes
    n = len(nodes)
    kinds = np.array([KINDS.index(_KIND_OF.get(x.tag, "other")) for x in nodes])
    parents = np.array([x.parent for x in nodes])
    own = np.array([(x.letters, x.linked, x.words, x.sentences) for x in nodes], dtype=np.float64)
    whole = own.copy()
    for i in range(n - 1, 0, -1):
        whole[parents[i]] += whole[i]
    out = np.zeros((n, N_FEATURES))
    out[np.arange(n), kinds] = 1
    k = len(KINDS)
    out[:, k] = np.log1p(own[:, 0]) / 5
    out[:, k + 1] = np.log1p(whole[:, 0]) / 5
    out[:, k + 2] = whole[:, 1] / np.maximum(1, whole[:, 0])
    out[:, k + 3] = np.minimum(1, whole[:, 3] / np.maximum(1, whole[:, 2]) * 5)
    out[:, k + 4] = [bool(x.hint) and bool(BAD_HINT.search(x.hint)) for x in nodes]
    out[:, k + 5] = [bool(x.hint) and bool(GOOD_HINT.search(x.hint)) for x in nodes]
    out[:, k + 6] = own[:, 0] == 0
    out[:, k + 7] = whole[:, 0] / max(1, whole[0, 0])
    out[:, k + 8] = [len(x.children) == 0 for x in nodes]
    out[:, k + 9] = 1
    # whether an element or one around it is the article's or the page's frame
    frames = {i for i, kind in enumerate(KINDS) if kind in _CHROME}
    for i in range(n):
        out[i, k + 10] = out[i, k + 5] or nodes[i].tag in ("article", "main")
        out[i, k + 11] = out[i, k + 4] or int(kinds[i]) in frames
        if i:
            out[i, k + 10 : k + 12] = np.maximum(out[i, k + 10 : k + 12], out[parents[i], k + 10 : k + 12])
    return out, parents, kinds


@dataclass
class Model:
    """Node weights (features) and pair weights (kind of child, parent label, child label)."""

    node: np.ndarray
    pair: np.ndarray

    def marginals(self, x: np.ndarray, parents: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and of every node the joint of its parent's label and its own."""
        n = len(x)
        score = (x @ self.node).tolist()
        psi = np.exp(self.pair).tolist()
        # potentials of (not content, content), scaled
        local = [(1.0, _exp(s)) for s in score]
        up = [(1.0, 1.0)] * n
        belief = list(local)
        for i in range(n - 1, 0, -1):
            a, b = belief[i]
            t = psi[kinds[i]]
            m0, m1 = a * t[0][0] + b * t[0][1], a * t[1][0] + b * t[1][1]
            z = m0 + m1
            up[i] = m0, m1 = m0 / z, m1 / z
            p = parents[i]
            c, d = belief[p][0] * m0, belief[p][1] * m1
            z = c + d
            belief[p] = (c / z, d / z)
        down = [(1.0, 1.0)] * n
        joint = np.zeros((n, 2, 2))
        out = np.zeros(n)
        for i in range(n):
            a, b = belief[i]
            if i:
                p = parents[i]
                # the parent's belief without this child
                q0, q1 = belief_all[p][0] / up[i][0], belief_all[p][1] / up[i][1]
                t = psi[kinds[i]]
                joint[i] = ((q0 * t[0][0] * a, q0 * t[0][1] * b), (q1 * t[1][0] * a, q1 * t[1][1] * b))
                joint[i] /= joint[i].sum()
                down[i] = (q0 * t[0][0] + q1 * t[1][0], q0 * t[0][1] + q1 * t[1][1])
                a, b = a * down[i][0], b * down[i][1]
            else:
                belief_all: list = [(0.0, 0.0)] * n
            z = a + b
            belief_all[i] = (a / z, b / z)
            out[i] = b / z
        return out, joint


def _exp(s: float) -> float:
    return float(np.exp(min(30.0, max(-30.0, s))))


def train(pages: list[tuple[Page, list[int]]], rounds: int = 600, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum likelihood on pages whose nodes are labelled 1 (content) or 0."""
    model = Model(np.zeros(N_FEATURES), np.zeros((len(KINDS), 2, 2)))
    sums = [np.full(model.node.shape, 1e-6), np.full(model.pair.shape, 1e-6)]
    made = [(*features(p), np.array(y)) for p, y in pages]
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        grad = [-decay * model.node, -decay * model.pair]
        batch = rng.choice(len(made), size=min(24, len(made)), replace=False)
        for b in batch:
            x, parents, kinds, y = made[b]
            p, joint = model.marginals(x, parents, kinds)
            grad[0] += x.T @ (y - p) / len(batch)
            seen = np.zeros_like(joint)
            seen[np.arange(1, len(y)), y[parents[1:]], y[1:]] = 1
            np.add.at(grad[1], kinds[1:], (seen - joint)[1:] / len(batch))
        for g, s, w in zip(grad, sums, (model.node, model.pair)):
            s += g * g
            w += rate * g / np.sqrt(s)
    return model


def extract(source: str | None, model: Model) -> str:
    """Main text of a page."""
    if not source:
        return ""
    page = parse(source)
    if not page.blocks:
        return ""
    if len(page.nodes) == 1:
        return "\n".join(t for _, t in page.blocks)
    content, _ = model.marginals(*features(page))
    return "\n".join(t for at, t in page.blocks if content[at] >= 0.5)


# --- labelled pages by rule -----------------------------------------------------------------


class _Maker:
    """Pages of random layouts; text made for the article begins with a mark."""

    MARK = "⁠"

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.stop = "."
        self.short = False

    def pick(self, *options: str) -> str:
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int, stop: str | None = None) -> str:
        stop = self.stop if stop is None else stop
        letters = "abcdefghilmnoprstuvw"
        out = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            w = "".join(letters[i] for i in self.rng.integers(len(letters), size=int(self.rng.integers(2, 9))))
            out.append(w + (stop if self.chance(0.12) else ""))
        return " ".join(out).capitalize() + stop

    def menu(self, tag: str) -> str:
        n = int(self.rng.integers(2, 9))
        items = [f'<a href="/x{i}">{self.words(1, 2, "")}</a>' for i in range(n)]
        if self.chance(0.7):
            return f"<{tag}><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></{tag.split()[0]}>"
        return f"<{tag}>{' | '.join(items)}</{tag.split()[0]}>"

    def paragraph(self) -> str:
        low, high = (1, 6) if self.chance(1.0 if self.short else 0.15) else (10, 90)
        text = self.MARK + self.words(low, high)
        if self.chance(0.2):
            text += f' <a href="/in">{self.words(1, 4, "")}</a> {self.words(3, 20)}'
        if self.chance(0.2):
            text = f"{self.MARK}<b>{text}</b>" if self.chance(0.7) else f"{self.MARK}<b>{text}<br>"
        return f"<p>{text}</p>" if self.chance(0.85) else f"<p>{text}"

    def article(self) -> str:
        # some texts have no sentences, in others they are short
        self.stop = self.pick(".", ".", ".", ".", "", ", ", "! ")
        # some are lists of short lines, or little more than a heading
        self.short = self.chance(0.25)
        made = self._article()
        self.stop, self.short = ".", False
        return made

    def _article(self) -> str:
        parts = [f"<h1>{self.MARK}{self.words(3, 12, '')}</h1>"] if self.chance(0.85) else []
        for _ in range(int(self.rng.integers(1, (3, 14, 60)[int(self.rng.integers(3))] if self.short else 14))):
            r = self.rng.random()
            if r < 0.78:
                parts.append(self.paragraph())
            elif r < 0.85:
                parts.append(f"<h2>{self.MARK}{self.words(1, 8, '')}</h2>")
            elif r < 0.91:
                items = "".join(f"<li>{self.MARK}{self.words(3, 15)}</li>" for _ in range(int(self.rng.integers(2, 6))))
                parts.append(f"<ul>{items}</ul>")
            elif r < 0.95:
                parts.append(f"<blockquote>{self.MARK}{self.words(8, 30)}</blockquote>")
            elif r < 0.97:
                cells = "".join(f"<tr><td>{self.MARK}{self.words(1, 4)}</td><td>{self.MARK}{self.words(1, 4)}</td></tr>" for _ in range(3))
                parts.append(f"<table>{cells}</table>")
            elif r < 0.985:
                parts.append(self.advert())
            else:
                parts.append(f"<div>{self.MARK}{self.words(10, 50)}</div>")
        return "".join(parts)

    def advert(self) -> str:
        name = self.pick("ad", "ads", "advert", "sponsored", "promo", "banner", "ad-box")
        tag = self.pick("div", "aside", "section")
        return f'<{tag} class="{name}">{self.words(3, 30)}</{tag}>'

    def comments(self) -> str:
        name = self.pick('class="comments"', 'id="comments"', 'class="replies"', 'class="comment-list"', 'id="disqus"')
        one = lambda: self.pick('<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li><p>{}</p></li>", "<div>{}</div>").format(self.words(3, 40))
        tag = self.pick("div", "section", "aside")
        return f"<{tag} {name}>" + (f"<h3>{self.words(1, 3, '')}</h3>" if self.chance(0.5) else "") + "".join(one() for _ in range(int(self.rng.integers(1, 6)))) + f"</{tag}>"

    def chrome(self) -> str:
        r = int(self.rng.integers(7))
        if r == 0:
            return self.advert()
        if r == 1:
            return f'<div class="{self.pick("cookie-notice", "notice", "consent", "cookie-banner", "alert")}"><p>{self.words(5, 30)}</p></div>'
        if r == 2:
            tag = self.pick("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"')
            inside = self.menu("div") if self.chance(0.5) else f"<p>{self.words(5, 40)}</p>"
            return f"<{tag}><h3>{self.words(1, 3, '')}</h3>{inside}</{tag.split()[0]}>"
        if r == 3:
            return f'<form action="/s"><label>{self.words(1, 3, "")}</label><input name="q"><p>{self.words(2, 15)}</p><button>go</button></form>'
        if r == 4:
            return f'<div class="{self.pick("share", "social", "newsletter", "subscribe", "breadcrumbs", "pagination")}">{self.words(2, 15)}</div>'
        if r == 5:
            return f"<aside>{self.words(5, 60)}</aside>"
        return self.menu(self.pick("nav", 'div class="menu"', 'div id="nav"'))

    def page(self) -> str:
        out = [f"<!DOCTYPE html><html><head><title>{self.words(2, 6, '')}</title></head><body>"]
        if self.chance(0.5):
            out.append(f"<header>{self.pick('<p>{}</p>', '<h2>{}</h2>', '{}').format(self.words(1, 8, ''))}{self.menu('nav') if self.chance(0.5) else ''}</header>")
        if self.chance(0.7):
            out.append(self.menu(self.pick("nav", "nav", 'div class="menu"')))
        out += [self.chrome() for _ in range(int(self.rng.integers(0, 3)))]
        tag = self.pick("article", "article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post"', "div", "section", "")
        inside = self.article() + (self.comments() if self.chance(0.2) else "")
        wrapped = f"<{tag}>{inside}</{tag.split()[0]}>" if tag else inside
        out.append(f"<main>{wrapped}</main>" if self.chance(0.2) else wrapped)
        out += [self.chrome() for _ in range(int(self.rng.integers(0, 3)))]
        if self.chance(0.35):
            out.append(self.comments())
        if self.chance(0.85):
            out.append(f"<{self.pick('footer', 'footer', 'div class=\"footer\"')}>&copy; {self.words(3, 25)}" + self.pick("</footer>", "</div>"))
        if self.chance(0.8):
            out.append("</body></html>")
        return "".join(out)


def labelled_pages(n: int, seed: int = 1) -> list[tuple[Page, list[int]]]:
    """Generated pages with a label for every node: content if it holds article text and no other."""
    out = []
    maker = _Maker(seed)
    for _ in range(n):
        page = parse(maker.page())
        good, bad = np.zeros(len(page.nodes)), np.zeros(len(page.nodes))
        for at, text in page.blocks:
            (good if _Maker.MARK in text else bad)[at] += len(text)
        for i in range(len(page.nodes) - 1, 0, -1):
            good[page.nodes[i].parent] += good[i]
            bad[page.nodes[i].parent] += bad[i]
        out.append((page, (good > bad).astype(int).tolist()))
    return out


TRAINING_PAGES = 400
_MODEL: list[Model] = []


def model() -> Model:
    """The model of the generated pages, trained once in a process."""
    if not _MODEL:
        _MODEL.append(train(labelled_pages(TRAINING_PAGES)))
    return _MODEL[0]


def extract_pages(pages: DataFrame, trained: Model | None = None, source: str = "html", column: str = "main_text") -> DataFrame:
    """``pages`` with a column of main texts, its name followed by underscores where it is taken."""
    column = free(pages, column)
    shared = pages.sparkSession.sparkContext.broadcast(trained or model())
    at = pages.columns.index(source)
    schema = T.StructType([*pages.schema.fields, T.StructField(column, T.StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [extract(x.as_py(), shared.value) for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return pages.mapInArrow(run, schema)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    found = extract_pages(pages, column="text")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
