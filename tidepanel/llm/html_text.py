"""Main text of web pages by tag-path ratios.

Every stretch of text has a path of tags from the root. Lengths and punctuation marks are added up
by path; their means per node are fused, smoothed along the page and averaged by path again. Paths
above a threshold are content and are returned wherever they lie; of the article, the element that
holds nearly all content, the rest is returned as well, all without the parts that are marked as something else. A class, id or role marks only if
what bears it holds less than the bulk of the page's text: it may as well name a wrapper.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 200  # elements further down have the path of this level
# Elements by kind, and words in class, id and role that mark other matter.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml canvas audio video textarea select title xmp noembed noframes".split())
SKIPPED = frozenset("head nav footer aside".split())
# Elements that are other matter unless they wrap the bulk of the page's text.
WRAPPERS = frozenset("form button dialog menu label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies "
    "share sharing social newsletter subscribe subscription signup login popup modal overlay related recommended recommendations widget widgets "
    "pagination pager toolbar skip contentinfo complementary search searchbox".split()
)
HEADS = frozenset("header site-header page-header".split())
WHOLE = frozenset("html body main article".split())
# Words of names that tell a state of the page rather than what the element holds (has-sidebar, comments-open).
STATES = frozenset("has no with without open closed layout".split())
# Words for what readers wrote, which may be longer than the article.
READERS = frozenset("comment comments disqus respond reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|\Z)|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


@dataclass
class Node:
    """A stretch of text: its path, its block's number, whether it is inside a link, an article and a header outside of one, and names around it that mark other matter."""

    path: tuple[str, ...]
    block: int
    text: str
    link: bool
    article: bool = False
    head: bool = False
    marks: frozenset[str] = frozenset()


@dataclass
class Open:
    """An open element and what holds for text inside it."""

    name: str
    path: tuple[str, ...] = ()
    link: bool = False
    skipped: bool = False
    inside: bool = False  # an article or main element, marked or not
    article: bool = False
    head: bool = False
    marks: frozenset[str] = frozenset()


def text_nodes(html: str) -> list[Node]:
    """Text outside of skipped elements, in page order; broken and cut-off markup is put up with."""
    return parse(html)[0]


def parse(html: str) -> tuple[list[Node], Counter[str]]:
    """``text_nodes`` and how many elements bear each mark. Time grows with the length of the page, however deep it nests."""
    nodes: list[Node] = []
    bearers: Counter[str] = Counter()
    top = Open("")
    stack: list[Open] = []
    counts: Counter[str] = Counter()  # open elements by name

    def cut(k: int) -> None:
        counts.subtract(e.name for e in stack[k:])
        del stack[k:]

    def text(block: int, said: str, link: bool) -> None:
        e = stack[-1] if stack else top
        nodes.append(Node(e.path, block, said, link, e.article, e.head, e.marks))

    block, at, end = 0, 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        if not m:  # a tag with an open quote
            at = html.find(">", at) + 1 or end
            continue
        at = m.end()
        if m[5] is not None:
            if not (stack and stack[-1].skipped):
                said = entities.unescape(m[5])
                if said:
                    text(block, said, bool(stack) and stack[-1].link)
            continue
        name = (m[2] or "").lower()
        if not name or not m[4]:
            continue
        if name in BLOCK:
            block += 1
        if m[1]:
            if counts[name] > 0:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            continue
        if name == "br":
            text(block, " ", False)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
            if m[3].endswith("/") and name in ("svg", "iframe"):
                continue
            at = end if not close else html.find(">", close.end()) + 1 or end
            continue
        if name in ENDS_P and counts["p"] > 0:
            _close(stack, cut, {"p"}, {"button", "table", "td", "th"})
        if name in SIBLINGS and any(counts[n] > 0 for n in SIBLINGS[name]):
            _close(stack, cut, SIBLINGS[name], LIMITS[name])
        around = stack[-1] if stack else top
        step, other, marks = _describe(name, m[3], around.inside)
        if name in WRAPPERS:
            marks |= {f"<{name} {len(bearers)}.{len(nodes)}>"}
        bearers.update(marks)
        article = around.article
        if name in WHOLE:
            article, marks = article or (name in ("article", "main") and not marks), frozenset()
        path = (*around.path, step) if name in BLOCK and len(around.path) < DEEPEST else around.path
        stack.append(Open(
            name, path, around.link or name == "a", other or around.skipped, around.inside or name in ("article", "main"), article,
            around.head or (name == "header" and not around.inside), around.marks | marks if marks else around.marks))
        counts[name] += 1
    return nodes, bearers


def _close(stack: list[Open], cut: Callable[[int], None], names: set[str], limits: set[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].name in names:
            return cut(k)
        if stack[k].name in limits:
            return None


def _describe(name: str, attributes: str, in_article: bool) -> tuple[str, bool, frozenset[str]]:
    """Path step (name and class) of an element, whether it can't be the article's, and the names that mark it as something else.

    Of several names with the same word the shortest stands for all; numbers in them don't count.
    """
    other = name in SKIPPED
    step, marks = name, {}
    if attributes and "=" in attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        style = found.pop("style", "")
        for said in sorted(" ".join(found.values()).split(), key=len):
            words = {w.lower() for w in _WORD.findall(said)}
            if not words & STATES:
                for word in words & OTHER:
                    marks.setdefault(word, _NUMBER.sub("", said))
            if not in_article and said.lower() in HEADS:
                marks.setdefault("header", said)
        step = ".".join([name, *found.get("class", "").split()[:3]])
        other = other or bool(_NOT_SHOWN.search(style))
    if attributes and _HIDDEN.search(_QUOTED.sub("''", attributes)):
        other = True
    return step, other, frozenset(marks.values())


def without_marked(nodes: list[Node], bearers: Mapping[str, int] = {}, most: float = 2 / 3, most_readers: float = 0.9) -> list[Node]:
    """Nodes without those under a name that marks other matter, unless the article itself is under it.

    A name's share is its text outside links over that plus the text under no such name, within the
    page's article elements if they hold text. One with more than ``most`` (``most_readers`` for what
    readers wrote) is a wrapper and marks nothing: its text counts as free. The greatest come
    first, what readers wrote last. Where elements with a readers' name repeat and hold half of the
    text under such names, that is what readers wrote, however long, if there is other text.
    """
    size = [0 if n.link else len(n.text.strip()) for n in nodes]
    scope = [(n.marks, s) for n, s in zip(nodes, size) if n.article and s] or [(n.marks, s) for n, s in zip(nodes, size) if s]
    marking = {m for n in nodes for m in n.marks}
    readers = {m for m in marking if READERS & {w.lower() for w in _WORD.findall(m)}}
    by: dict[frozenset[str], int] = {}
    for marks, s in scope:
        by[marks] = by.get(marks, 0) + s
    under: dict[str, list[frozenset[str]]] = {m: [] for m in marking}
    for marks in by:
        for m in marks:
            under[m].append(marks)
    held = {m: sum(by[marks] for marks in under[m]) for m in marking}
    free = by.get(frozenset(), 0)
    held_by_readers = sum(s for marks, s in by.items() if marks & readers)
    repeated = any(bearers.get(m, 0) > 1 and 2 * held[m] >= held_by_readers for m in readers)
    # What is free only grows, and shares fall with the text held, so one pass does.
    for m in sorted(marking, key=lambda m: (m in readers, -held[m], m)):
        if m in readers and free and repeated and 2 * held[m] >= held_by_readers:
            continue
        if held[m] > (most_readers if m in readers else most) * (held[m] + free):
            marking.remove(m)
            free += sum(by[marks] for marks in under[m] if not marks & marking)
    return [n for n in nodes if not n.marks & marking]


def main_text(html: str | None, share: float = 0.9, spread: float = 1.0) -> str:
    """Blocks of the article joined by blank lines; empty if the page has no text."""
    nodes = without_marked(*parse(html or ""))
    heads, nodes = [n for n in nodes if n.head], [n for n in nodes if not n.head]
    shown = [n for n in nodes if not n.text.isspace()]
    if not shown:
        return ""
    paths = list(dict.fromkeys(n.path for n in shown))
    number = {p: i for i, p in enumerate(paths)}
    owner = np.array([number[n.path] for n in shown])
    length = np.array([len(n.text.strip()) for n in shown], float)
    marks = np.array([len(MARKS.findall(n.text)) for n in shown], float)
    linked = np.array([n.link for n in shown], float) * length
    per = np.bincount(owner)
    total = np.bincount(owner, length)
    fused = total / per * (1 + np.bincount(owner, marks) / per) * (1 - np.bincount(owner, linked) / total)
    kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2 / spread**2)
    weight = np.convolve(np.ones(len(shown)), kernel, "same") if len(shown) >= 7 else None
    smooth = np.convolve(fused[owner], kernel, "same") / weight if weight is not None else fused[owner]
    score = np.sqrt(np.bincount(owner, smooth) / per * fused)
    content = score >= min(score.std(), score.max())
    mass = np.where(content, total, 0.0)
    menu = (np.bincount(owner, linked) >= 0.99 * total) & (per >= 3)
    article = _widened(_container(paths, mass, share), paths, content & ~menu, total, np.bincount(owner, linked))
    kept = {p for i, p in enumerate(paths) if (content[i] or p[:len(article)] == article) and not menu[i]}
    # A header outside of article elements is the article's if it holds a heading, sits where the
    # content does and the article begins without a heading of its own.
    first = next(n.path for n in shown if n.path in kept)
    if heads and not any(_name((step,)) in HEADINGS for step in first):
        above = {n.path[:k] for n in heads for k in range(len(n.path)) if _name(n.path[k:k + 1]) == "header"}
        ours = {a for a in above if len(a) > 1 and article[:len(a)] == a and any(n.path[:len(a)] == a and _rank([n.path]) < 7 for n in heads)}
        added = [n for n in heads if any(n.path[:len(a)] == a for a in ours)]
        if sum(len(n.text) for n in added if n.link) * 2 <= sum(len(n.text) for n in added):
            kept |= {n.path for n in added}
            nodes = sorted([*nodes, *added], key=lambda n: n.block)
    blocks: dict[int, list[str]] = {}
    for node in nodes:
        if node.path in kept or (node.text.isspace() and node.block in blocks):
            blocks.setdefault(node.block, []).append(node.text)
    joined = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def _container(paths: list[tuple[str, ...]], mass: np.ndarray, share: float) -> tuple[str, ...]:
    """The deepest path whose subtree holds ``share`` of the content's characters, at most down to an article or main element."""
    need, prefix = share * mass.sum(), ()
    while not prefix or _name(prefix) not in ("article", "main"):
        below: dict[tuple[str, ...], float] = {}
        for path, m in zip(paths, mass):
            if path[:len(prefix)] == prefix and len(path) > len(prefix):
                step = path[:len(prefix) + 1]
                below[step] = below.get(step, 0.0) + m
        step = max(below, key=below.get, default=None)
        if step is None or below[step] < need or _name(step) in ("p", "li", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre"):
            return prefix
        prefix = step
    return prefix


def _name(path: tuple[str, ...]) -> str:
    return path[-1].split(".")[0]


def _rank(paths: list[tuple[str, ...]]) -> int:
    """Level of the highest heading among the paths, 7 if there is none."""
    return min((int(_name(p)[1]) for p in paths if p and _name(p) in HEADINGS), default=7)


def _widened(article: tuple[str, ...], paths: list[tuple[str, ...]], content: np.ndarray, total: np.ndarray, linked: np.ndarray) -> tuple[str, ...]:
    """The next element around ``article`` that holds more text, if what it adds is the article's, too.

    That is, it holds content or a heading above all headings inside, and more text outside links
    than in them. An article or main element is never widened, nor is anything to the whole page.
    """
    if article and _name(article) in ("article", "main"):
        return article
    inside = [p for p in paths if p[:len(article)] == article]
    for k in range(len(article) - 1, 0, -1):
        wider = article[:k]
        added = [i for i, p in enumerate(paths) if p[:k] == wider and p[:len(article)] != article]
        if _name(wider) in ("html", "body"):
            break
        if added:
            ours = content[added].any() or _rank([paths[i] for i in added]) < _rank(inside)
            return wider if ours and linked[added].sum() <= total[added].sum() / 2 else article
    return article


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page id, url, ``text``, ``n_chars`` (code points of the text).

    Null html counts as empty and gives empty text. Character references are decoded, white space
    inside a block becomes one space, blocks follow each other in page order with a blank line
    between. Pages are read whole; repeated rows give repeated results; no rows in, no rows out.
    Other columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    chosen = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
