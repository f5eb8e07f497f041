"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks: the text between two block-level tags. Blocks and
marked elements (those whose tag, role, class or id says something) are the
nodes of a graph. A classifier gives every node a cost of being called content
and one of being called boilerplate: a block's are the characters of its text
outside and inside links, of a marked element what its mark says. Those costs are
the capacities to the two terminals. Smoothness edges tie every block to the
nearest marked element around it and every marked element to the next one above,
and join blocks that follow each other (the weaker, the further apart they stand
in the tree) and consecutive blocks of one parent; between blocks of different
marks they are weaker. A minimum cut, found by maximum flow, labels all blocks at
once: a long text decides for itself and for what stands between its paragraphs,
a short line goes with its neighbours.

A class or id marks by a whole name: all its words say boilerplate or are words of
layout, and one says boilerplate ("share-bar", not "share-price"). Marks are strong
or soft. A strong one (nav, aside, footer, ad, comments; article) is tied to its
text by more than the text could pull; a soft one is outvoted by enough text. Names
that articles use too ("discussion", "related") are strong beside the article, and
inside it only if their element has mostly links, short lines or form controls;
forms are strong if there are controls for what text they hold. Where a page has
an article that holds its text, what stands outside it is marked as boilerplate;
where it has none, ``main`` takes its place, and without either the text decides.
Should nothing be left of a page, the names that need evidence count as soft.

Map-only; whole pages, one at a time.

Defined cases: null counts as empty and gives the empty text; broken, cut-off
and unclosed markup is read as far as it goes, and an unfinished tag at the end
is dropped; elements that are not shown (hidden, aria-hidden, display:none) have
no text; character references are decoded once, after which runs of white space
become one space; very long pages are read whole; of equal cuts the one with
fewest content blocks is taken; a page without content blocks gives the empty
text; repeated rows are answered one by one; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML element names by their role here: fixed values of the language.
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary"
    " table tbody td tfoot th thead title tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg object audio video canvas".split())
CLOSES_P = BLOCK - frozenset("body html head title option optgroup button td th tr tbody thead tfoot caption".split())
#: Elements that a start tag of the same kind ends, and up to where.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What tags, roles and the words of class and id say of the text below.
BOILER_TAGS = frozenset("nav aside footer menu dialog search button select".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CONTROLS = frozenset("input select textarea button label option".split())
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement adsense sponsored outbrain taboola".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: These say boilerplate anywhere; the next ones inside an article only with evidence.
SURE_WORDS = ADVERT_WORDS | COMMENT_WORDS | frozenset("nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent gdpr popup modal newsletter pagination pager".split())
MAYBE_WORDS = frozenset(
    "sponsor sponsors promo promotion discussion replies respond reactions feedback banner menu crumbs footer masthead aside notice notices overlay"
    " subscribe signup login signin share sharing social related recommended recommendations trending skip".split()
)
SOFT_WORDS = frozenset("header side rail widget alert toolbar tags copyright disclaimer legal form search".split())
CONTENT_WORDS = frozenset("article articlebody content main maincontent post entry story prose".split())
#: Words of layout that may stand beside them in one name.
LAYOUT_WORDS = CONTENT_WORDS | frozenset(
    "site page blog top bottom left right global primary secondary body section container wrapper wrap inner outer box bar block panel list item items link"
    " links buttons icons group area region zone slot unit holder row col column grid module inline floating sticky fixed mobile desktop posts articles stories"
    " entries more field text area js wp amp".split()
)
#: Before a word of a class these say that it is something about the element, not what it is.
ABOUT = frozenset("has no with without is not".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
#: One attribute after the other, values included, so that no name is found inside a value or a longer name.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W_]")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b).{0,200}$|.{0,200}\ball rights reserved\W*$", re.I | re.S)

#: Costs, in characters of text. What a block adds for ending a sentence and for being a heading, what links and a statement of rights take.
ENDED, HEADED, LINKED, RIGHTS = 20, 40, 60, 90
#: A soft mark's cost and its tie to each of its blocks; ties between marks.
SOFT, SOFT_TIE, TIE = 140, 60, 240
NEXT, KIN = 80, 120
#: Divisors of an edge between blocks under different marks, or to a line that states rights.
STRONG_WALL, SOFT_WALL = 8, 2
#: Text of a line that is not short; text of a form's control; text beside the articles for each of theirs, and in any case.
LINE, PER_CONTROL, BESIDE, SLACK = 80, 200, 3, 400


@dataclass(eq=False)
class Mark:
    """A marked element: over or under 0 by what its mark claims, and how (sure, maybe, form, soft, article or main)."""

    claim: int
    how: str
    above: "Mark | None"
    says: int = 0  # the claim, or what the page around makes of it
    strong: bool = False
    closed: bool = False  # what stands below is part of it, whatever it is marked
    framed: bool = False  # within an article or main
    text: int = 0  # characters below outside links, inside them, controls, and characters in long lines
    linked: int = 0
    controls: int = 0
    lines: int = 0
    node: int = -1


@dataclass(eq=False)
class Element:
    tag: str
    parent: "Element | None"
    depth: int
    mark: Mark
    hidden: bool = False
    last: int = -1  # its last block
    marks: "list[Mark] | None" = None  # of the page's root: all marks, outer ones first


@dataclass(eq=False)
class Block:
    text: str
    element: Element
    linked: int
    heading: bool
    rights: bool
    edges: dict[int, int] = field(default_factory=dict)


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and values; of a name given twice the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names(found: dict[str, str]) -> list[frozenset[str]]:
    """The words of every name in class and id."""
    names = []
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [w.lower() for w in _WORDS.findall(token)]
        if parts and parts[0] not in ABOUT:
            names.append(frozenset(w for w in parts if len(w) > 1))
    return names


def _say(names: list[frozenset[str]], words: frozenset[str], beside: frozenset[str] = LAYOUT_WORDS) -> bool:
    """Whether a whole name consists of these words and words of layout."""
    return any(n & words and n <= words | beside for n in names)


def _marked(tag: str, attrs: str, above: Element) -> tuple[Mark, bool]:
    """(the mark that holds below this element, whether the element is hidden)."""
    mark = above.mark
    if tag not in BLOCK and not attrs:
        return mark, above.hidden
    found = attributes(attrs) if attrs else {}
    hidden = above.hidden or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_UNSHOWN.search(found.get("style", "")))
    if tag not in BLOCK or tag in ("html", "body"):
        return mark, hidden
    role, names = found.get("role", "").lower(), _names(found)
    if tag == "article" or found.get("itemprop", "") == "articleBody" or role == "article":
        if _say(names, ADVERT_WORDS | COMMENT_WORDS):
            return Mark(-1, "sure", mark), hidden
        return Mark(1, "article", mark, framed=True), hidden
    if tag == "main" or role == "main":
        return Mark(1, "main", mark, framed=True), hidden
    if tag in BOILER_TAGS or role in BOILER_ROLES:
        return Mark(-1, "sure", mark), hidden
    if tag in ("form", "fieldset"):
        return Mark(-1, "soft" if above.tag in ("body", "html") else "form", mark, framed=mark.framed), hidden
    if tag not in HEADINGS:
        if _say(names, SURE_WORDS, LAYOUT_WORDS | MAYBE_WORDS):
            return Mark(-1, "sure", mark), hidden
        if _say(names, MAYBE_WORDS, LAYOUT_WORDS | SOFT_WORDS):
            return Mark(-1, "maybe", mark, framed=mark.framed), hidden
    if tag == "header" and not mark.framed:
        return Mark(-1, "sure", mark), hidden
    if tag not in HEADINGS:
        if _say(names, SOFT_WORDS):
            return Mark(-1, "soft", mark, framed=mark.framed), hidden
        if any(n & CONTENT_WORDS for n in names) and mark.claim <= 0:
            return Mark(1, "soft", mark, framed=mark.framed), hidden
    return mark, hidden


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in page order, with the smoothness edges between them."""
    root = Mark(0, "", None)
    top = Element("", None, 0, root, marks=[root])
    stack, out = [top], []
    pieces: list[str] = []
    linked = links = at = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                own = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
                out.append(Block(text, own, min(linked, len(text)), own.tag in HEADINGS, len(text) <= 200 and bool(_RIGHTS.match(text))))
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].hidden:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def pop(k: int) -> None:
        nonlocal links
        links -= sum(e.tag == "a" for e in stack[k:])
        del stack[k:]

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attrs, ending = name.lower(), m[3] if m[2] else m[6], bool(m[1] or m[4])
        if m[5] and not m[0].endswith(">"):
            break  # an unfinished tag at the end
        if tag == "br":
            add(" ")
            continue
        if tag in CONTROLS and not ending:
            stack[-1].mark.controls += 1
        if tag in RAW and not ending:
            if tag in BLOCK:
                close()
            if not attrs.endswith("/"):
                end = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in BLOCK:
            close()
        if ending:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k and tag in BLOCK:
                pop(k)
            elif k:
                links -= tag == "a"
                del stack[k]
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ("p", "td", "th", "div", "li", "button")), 0)
            if k and stack[k].tag == "p":
                pop(k)
        if tag in ENDS:
            ended, limit = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limit:
                    break
                if stack[k].tag in ended:
                    pop(k)
                    if tag != "tr":
                        break
        above = stack[-1]
        mark, hidden = _marked(tag, attrs, above)
        if mark is not above.mark:
            top.marks.append(mark)
        stack.append(Element(tag, above, above.depth + 1, mark, hidden))
        links += tag == "a"
    close()
    for i, b in enumerate(out):
        if i:
            weight = NEXT // (1 + _apart(out[i - 1].element, b.element))
            if weight:
                b.edges[i - 1] = out[i - 1].edges[i] = weight
        kin = b.element.parent or b.element
        if kin.last >= 0:
            j = kin.last
            b.edges[j] = out[j].edges[i] = b.edges.get(j, 0) + KIN
        kin.last = i
    for b in out:
        m, text = b.element.mark, len(b.text) - b.linked
        m.text, m.linked, m.lines = m.text + text, m.linked + b.linked, m.lines + (text if text >= LINE else 0)
    for m in reversed(top.marks):
        if m.above is not None:
            for name in ("text", "linked", "controls", "lines"):
                setattr(m.above, name, getattr(m.above, name) + getattr(m, name))
    _weigh(top.marks, out)
    for i, b in enumerate(out):
        for j in b.edges:
            if j < i:
                b.edges[j] = out[j].edges[i] = b.edges[j] // _wall(out[j], b)
    for b in out:
        b.edges = {j: w for j, w in b.edges.items() if w}
    return out


def _weigh(marks: list[Mark], blocks: list[Block], lenient: bool = False) -> None:
    """Which marks are strong, by what stands below them."""
    for m in marks:
        m.closed = m.above is not None and m.above.closed
        m.says, m.strong = -1 if m.closed else m.claim, m.closed or m.how == "sure"
        if m.how == "maybe" and not lenient:
            m.strong |= not m.framed or m.controls > 0 or m.linked > m.text or not m.lines
        elif m.how == "form":
            m.strong |= not lenient and 0 < m.controls and m.text <= PER_CONTROL * m.controls
            if not m.controls and not m.closed:
                m.says = 0
        m.closed = m.strong
    for how in ("article", "main"):
        held: dict[int, bool] = {}
        for m in marks:
            held[id(m)] = m.how == how or (m.above is not None and held[id(m.above)])
        inside = beside = 0
        for b in blocks:
            m, text = b.element.mark, len(b.text) - b.linked
            if held[id(m)] and not m.closed:
                inside += text
            elif not m.closed:
                beside += text
        if inside and beside <= BESIDE * inside + SLACK:
            for m in marks:
                if not held[id(m)]:  # the page around the article
                    m.says, m.strong = -1, True
                elif m.how == how:
                    m.strong = True
            return


def _apart(a: Element, b: Element) -> int:
    """Steps in the tree between two elements, siblings being 0."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return max(0, n - 2)


def _wall(a: Block, b: Block) -> int:
    if a.rights or b.rights:
        return STRONG_WALL
    x, y = a.element.mark, b.element.mark
    return 1 if x is y else STRONG_WALL if x.strong or y.strong else SOFT_WALL


def cost(b: Block) -> int:
    """What it costs to call a block boilerplate, less what it costs to call it content, by its text alone."""
    if b.rights:
        return -RIGHTS
    if not _WORD.search(b.text):  # a rule or an arrow goes with what stands around it
        return 0
    plain = len(b.text) - b.linked
    if b.linked > plain:
        return plain - b.linked - LINKED
    return plain - b.linked + ENDED * (b.text[-1] in ".!?:;…\"»”") + HEADED * b.heading


def graph_of(blocks: list[Block]) -> tuple[list[int], list[dict[int, int]]]:
    """(costs, edges) of the page's graph: its blocks in order, then the marked elements above them."""
    costs, edges = [cost(b) for b in blocks], [dict(b.edges) for b in blocks]
    marks: list[Mark] = []
    for b in blocks:
        mark = b.element.mark
        while mark is not None and mark.node < 0:
            mark.node = len(blocks) + len(marks)
            marks.append(mark)
            mark = mark.above
    for m in marks:
        costs.append(m.says * SOFT)
        edges.append({})
    tie = lambda i, j, w: (edges[i].__setitem__(j, w), edges[j].__setitem__(i, w))
    for i, b in enumerate(blocks):
        m = b.element.mark
        if m.says:
            tie(i, m.node, abs(costs[i]) + sum(edges[i].values()) + 1 if m.strong else SOFT_TIE)
    for m in marks:
        if m.above is not None and m.above.says and m.says:
            tie(m.node, m.above.node, TIE if m.above.strong else SOFT_TIE)
    for m in marks:
        if m.strong:
            costs[m.node] = m.says * (sum(edges[m.node].values()) + 1)
    for m in marks:
        m.node = -1
    return costs, edges


def min_cut(costs: list[int], edges: list[dict[int, int]]) -> list[bool]:
    """Which nodes stand on the content side of a minimum cut (costs over 0 pull towards content).

    The cut is found by maximum flow along shortest paths, level by level; the
    nodes that the source still reaches are content.
    """
    source, sink = -1, -2
    rest: dict[int, dict[int, int]] = {i: dict(e) for i, e in enumerate(edges)}
    rest[source], rest[sink] = {}, {}
    for i, c in enumerate(costs):
        if c > 0:
            rest[source][i], rest[i][source] = c, 0
        elif c < 0:
            rest[i][sink], rest[sink][i] = -c, 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in rest[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return [i in level for i in range(len(costs))]
        arcs = {i: iter(list(rest[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                flow = min(rest[a][b] for a, b in steps)
                cut = 0
                for k, (a, b) in enumerate(steps):
                    rest[a][b] -= flow
                    rest[b][a] += flow
                    if not rest[a][b] and not cut:
                        cut = k + 1
                del path[cut:]
                continue
            for j in arcs[i]:
                if rest[i][j] > 0 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level[i] = -1


@dataclass
class Labelled:
    blocks: list[Block]
    costs: list[int]
    content: list[bool]

    @property
    def changed(self) -> int:
        """Blocks that the cut labels otherwise than their own cost would."""
        return sum((c > 0) != k for c, k in zip(self.costs, self.content))


def label(page: str | None) -> Labelled:
    blocks = blocks_of(page or "")
    costs, edges = graph_of(blocks)
    content = min_cut(costs, edges)[: len(blocks)]
    if not any(content) and any(c > 0 for c in costs[: len(blocks)]):
        element = blocks[0].element
        while element.parent is not None:
            element = element.parent
        _weigh(element.marks or [], blocks, lenient=True)
        costs, edges = graph_of(blocks)
        content = min_cut(costs, edges)[: len(blocks)]
    return Labelled(blocks, costs[: len(blocks)], content)


def extract(page: str | None) -> list[str]:
    """The content blocks of a page, in order."""
    found = label(page)
    return [b.text for b, k in zip(found.blocks, found.content) if k]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(extract(x.as_py())) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
