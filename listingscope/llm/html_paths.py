"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of block tags; inline tags do not enter the path. Every path
gathers the text length, punctuation, link text and number of its blocks over the whole page. Three ratios of a path, length per block,
punctuation per block and the share of text outside links, are smoothed along the page with the ratios of neighbouring blocks and fused by
multiplication. Paths at or above the threshold (the mean less a share of the deviation, each path with the weight of its text outside links, so that
no number of menu items moves it) are content. Where article and main elements hold a good part of the content paths' text, what lies outside them goes.
The container is the deepest element that holds most of the content paths' text. Every block inside the container is kept but those of paths that are mostly links, and so is every block of a path that
reaches the threshold without its neighbours, what lies between these without being mostly links, and the headings before the first of them with
what follows them.

Parts that their tag, role, id or class names as a menu, header, footer, sidebar, notice, advert, form or comment go, and never take part in the
ratios; a name, role or form does not count on an element that holds most of the page's text outside links, or of the text in its article and
main elements: that is a wrapper. Words that name articles as well as parts around them (DOUBTFUL) count only where the blocks' own path stays below
the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb

#: Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "canvas", "noframes", "annotation", "annotation-xml")
AS_IT_STANDS = {"xmp": re.compile(r"</xmp\b[^>]*(?:>|$)", re.I)}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img math semantics mi mn mo ms mtext mspace "
                   "mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section main div".split())
#: Parts that are never content.
BOILERPLATE_TAGS = frozenset("nav header footer aside form head menu dialog button input fieldset select option".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|sidebar|side-?nav|side-?menu|(?:left|right)-?side|aside|widget|ads?|advert(?:s|isements?|ising)?|"
    r"sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|popup|modal|overlay|login|share|sharing|social|"
    r"recommended|comments?|commentlist|replies|respond|disqus|pagination|pager|copyright|skip)(?:$|[\s_-])", re.I)
#: Words that name parts of articles too.
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:side|related|discussion|reviews?|legal|disclaimer)(?:$|[\s_-])", re.I)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Of these, what a form, name or role tells, which a wrapper may bear as well.
WRAPPER_TAGS = frozenset("form fieldset".split())
#: Ids and classes of comment parts, which are no wrappers, however long the comments are.
COMMENT_NAMES = re.compile(r"(?:^|\s)(?:comments?|commentlist|comments?-(?:list|area|section)|replies|respond|disqus(?:_thread)?)(?:$|\s)", re.I)
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[,.;:!?…、。，]")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(id|class|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HREF = re.compile(r"(?:^|[\s/\"'])href\s*=", re.I)
_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I) for tag in RAW}
SPREAD = 0.5     # how far below the mean a path may be, in deviations
KEPT, DOUBTED, NAMED, SKIPPED = range(4)   # what an element's tag, role, id and class say
MARKED = 0.4     # share of the content paths' text that article and main elements must hold for the rest of the page to go
HOLDS = 0.6      # share of the content paths' text that the container holds


@dataclass
class Block:
    path: tuple[int, ...]      # open elements, by number
    names: tuple[str, ...]     # their tags
    skipped: bool              # by an element that cannot be a wrapper
    named: tuple[int, ...]     # open elements that go unless they are wrappers
    doubted: bool              # by a word that names articles too
    content: bool
    text: str
    linked: int


class _Reader:
    """Splits a page into blocks; unclosed and misnested tags are closed as browsers do, as far as blocks are concerned."""

    def __init__(self, page: str):
        self.page, self.blocks, self.made = page, [], 0
        self.open: list[tuple[str, int, int, bool]] = []   # tag, number, KEPT, DOUBTED, NAMED or SKIPPED, content
        self.parts: list[str] = []
        self.linked, self.link_depth = 0, -1               # open elements around the link that is open, -1 for none

    def read(self) -> list[Block]:
        at, page = 0, self.page
        while True:
            m = _TOKEN.search(page, at)
            self.add(page[at:m.start()] if m else page[at:])
            if not m:
                break
            at = m.end()
            tag = m[2].lower() if m[2] else None
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self.parts.append(" ")
                continue
            if m[1]:
                self.close(tag)
            elif tag in AS_IT_STANDS:
                self.flush()
                end = AS_IT_STANDS[tag].search(page, at)
                self.parts.append(page[at:end.start() if end else len(page)])
                self.flush()
                at = end.end() if end else len(page)
            elif tag in _END:
                self.flush_if_block(tag)
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            else:
                self.start(tag, m[3])
        self.flush()
        return self.blocks

    def add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.link_depth >= 0:
                self.linked += len(text.strip())

    def flush_if_block(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(
                tuple(x[1] for x in self.open), tuple(x[0] for x in self.open), any(x[2] == SKIPPED for x in self.open),
                tuple(x[1] for x in self.open if x[2] == NAMED), any(x[2] == DOUBTED for x in self.open), any(x[3] for x in self.open), text, self.linked))
        self.parts, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                self.parts.append(" " if tag == "br" else "")
            elif tag == "a":      # a link ends where the next begins, or with the element that it began in
                self.link_depth = len(self.open) if _HREF.search(attributes) else -1
            return
        self.flush()
        if tag == "body" or tag == "html":
            if any(x[0] == tag for x in self.open):
                return
        if tag in CLOSES_P:
            self.pop_to(("p",), SCOPES)
        if tag in HEADINGS:
            self.pop_to(tuple(HEADINGS), SCOPES)
        if tag in SELF_CLOSING:
            self.pop_to(SELF_CLOSING[tag], SCOPES - {"div"})
        if tag == "body":
            self.pop_to(("head",), frozenset(("html",)))
        if tag in VOID or attributes.rstrip().endswith("/") and tag in VOID:
            return
        self.made += 1
        self.open.append((tag, self.made, self.is_boilerplate(tag, attributes), tag in CONTENT_TAGS))

    def is_boilerplate(self, tag: str, attributes: str) -> int:
        if tag in ("html", "body"):
            return KEPT
        inside = any(x[3] for x in self.open)
        if tag in BOILERPLATE_TAGS and tag not in WRAPPER_TAGS and not (tag == "header" and inside):
            return SKIPPED
        found = NAMED if tag in WRAPPER_TAGS else KEPT
        if "=" not in attributes and "hidden" not in attributes:
            return found
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
            if name in ("id", "class") and tag not in CONTENT_TAGS and BOILERPLATE_NAMES.search(value):
                # An article's own header block holds its heading.
                if not (inside and re.fullmatch(r"\S*header\S*", value)):
                    found = max(found, SKIPPED if COMMENT_NAMES.search(value) else NAMED)
            elif name in ("id", "class") and tag not in CONTENT_TAGS and DOUBTFUL.search(value):
                found = max(found, DOUBTED)
            elif name == "role" and value in BOILERPLATE_ROLES:
                found = max(found, NAMED)
            elif name == "aria-hidden" and value == "true":
                return SKIPPED
            elif name == "hidden" and tag not in CONTENT_TAGS or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return SKIPPED
        return found

    def pop_to(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """Close the nearest open element of ``tags``, unless a scope lies between."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.shut(i)
                return
            if self.open[i][0] in scope:
                return

    def shut(self, i: int) -> None:
        del self.open[i:]
        if self.link_depth > i:
            self.link_depth = -1

    def close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.link_depth = -1
            return
        self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in ("html", "body"):
                    self.shut(i)
                return
            if tag == "p" and self.open[i][0] in SCOPES:
                return


def main_text(page: str | None) -> str:
    """The content blocks in page order, joined by an empty line; '' for null, empty and contentless pages."""
    if not page:
        return ""
    blocks = [b for b in _Reader(page).read() if not b.skipped]
    wrappers = _wrappers(blocks)
    blocks = [b for b in blocks if wrappers.issuperset(b.named)]
    if not blocks:
        return ""
    scores, alone, least = _scores(blocks)
    blocks = [b for b in blocks if not b.doubted or alone[b.names] >= least]
    paths = {p for p, x in scores.items() if x >= least}
    inside, total = (sum(len(b.text) for b in blocks if b.names in paths and (b.content or every)) for every in (False, True))
    if inside >= MARKED * total and inside:
        blocks = [b for b in blocks if b.content]
    container = _container(blocks, paths)
    linked = [2 * b.linked > len(b.text) for b in blocks]
    menus = _link_paths(blocks)
    headed = [bool(HEADINGS.intersection(b.names)) for b in blocks]
    sure = [(container is None or container in b.path) and (b.names not in menus or headed[i]) or alone[b.names] >= least for i, b in enumerate(blocks)]
    if True not in sure:
        return ""
    first, last = sure.index(True), len(sure) - sure[::-1].index(True)
    for i in range(first - 1, -1, -1):
        if headed[i]:
            first = i
        elif linked[i]:
            break
    return "\n\n".join(b.text for i, b in enumerate(blocks) if sure[i] or first <= i < last and (not linked[i] or headed[i]))


def _link_paths(blocks: list[Block]) -> set[tuple[str, ...]]:
    """Paths whose text is mostly links."""
    sums: dict[tuple[str, ...], list[int]] = {}
    for b in blocks:
        s = sums.setdefault(b.names, [0, 0])
        s[0] += min(b.linked, len(b.text))
        s[1] += len(b.text)
    return {p for p, (linked, total) in sums.items() if 2 * linked > total}


def _wrappers(blocks: list[Block]) -> set[int]:
    """Elements with a boilerplate name, role or tag that hold over half of the text outside links, or of that in article and main elements."""
    total, held = [0, 0], {}
    for b in blocks:
        plain = max(0, len(b.text) - b.linked)
        for x, chars in enumerate((plain, plain if b.content else 0)):
            total[x] += chars
            for number in b.named:
                held.setdefault(number, [0, 0])[x] += chars
    return {n for n, chars in held.items() if any(2 * c > t for c, t in zip(chars, total))}


def _scores(blocks: list[Block]) -> tuple[dict[tuple[str, ...], float], dict[tuple[str, ...], float], float]:
    """Fused ratio of every path, smoothed along the page and without its neighbours, and the threshold."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.names, [0.0, 0.0, 0.0, 0.0])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += min(b.linked, len(b.text))
        s[3] += 1
    ratio = {p: (s[0] / s[3], s[1] / s[3], 1 - s[2] / s[0]) for p, s in sums.items()}
    rows = [ratio[b.names] for b in blocks]
    weights = [math.exp(-d * d / 2) for d in range(-2, 3)]
    smooth: dict[tuple[str, ...], list[float]] = {}
    for i, b in enumerate(blocks):
        fused = 1.0
        for column in range(3):
            near = [(weights[d + 2], rows[i + d][column]) for d in range(-2, 3) if 0 <= i + d < len(rows)]
            fused *= sum(w * x for w, x in near) / sum(w for w, _ in near) + (1e-3 if column else 0.0)
        smooth.setdefault(b.names, []).append(math.log1p(fused))
    scores = {p: sum(x) / len(x) for p, x in smooth.items()}
    alone = {p: math.log1p(r[0] * (r[1] + 1e-3) * (r[2] + 1e-3)) for p, r in ratio.items()}
    weight = {p: max(0.0, s[0] - s[2]) for p, s in sums.items()}
    total = sum(weight.values())
    if not total:
        return scores, alone, min(scores.values())
    mean = sum(w * scores[p] for p, w in weight.items()) / total
    deviation = math.sqrt(sum(w * (scores[p] - mean) ** 2 for p, w in weight.items()) / total)
    return scores, alone, mean - SPREAD * deviation - 1e-9


def _container(blocks: list[Block], paths: set[tuple[str, ...]]) -> int | None:
    """The deepest element with at least HOLDS of the content paths' text; None for the whole page.

    Where a page has several articles, their common parent holds them.
    """
    total, held, depth = 0, {}, {}
    for b in blocks:
        if b.names in paths:
            total += len(b.text)
            for d, number in enumerate(b.path):
                held[number] = held.get(number, 0) + len(b.text)
                depth[number] = d
    # Paragraphs and list items are too small to be a container, even if one holds most of the text.
    leaf = {b.path[-1] for b in blocks if b.path and b.names[-1] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption")}
    fit = [n for n, chars in held.items() if chars >= HOLDS * total and n not in leaf]
    return max(fit, key=lambda n: depth[n], default=None)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """All columns and rows of pages but ``page``, with text and n_chars (code points).

    Null and empty pages, and pages of boilerplate only, give an empty text. Pages are read whole, and each by itself, so equal pages give equal
    texts. Columns named text or n_chars are replaced. No shuffle.
    """
    wb.bounded_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", page)]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("_page").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*(f.name for f in kept), F.col(page).alias("_page")).mapInArrow(run, schema)
