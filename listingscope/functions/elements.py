"""Stored pages as nodes: a tag-stack reader, and column expressions over what it gives.

``nodes`` reads a page once into an array of nodes in document order. A node holds ``size``, the number of its descendants, so the part of a page below
an element is a slice of the array and every reading of it is linear; nothing is shuffled. Text is a node of its own (``#text``; ``#raw`` inside script and
style), and ``gap`` says whether white space or the border of a block parts it from the text before.

End tags may be missing, crossed or stray: an end tag closes the nearest open element of its name inside the same table cell, others are ignored;
a paragraph, list item, cell, row or option ends where the next begins. A quote that never ends stops at the next ``>``.
"""

from __future__ import annotations

import functools
import html as entities
import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingscope.session import small_batches

NODES = "array<struct<tag:string, attributes:map<string,string>, text:string, gap:boolean, depth:int, up:int, size:int>>"
TEXT, RAW = "#text", "#raw"

# What the HTML standard says of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT = frozenset("script style".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body br caption dd dt head html legend li option select tbody td tfoot th thead title tr".split())
CELL = frozenset("html table td th caption template object select".split())     # an end tag inside does not reach out of them
LIST = CELL | frozenset("ul ol dl menu button".split())                         # nor does the start of an item or paragraph
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup")}
TABLE_SIBLINGS = {
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    "thead": ("caption",), "tfoot": ("tbody", "thead", "tr", "td", "th")}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN, _BLANKS, _KEY, _BARE = re.compile(r"[\s/]*"), re.compile(r"\s*"), re.compile(r"=?[^\s=/>]*"), re.compile(r"[^\s>]*")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TEXT}


class _Page:
    """One reading of one page; the nodes go to the flat lists of ``out``."""

    def __init__(self, html: str, out: _Flat):
        self.html, self.out, self.begin = html, out, len(out.tag)
        self.stack: list[int] = []                      # open elements by node number
        self.open: dict[str, list[int]] = {}            # their places in the stack by name
        self.cells: list[int] = [0]                     # stack places where a cell's or list's inside begins
        self.lists: list[int] = [0]
        self.tables: list[int] = [0]
        self.gap, self.no_quote = True, set()

    def node(self, tag: str, attributes: dict[str, str] | None, text: str | None) -> int:
        o, n = self.out, len(self.out.tag)
        o.tag.append(tag)
        o.keys.extend(attributes or ())
        o.values.extend((attributes or {}).values())
        o.attribute_ends.append(len(o.keys))
        o.text.append(text)
        o.gap.append(self.gap)
        o.depth.append(len(self.stack))
        o.up.append(n - self.stack[-1] if self.stack else 0)
        o.size.append(0)
        return n

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        n = self.node(tag, attributes, None)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(n)
        for marks, kinds in ((self.cells, CELL), (self.lists, LIST)):
            if tag in kinds:
                marks.append(len(self.stack))
        if tag == "table":
            self.tables.append(len(self.stack))

    def close(self, place: int) -> None:
        """Ends the elements from this place of the stack on."""
        last = len(self.out.tag) - 1
        while len(self.stack) > place:
            n = self.stack.pop()
            self.out.size[n] = last - n
            self.open[self.out.tag[n]].pop()
        for marks in (self.cells, self.lists, self.tables):
            while marks[-1] > place and len(marks) > 1:
                marks.pop()

    def close_any(self, tags: tuple[str, ...], floor: int) -> None:
        """Ends the outermost open element of these names above ``floor``."""
        first = None
        for t in tags:
            places = self.open.get(t)
            if places and places[-1] >= floor:
                i = len(places) - 1
                while i and places[i - 1] >= floor:
                    i -= 1
                first = places[i] if first is None else min(first, places[i])
        if first is not None:
            self.close(first)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ENDS_PARAGRAPH:
            self.close_any(("p",), self.lists[-1])
        if tag in SIBLINGS:
            self.close_any(SIBLINGS[tag], self.lists[-1])
        elif tag in TABLE_SIBLINGS:
            self.close_any(TABLE_SIBLINGS[tag], self.tables[-1])
        self.gap |= tag in BLOCKS
        if tag in VOID:
            self.node(tag, attributes, None)
        else:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        self.gap |= tag in BLOCKS
        places = self.open.get(tag)
        floor = self.tables[-1] - 1 if tag in TABLE_SIBLINGS else 0 if tag in CELL else self.cells[-1]
        if places and places[-1] >= floor:
            self.close(places[-1])

    def words(self, text: str, tag: str = TEXT) -> None:
        if not text:
            return
        if tag == RAW:
            self.node(RAW, None, text)
            return
        text = entities.unescape(text)
        kept = text.strip()
        self.gap |= not kept or text[:1].isspace()
        if kept:
            self.node(TEXT, None, " ".join(kept.split()))
            self.gap = text[-1:].isspace()

    def attributes(self, i: int) -> tuple[dict[str, str], int]:
        """Attributes from place i on, and the place after the tag."""
        html, found = self.html, {}
        while True:
            i = _BETWEEN.match(html, i).end()
            if i >= len(html) or html[i] == ">":
                return found, i + 1
            m = _KEY.match(html, i)
            key, i = m.group().lower(), m.end()
            value, j = "", _BLANKS.match(html, i).end()
            if html[j:j + 1] == "=":
                j = _BLANKS.match(html, j + 1).end()
                quote = html[j:j + 1]
                to = html.find(quote, j + 1) if quote in ("'", '"') and quote not in self.no_quote else -1
                if to >= 0:
                    value, i = html[j + 1:to], to + 1
                else:
                    if quote in ("'", '"'):
                        self.no_quote.add(quote)     # none follows, here or later
                        j += 1
                    m = _BARE.match(html, j)
                    value, i = m.group(), m.end()
            found.setdefault(key, entities.unescape(value))

    def read(self) -> None:
        html, i = self.html, 0
        while i < len(html):
            at = html.find("<", i)
            if at < 0:
                break
            after = html[at + 1:at + 2]
            if after == "/":
                name = _NAME.match(html, at + 2)
                if not name and html[at + 2:at + 3] != ">":
                    to = html.find(">", at)
                    self.words(html[i:at])
                    i = to + 1 if to >= 0 else len(html)
                    continue
                self.words(html[i:at])
                i = self.attributes(name.end())[1] if name else at + 3
                if name:
                    self.end(name.group().lower())
                continue
            if after in ("!", "?"):
                self.words(html[i:at])
                if html.startswith("<!--", at):
                    to = html.find("-->", at + 2)
                    i = to + 3 if to >= 0 else len(html)
                else:
                    to = html.find(">", at)
                    i = to + 1 if to >= 0 else len(html)
                continue
            name = _NAME.match(html, at + 1)
            if not name:                     # a lone < is text
                to = html.find("<", at + 1)
                to = to if to >= 0 else len(html)
                self.words(html[i:to])
                i = to
                continue
            self.words(html[i:at])
            tag = name.group().lower()
            attributes, i = self.attributes(name.end())
            self.start(tag, attributes)
            if tag in RAW_TEXT:
                m = _RAW_END[tag].search(html, i)
                self.words(html[i:m.start() if m else len(html)], RAW)
                i = m.start() if m else len(html)
        if i < len(html):
            self.words(html[i:])
        self.close(0)


class _Flat:
    """Nodes of a batch of pages, one list per field."""

    def __init__(self):
        self.tag, self.keys, self.values, self.attribute_ends = [], [], [], [0]
        self.text, self.gap, self.depth, self.up, self.size, self.page_ends = [], [], [], [], [], [0]

    def array(self, valid: list[bool]) -> pa.Array:
        offsets = pa.array(self.attribute_ends, pa.int32())
        fields = [
            pa.array(self.tag, pa.string()), pa.MapArray.from_arrays(offsets, pa.array(self.keys, pa.string()), pa.array(self.values, pa.string())),
            pa.array(self.text, pa.string()), pa.array(self.gap, pa.bool_()), *(pa.array(x, pa.int32()) for x in (self.depth, self.up, self.size))]
        struct = pa.StructArray.from_arrays(fields, ["tag", "attributes", "text", "gap", "depth", "up", "size"])
        return pa.ListArray.from_arrays(pa.array(self.page_ends, pa.int32()), struct, mask=pa.array([not v for v in valid]))


def read_pages(pages: pa.Array) -> pa.Array:
    """Nodes of each page; null for null."""
    out, texts = _Flat(), pages.to_pylist()
    for t in texts:
        if t is not None:
            _Page(t, out).read()
        out.page_ends.append(len(out.tag))
    return out.array([t is not None for t in texts])


@functools.cache
def _reader():
    """One function object, so that several readings of one page in a plan are done once."""
    return F.arrow_udf(read_pages, NODES)


def nodes(html: Column) -> Column:
    """The page's nodes, of type NODES; null for a null page, empty for an empty one."""
    small_batches(SparkSession.active())
    return _reader()(html)


def element_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, element, parent, last, depth, tag, attributes, text): a row per node of every page, numbered from 1 in document order.

    The nodes below an element are those numbered from ``element`` + 1 to ``last``; the outermost elements have no parent.
    """
    found = pages.select(key, F.posexplode(nodes(F.col(html))).alias("_p", "_n"))
    no = F.col("_p") + 1
    return found.select(
        key, no.alias("element"), F.when(F.col("_n.up") > 0, no - F.col("_n.up")).alias("parent"), (no + F.col("_n.size")).alias("last"),
        "_n.depth", "_n.tag", "_n.attributes", "_n.text")


# ---------------------------------------------------------------- expressions over nodes

Test = Callable[[Column], Column]


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attributes"], F.lit(name))


def of_class(name: str, tag: str | None = None) -> Test:
    """Elements that have the class."""
    def test(node: Column) -> Column:
        classes = F.coalesce(attribute(node, "class"), F.lit(""))
        has = classes.contains(name) & F.array_contains(F.split(classes, r"\s+"), name)    # few are split
        return has if tag is None else (node["tag"] == tag) & has
    return test


def class_holds(part: str) -> Test:
    """Elements whose class attribute contains the string."""
    return lambda node: F.coalesce(attribute(node, "class"), F.lit("")).contains(part)


def with_attribute(name: str, value: str, tag: str | None = None) -> Test:
    def test(node: Column) -> Column:
        same = F.coalesce(attribute(node, name) == value, F.lit(False))
        return same if tag is None else (node["tag"] == tag) & same
    return test


def of_tag(tag: str) -> Test:
    return lambda node: node["tag"] == tag


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is computed once and may be named inside further lambdas even where it is a Python function's result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def below(nodes: Column, place: Column) -> Column:
    """The element at the place (from 1) and everything in it; its nodes can be read like a page's."""
    return F.slice(nodes, place, F.get(nodes, place - 1)["size"] + 1)


def parts(nodes: Column, test: Test) -> Column:
    """array of node arrays: every element that passes the test, with everything in it, in document order."""
    def found(n: Column) -> Column:
        places = F.filter(F.transform(n, lambda x, i: F.when(test(x), i + 1)), lambda p: p.isNotNull())
        return F.transform(places, lambda p: below(n, p))
    return let(nodes, found)


def first_part(nodes: Column, test: Test) -> Column:
    """The first element that passes the test, with everything in it; null if there is none."""
    def found(n: Column) -> Column:
        return let(F.array_position(F.transform(n, test), True).cast("int"), lambda place: F.when(place > 0, below(n, place)))
    return let(nodes, found)


def text_of(nodes: Column) -> Column:
    """The text in an element, without markup; blocks and white space part it by one blank. '' without text, null for null."""
    texts = F.filter(nodes, lambda x: x["tag"] == TEXT)
    return F.trim(F.array_join(F.transform(texts, lambda x: F.concat(F.when(x["gap"], " ").otherwise(""), x["text"])), ""))


def first_text(nodes: Column, test: Test) -> Column:
    """Text of the first element that passes; null if there is none or it has no text."""
    return let(text_of(first_part(nodes, test)), lambda text: F.when(text != "", text))


def raw_texts(nodes: Column, test: Test) -> Column:
    """array of what stands in the script and style elements that pass, as it stands."""
    return F.transform(parts(nodes, test), lambda p: F.concat_ws("", F.transform(F.filter(p, lambda x: x["tag"] == RAW), lambda x: x["text"])))


# Workers get the functions above themselves, so an executor needs Arrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
