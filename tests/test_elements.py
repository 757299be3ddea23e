"""Pages as nodes, against the standard library's event parser and by hand."""

import random
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listingscope.functions import elements as E
from listingscope.functions import pages as P


def read(html):
    return E.read_pages(pa.array([html], pa.string())).to_pylist()[0]


def shape(html):
    """Elements as nested lists of tags, texts as strings."""
    nodes = read(html)

    def build(i):
        n, j, inside = nodes[i], i + 1, []
        while j <= i + n["size"]:
            inside.append(build(j))
            assert nodes[j]["up"] == j - i and nodes[j]["depth"] == n["depth"] + 1
            j += nodes[j]["size"] + 1
        return n["text"] if n["tag"].startswith("#") else [n["tag"], *inside]

    out, i = [], 0
    while i < len(nodes):
        out.append(build(i))
        i += nodes[i]["size"] + 1
    return out


@pytest.mark.parametrize("html,want", [
    ("<div><div>a</div>b</div>c", [["div", ["div", "a"], "b"], "c"]),
    ("<p>a<p>b<div>c", [["p", "a"], ["p", "b"], ["div", "c"]]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", [["ul", ["li", "a"], ["li", "b", ["ul", ["li", "c"]]], ["li", "d"]], "e"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>d", [["table", ["tr", ["td", "a"], ["td", "b"]], ["tr", ["th", "c"]]], "d"]),
    ("<table><tr><td><table><tr><td>x</table></div>y<td>z</table>", [["table", ["tr", ["td", ["table", ["tr", ["td", "x"]]], "y"], ["td", "z"]]]]),
    ("<b><i>a</b>b</i>c", [["b", ["i", "a"]], "b", "c"]),
    ("a</div><br>b<img src=x>c</br>", ["a", ["br"], "b", ["img"], "c"]),
    ("<script>if (a<b) '</p>'</SCRIPT >x<style>p{}", [["script", "if (a<b) '</p>'"], "x", ["style", "p{}"]]),
    ("1 < 2 &lt;b&gt; <3<!-- <p>no -->x<!doctype html>y<?z?>", ["1 < 2 <b>", "<3", "x", "y"]),
    ("<p", [["p"]]), ("<", ["<"]), ("", []), ("</", []), ("<!--", []), ("a<b", ["a", ["b"]]), ("</ x>a", ["a"]), ("<dl><dt>a<dd>b<dt>c</dl>", [["dl", ["dt", "a"], ["dd", "b"], ["dt", "c"]]]),
    ("<select><option>a<option>b</select>", [["select", ["option", "a"], ["option", "b"]]]),
])
def test_shapes(html, want):
    assert shape(html) == want


def test_attributes():
    def of(html):
        return dict(read(html)[0]["attributes"])
    assert of("<a HREF='x>y' b=c/d e = \"f &amp; g\" h i='' i=2>") == {"href": "x>y", "b": "c/d", "e": "f & g", "h": "", "i": ""}
    assert of("<a b='never closed >text") == {"b": "never"} | {"closed": ""}
    assert of("<a/b=1/>") == {"b": "1/"} and of("<a =x y>") == {"=x": "", "y": ""}


class Events(HTMLParser):
    """Start tags and texts as the standard library sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if data.strip():
            self.seen.append(" ".join(data.split()))


def test_random_pages_have_the_tags_and_texts_of_the_standard_parser():
    r = random.Random(4)
    pieces = ["<div class='a b'>", "</div>", "<p>", "</p>", "<span data-x=1>", "</span>", "text ", "&amp; more", " ", "<br/>", "<li>", "</ul>", "<ul>", "<td>", "<table>", "</table>", "<b>", "</i>"]
    for _ in range(300):
        html = "".join(r.choices(pieces, k=r.randrange(1, 60))).replace("text text", "text <b></b>text")
        e = Events()
        e.feed(html)
        e.close()
        nodes = read(html)
        got = [(n["tag"], dict(n["attributes"])) if not n["tag"].startswith("#") else n["text"] for n in nodes]
        joined = lambda seq: [x for x in seq if not isinstance(x, str)]
        assert joined(got) == joined(e.seen)
        assert "".join("".join(x for x in got if isinstance(x, str)).split()) == "".join("".join(x for x in e.seen if isinstance(x, str)).split())
        for i, n in enumerate(nodes):
            assert i + n["size"] < len(nodes) and (n["up"] == 0) == (n["depth"] == 0)
            if n["up"]:
                assert i <= i - n["up"] + nodes[i - n["up"]]["size"]


def test_deep_and_long_pages_take_linear_time():
    import time
    for make in (lambda n: "<div>" * n, lambda n: "<a b='" * n, lambda n: "<p><b>" * n, lambda n: "</x>" * n, lambda n: "<ul><li>" * n, lambda n: "< " * n, lambda n: "<!-" * n):
        start = time.perf_counter()
        read(make(60_000))
        assert time.perf_counter() - start < 8


def test_text_and_tables(spark):
    rows = spark.createDataFrame([(1, "<div class='x y'>ti<b>n</b>ta <i>boa</i><p>e</p>nova<br>já&nbsp;! <script>no</script></div><p class=x>2"), (2, None), (3, "")], "page_id int, html string")
    n = E.nodes(F.col("html"))
    got = {r.page_id: r for r in rows.select("page_id", E.text_of(n).alias("all"), E.first_text(n, E.of_class("y")).alias("one"),
                                             F.size(E.parts(n, E.of_class("x"))).alias("k"), E.raw_texts(n, E.of_tag("script")).alias("raw"),
                                             E.first_text(n, E.of_class("x", "p")).alias("p")).collect()}
    assert got[1].one == "tinta boa e nova já !" and got[1].all == got[1].one + " 2" and got[1].k == 2 and got[1].raw == ["no"] and got[1].p == "2"
    assert got[2].all is None and got[3].all == "" and got[3].one is None
    flat = {r.element: r for r in E.element_table(rows).where("page_id = 1").collect()}
    assert flat[1].tag == "div" and flat[1].parent is None and flat[2].parent == 1 and flat[2].text == "ti" and flat[3].tag == "b" and flat[3].last == 4
    assert flat[flat[1].last + 1].tag == "p" and flat[1].attributes == {"class": "x y"} and E.element_table(rows).where("page_id <> 1").count() == 0


def test_nested_descriptions_and_reviews(table):
    html = """<nav class="ui-search-breadcrumb"><ol><li><div>Casa</div></li><li>Tinta</li></ol></nav>
      <div class="ui-pdp-description"><div class="ui-pdp-description__content"></div><div data-testid="content"><div>Um <div>dois</div></div>três</div></div>
      <article class="x ui-review-capability-comments__comment"><div><p class="andes-visually-hidden">Nota <b>4</b> de 5</p></div>
      <div class="ui-review-capability-comments__comment__content"><div>Muito <span>b<b>o</b>m</span></div><div>Recomendo</div></div>
      <button data-testid="like-button"><p>ok</p><div><p>1<span>2</span></p></div></button><div><img class="a-carousel-mobile__img" src="1.jpg"><img class="a-carousel-mobile__img"></div></article>
      <article class="ui-review-capability-comments__comment"><article>inner</article><p class="ui-review-capability-comments__comment__content"> </p></article>"""
    df = table("product_id string, title string, url string, html string", ("M", "T", "u", html), ("N", "T", "u", None))
    got = df.where("product_id = 'M'").select(P.description(F.col("html")).alias("d"), P.breadcrumb(F.col("html")).alias("b")).first()
    assert (got.d, got.b) == ("Um dois três", "Casa Tinta")
    a, b = P.review_rows(df).orderBy("review_no").collect()
    assert (a.rating, a.text, a.likes, a.images, a.has_images, a.review_no) == (4, "Muito bom Recomendo", 12, ["1.jpg"], True, 1)
    assert (b.rating, b.text, b.likes, b.images, b.has_images) == (None, "Sem texto.", 0, [], False)
