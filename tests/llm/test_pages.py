"""Main text and URL verdicts."""

import pytest

from listingscope.llm import html_paths, url_rules

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style><script>var x="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu &amp; more</a></li></ul></nav><div class="cookie-notice">We use cookies, yes.</div>
<article><header><h1>Title   here</h1></header><p><b>First &eacute; block,<br>with a line. <p>Second <i>block</i>.</p><ul><li>One<li>Two</ul>
<div class="ad">Buy!</div><form>Name <input> please</form><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><div id="comments">Reader: hello</div><footer>&copy; me</footer></body></html>"""


TEXT = "Title here\n\nFirst é block, with a line.\n\nSecond block.\n\nOne\n\nTwo"


def test_article_without_the_rest():
    assert html_paths.main_text(PAGE) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<nav>only menu</nav>", ""),
    ("<p>a <!-- no --> b</p><p>c", "a b\n\nc"), ("<p title='a>b'>x</p>", "x"), ("<p>1 < 2 & 3", "1 < 2 & 3"), ("<script>never ends", ""),
    ("<p>cut &am", "cut &am"), ("<article><p>cut <a hre", "cut"), ('<p class="never closed>x</p>', "x"), ("<div hidden>x</div><p>y", "y")])
def test_odd_pages(page, text):
    assert html_paths.main_text(page) == text


def test_pages_without_an_article_use_ratios():
    links = "".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(30))
    body = "".join(f"<p>A sentence, with some words in it; number {i}. And another one, as long.</p>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2>{body}</div><div><span>short</span></div></body>"
    got = html_paths.main_text(page)
    assert got.startswith("Head\n\nA sentence") and "Link" not in got and got.count("\n\n") == 12 and "short" not in got


def _sentences(n, start=0):
    return "".join(f"<p>A sentence, with some words in it; number {i}. And another one, as long.</p>" for i in range(start, start + n))


MENU = "<div><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(9)) + "</ul></div>"


def test_text_outside_the_container_stays():
    got = html_paths.main_text(f"<body>{MENU}<div id=content><h1>Title</h1><div class=body>{_sentences(6)}</div></div>{MENU}")
    assert got.startswith("Title\n\nA sentence") and "Link" not in got and got.count("A sentence") == 6
    got = html_paths.main_text(f"<body>{MENU}<div id=content><div>{_sentences(13)}</div>{MENU}<div>{_sentences(7, 13)}</div></div>{MENU}")
    assert all(f"number {i}." in got for i in range(20)) and "Link" not in got


@pytest.mark.parametrize("attributes", ["class='content with-sidebar'", "class=no-sidebar", "class=has-banner", "class=elementor-widget-container", "role=dialog"])
def test_wrappers_are_no_boilerplate(attributes):
    side = "<div class=sidebar><p>Aside, as such.</p></div>"
    for body in (_sentences(6), f"<article>{_sentences(6)}</article>"):
        got = html_paths.main_text(f"<body>{MENU}<div {attributes}>{body}{side}</div>{MENU}")
        assert got.count("A sentence") == 6 and "Aside" not in got and "Link" not in got
        assert html_paths.main_text(f"<body><form action=/ method=post>{MENU}<div {attributes}>{body}{side}</div></form>") == got
    talk = "<div id=comments>" + "<p>Reader: I think, I do. And so on, and on, and on.</p>" * 20 + "</div>"
    got = html_paths.main_text(f"<body><div {attributes}>{_sentences(6)}{talk}</div>")
    assert got.count("A sentence") == 6 and "Reader" not in got


def _links(n):
    return "".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(n))


@pytest.mark.parametrize("links, sentences", [(30, 6), (60, 12), (200, 6), (9, 40)])
@pytest.mark.parametrize("frame", ["<body><div><ul>{}</ul></div><div>{}</div>", "<main><div><ul>{}</ul></div>{}</main>", "<article><div>{}</div><div>{}</div></article>"])
def test_no_number_of_links_moves_the_threshold(links, sentences, frame):
    got = html_paths.main_text(frame.format(_links(links), _sentences(sentences)))
    assert "Link" not in got and got.count("A sentence") == sentences


def test_a_teaser_is_not_the_article():
    got = html_paths.main_text(f"<body><article><h2>Teaser</h2><p>Short.</p></article><div>{_sentences(30)}</div>")
    assert got.count("A sentence") == 30
    got = html_paths.main_text(f"<body><article>{_sentences(6)}</article><article>{_sentences(5, 6)}</article><div>Powered by this and that, as ever.</div>")
    assert got.count("A sentence") == 11 and "Powered" not in got


def test_parts_of_articles_stay():
    got = html_paths.main_text(
        f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.<div class='side-effects'>{_sentences(3)}</div><section class=legal>{_sentences(2, 3)}</section>"
        f"<section id=related-work>{_sentences(2, 5)}</section><div class=reviews>{_sentences(2, 7)}</div><xmp>a <b> c</xmp><object><p>In an object, too.</object></article>")
    assert got.startswith("Let x=2 be.\n\n") and all(f"number {i}." in got for i in range(9)) and got.endswith("a <b> c\n\nIn an object, too.")
    assert "Reader" not in html_paths.main_text(f"<article>{_sentences(5)}<div class=related><ul><li><a href=/>Reader of this</a><li><a href=/>Reader of that</a></ul></div></article>")


def test_links_need_an_address_and_end():
    got = html_paths.main_text(f"<body><div><p><a name=x>Anchored text, and more of it. {_sentences(4)}</div><ul>{_links(9)}</ul>")
    assert got.startswith("Anchored") and got.count("A sentence") == 4 and "Link" not in got
    got = html_paths.main_text(f"<body><div><div><a href=/>open for ever</div>{_sentences(5)}</div>")
    assert got.count("A sentence") == 5


def plain_main(blocks):
    """The published steps over (path, text, linked) rows, for pages whose content has one parent: indices that stay."""
    import math
    paths = sorted({p for p, _, _ in blocks})
    own = {p: [b for b in blocks if b[0] == p] for p in paths}
    chars = {p: sum(len(t) for _, t, _ in own[p]) for p in paths}
    ratio = {p: (chars[p] / len(own[p]), sum(len(html_paths.PUNCTUATION.findall(t)) for _, t, _ in own[p]) / len(own[p]), 1 - sum(k for _, _, k in own[p]) / chars[p]) for p in paths}
    score = {}
    for p in paths:
        at = []
        for i, b in enumerate(blocks):
            if b[0] == p:
                near = [j for j in range(i - 2, i + 3) if 0 <= j < len(blocks)]
                w = [math.exp(-(j - i) ** 2 / 2) for j in near]
                smooth = [sum(x * ratio[blocks[j][0]][c] for x, j in zip(w, near)) / sum(w) for c in range(3)]
                at.append(math.log1p(smooth[0] * (smooth[1] + 1e-3) * (smooth[2] + 1e-3)))
        score[p] = sum(at) / len(at)
    weight = {p: chars[p] * ratio[p][2] for p in paths}
    mean = sum(weight[p] * score[p] for p in paths) / sum(weight.values())
    least = mean - 0.5 * math.sqrt(sum(weight[p] * (score[p] - mean) ** 2 for p in paths) / sum(weight.values())) - 1e-9
    return {p for p in paths if score[p] >= least}


def test_scores_against_a_plain_reading():
    import random
    r = random.Random(3)
    for _ in range(40):
        blocks = []
        for _ in range(r.randrange(3, 40)):
            path = r.choice([("body", "div", "p"), ("body", "div", "li"), ("body", "ul", "li"), ("body", "p")])
            text = " ".join(r.choices(["word", "more,", "long-winded", "x.", "y"], k=r.randrange(1, 30)))
            blocks.append((path, text, r.choice([0, 0, len(text), len(text) // 2])))
        if not any(len(t) > k for _, t, k in blocks):
            continue
        made = [html_paths.Block(tuple(range(len(p))), p, False, (), False, False, t, k) for p, t, k in blocks]
        scores, _, least = html_paths._scores(made)
        assert {p for p, x in scores.items() if x >= least} == plain_main(blocks)


def test_every_row_comes_back(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (1, "u", PAGE, "old")], "page_id long, url string, html string, text string")
    got = html_paths.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((r.page_id, r.n_chars) for r in got.collect()) == [(1, len(TEXT)), (1, len(TEXT)), (2, 0)]
    assert html_paths.extract(df.limit(0)).count() == 0


def test_whole_pages_of_the_tables(spark):
    """The test pages hold one article each, so cutting it out by hand must give the same words."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in html_paths.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        words = html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split()
        assert texts[r.page_id].split() == words
        unmarked = re.sub("(</?)article>", r"\1div>", r.html)    # nothing but the ratios tells the article
        assert html_paths.main_text(unmarked).split() == words


@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://A.Com", "a.com", ""), ("http://a.com?x=/y", "a.com", ""),
    ("https://a.COM:80/P/q?r#s", "a.com:80", "/P/q"), ("x://é.Ä/#", "é.Ä", "/"), ("a://b://c", "b:", "//c")])
def test_host_and_path(url, host, path):
    assert url_rules.host_and_path(url) == (host, path)


URLS = ["http://a.com/x", "http://example.com/en/1", "http://example.com/en", "http://m.example.com/en/", "https://www.example.com/en/?q", "http://a.www.example.com/en/",
        "http://net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://casino-win.example.org/a", "http://occasino.org/", "http://x.org/free_bets/", "http://xcom/",
        "http://free-bets.example.com/fr/", "http://internet/es/", "http://x.org/EN?pills", None, "", "nothing", "http://", "file:///casino", "x:///y?casino", "casino"]


def plain_verdict(url):
    host, path = url_rules.host_and_path(url)
    fit = [r for r in url_rules.HOST_RULES for h, p in [r.name.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fit:
        best = max(fit, key=lambda r: len(r.name))
        return best.name, best.verdict
    import re
    return None, "block" if any(re.search(r.pattern, (host + path).lower()) for r in url_rules.PATTERN_RULES) else "allow"


def test_candidates_lose_no_rule(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_rules.judge(df).collect()}
    assert got == {(i, *plain_verdict(u)) for i, u in enumerate(URLS * 2)}
    assert url_rules.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge(df, url_rules.HOST_RULES + url_rules.HOST_RULES[:1])


def test_joined_words_lose_no_rule(spark):
    urls = ["http://freebets.net/", "https://linkfarm.org", "http://a.org/cheappills/", "http://x.org/paydayloan?q", "http://x.org/free/bets", "http://spamfarms.org/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(df).collect()}
    assert got == {i: plain_verdict(u)[1] for i, u in enumerate(urls)} and [got[i] for i in range(6)] == ["block"] * 5 + ["allow"]
    three = url_rules.word_rule("one two three")
    forms = [f"http://x.org/one{a}two{b}three" for a in ("", "-") for b in ("", "-")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*forms, "http://x.org/one-two/", "http://x.org/onetwothrees"])], "page_id long, url string")
    assert {r.page_id for r in url_rules.judge(df, (three,)).collect() if r.verdict == "block"} == {0, 1, 2, 3}


def test_rules_without_tokens_run_everywhere(spark):
    df = spark.createDataFrame([(1, "http://a.org/--"), (2, "http://a.org/")], "page_id long, url string")
    got = url_rules.judge(df, (url_rules.Rule("dashes", "--", (), "block"),))
    assert {(r.page_id, r.verdict, r.matched) for r in got.collect()} == {(1, "block", "dashes"), (2, "allow", None)}
