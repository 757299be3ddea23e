"""Stored pages with everything on them."""

from pyspark.sql import functions as F

from listingscope.functions import pages as P
from listingscope.functions import urls as U
from listingscope.plans import queries_pages
from listingscope.plans.registry import Tables

LD = """{"name": "Tinta", "image": "i.jpg", "brand": "B", "sku": "S1", "description": "d", "offers": {"price": 10.5, "availability": "in"},
 "aggregateRating": {"ratingValue": 4.5, "ratingCount": 20}}"""
PAGE = f"""<html><head><title>Tinta &amp; Cia</title><script type="application/ld+json">{LD}</script>
<script>melidata("add", "event_data", {{"seller_id": 77, "price": 9.9, "reviews": {{"rate": 4.8, "count": 30}}}});
melidata("add", "event_data", {{"seller_id": 78, "seller_name": "N", "free_shipping": true}})</script></head>
<body><h1>Tinta</h1><nav class="ui-search-breadcrumb"><b>Casa</b> Tintas</nav>
<p class="ui-pdp-description__content">Boa <b>tinta</b></p>
<table><tr><th>Marca</th><td>HP</td></tr><tr><th>Modelo alfanumérico</th><td>Z9</td></tr><tr><th>Modelo</th><td>664</td></tr>
<tr><th>Tipo de cartucho</th><td><span>Original</span></td></tr><tr><th>x</th><td>y</td></tr><tr><th>MARCA</th><td>HP2</td></tr></table>
<span class="ui-review-capability__rating__average">4.7</span><p class="ui-review-capability__rating__label">31 avaliações</p>
<div data-testid="summary-component"><p class="ui-review-capability__summary__plain_text__summary_container">Bom</p>
<button data-testid="like-button"><p>12</p></button></div>
<table><tr class="ui-review-capability-categories__mobile--row"><td>Qualidade</td><td><p class="andes-visually-hidden">Avaliação 4.8 de 5</p></td></tr></table>
<ul><li class="ui-review-capability-rating__level"><span>5</span><span style="width: 60%"></span></li>
<li class="ui-review-capability-rating__level"><span>1</span><span style="width: 15.5%"></span></li></ul>
<article class="ui-review-capability-comments__comment"><p class="andes-visually-hidden">Avaliação 4 de 5</p>
<span class="ui-review-capability-comments__comment__date">10 ago. 2025</span><p class="ui-review-capability-comments__comment__content">Muito <i>bom</i></p>
<img class="ui-review-capability-carousel-mobile__img" src="a.jpg"><button data-testid="like-button"><p>ok</p><p> 3 </p></button></article>
<article class="ui-review-capability-comments__comment"><p>nada</p></article></body></html>"""


def page(table, html=PAGE, url="https://x/p/MLB123456"):
    return table("page_id long, url string, html string, product_id string, title string", (1, url, html, "MLB1", "T"))


def one(table, column, html=PAGE):
    return page(table, html).select(column.alias("c")).first().c


def test_precedence_of_sources(table):  # J6, J7, J8
    r = P.merged_listing(page(table)).first()
    assert (r.id, r.title, r.price, r.seller_id, r.seller_name) == ("S1", "Tinta & Cia", "9.9", "78", "N")
    assert (r.rating, r.n_reviews, r.brand, r.availability, r.free_shipping) == (4.8, 30, "B", "in", True)
    bare = P.merged_listing(page(table, "<p>nothing</p>")).first()
    assert (bare.title, bare.price, bare.rating, bare.n_reviews, bare.free_shipping) == ("", "", 0.0, 0, False)


def test_specifications(table):  # J9
    rows = P.spec_rows(F.col("html"))
    m = one(table, P.spec_map(rows))
    assert m["marca"] == "HP2" and m["tipo de cartucho"] == "Original" and "x" not in m
    a = one(table, P.spec_attributes(rows))
    assert (a.brand, a.model, a.model_code, a.cartridge_type, a.volume) == ("HP2", "664", "Z9", "Original", None)
    many = "".join(f"<tr><th>k{i:02d}</th><td>{i}</td></tr>" for i in range(30))
    assert len(one(table, P.spec_map(rows), many)) == 30


def test_stars(table):  # J10
    assert one(table, P.star_distribution(P.star_levels(F.col("html")), F.lit(31))) == {"5_estrelas": 18, "1_estrelas": 4}


def test_description_and_breadcrumb(table):  # J12
    assert one(table, P.description(F.col("html"))) == "Boa tinta"
    assert one(table, P.breadcrumb(F.col("html"))) == "Casa Tintas"
    assert one(table, P.description(F.col("html")), "<p>x</p>") == ""


def test_reviews(table):  # J14
    first, second = P.review_rows(page(table)).orderBy("review_no").collect()
    assert (first.rating, first.date, first.text, first.likes, first.images, first.has_images) == (4, "10 ago. 2025", "Muito bom", 3, ["a.jpg"], True)
    assert (second.rating, second.text, second.likes, second.image_count, second.has_images, second.product_id) == (None, "Sem texto.", 0, 0, False, "MLB1")
    assert P.review_rows(page(table, PAGE * 40)).count() == 80


def test_review_page(table):  # J16
    r = one(table, P.review_page_summary(F.col("html")))
    assert (r.average_rating, r.total_reviews, r.summary, r.likes, r.available) == (4.7, 31, "Bom", 12, True)
    assert r.characteristics == {"Qualidade": 4.8}
    assert one(table, P.review_page_summary(F.col("html")), "<p></p>").available is False


def test_error_pages(table):  # J13
    cases = [("https://x/error", PAGE, 1), ("https://x/a", PAGE, 0), ("https://x/a", "<title>Produto não encontrado</title><h1>x</h1>", 1),
             ("https://x/a", "<div class='error-page'>x</div>", 1), ("https://x/a", "<div class='error-page'>x</div>" + "z" * 6000, 1),
             ("https://x/a", "<h3 class='ui-empty-state__title'>Item não encontrado</h3>", 1), ("https://x/a", "<p>tiny</p>", 0)]
    for url, html, want in cases:
        assert page(table, html, url).select(P.is_error_page(F.col("url"), F.col("html")).cast("int")).first()[0] == want


def test_result_links(table):  # J15, C9
    html = """<a class="x" href="https://produto.mercadolivre.com.br/MLB-123456-a">1</a><a href="https://click1.mercadolivre.com.br/MLB999999">2</a>
    <a href="https://www.mercadolivre.com.br/p/MLB123456">3</a><a href="https://www.mercadolivre.com.br/p/MLB12">4</a><a href="https://other/p/MLB777777">5</a>"""
    pages = table("term_no int, page_id int, html string", (2, 1, html), (1, 9, '<a href="/p/MLB777777">'))
    found = P.result_links(pages, U.HOST, "/p/MLB").orderBy("code").collect()
    assert [(r.code, r.term_no, r.place) for r in found] == [("MLB123456", 2, 0), ("MLB777777", 1, 0)]


def test_addresses(table):  # J1 to J5
    df = table("u string", ("https://produto.mercadolivre.com.br/MLB-4139079419-x#a?b",), ("https://x/p/MLB37141763?q",), ("ftp://mercadolivre.com.br",), (None,))
    assert [r[0] for r in df.select(U.product_id(F.col("u"))).collect()] == ["MLB4139079419", "MLB37141763", None, None]
    assert [r[0] for r in df.select(U.product_code(F.col("u"))).collect()] == ["MLB4139079419", "MLB37141763", None, None]
    assert [r[0].reason for r in df.select(U.check_url(F.col("u"))).collect()] == ["ok", "wrong host", "wrong scheme", "empty"]
    assert df.select(U.clean_url(F.col("u"))).first()[0] == "https://produto.mercadolivre.com.br/MLB-4139079419-x"


def test_specifications_are_read_once_a_page(table):  # J9
    """A name costs no further pass over the page: 4,000 rows, each name twice, in seconds."""
    import time
    page = "<table>" + "".join(f"<tr><th>Campo {i % 2000}</th><td>{i}</td></tr>" for i in range(4000)) + "</table>"
    start = time.time()
    found = one(table, P.spec_map(P.spec_rows(F.col("html"))), page)
    assert len(found) == 2000 and found["campo 7"] == "2007" and time.time() - start < 20


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_a_page_are_searched_once(table):  # F18, F24
    pages = table("page_id long, html string", (1, "<p>x</p>"))
    summary = plan_of(pages.select(P.review_page_summary(F.col("html")).alias("s")))
    assert summary.count("summary-component") == 1 and summary.count("rating__average") <= 2
    described = plan_of(pages.select(P.description(F.col("html")).alias("d")))
    assert described.count("data-testid") == 1
    # A class attribute is only split where it holds the name at all.
    assert described.count("split(") == 3 and described.count("Contains(") == 4


def test_embedded_data_is_read_in_one_pass(spark):  # F19
    plan = plan_of(queries_pages.embedded_pages(Tables(spark, "/root/testdata/sf0.001")))
    assert "Join" not in plan and plan.count("Relation") == 1
