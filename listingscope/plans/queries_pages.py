"""Raw nested listings and stored pages, built from table columns and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingscope.functions import elements as E
from listingscope.functions import pages as P
from listingscope.operators import essential
from listingscope.plans.registry import Tables, query

# ---------------------------------------------------------------- nested listings

#: A listing record with every nested branch the projection reads.
RECORD = """struct<id: string, link: string, titulo: string, imagem_url: string, descricao: string, condicao: string, marca: string, modelo: string,
  reputation_level: string, power_seller_status: string, seller_id: string, preco: string, vendedor_nome: string, vendedor_total_transacoes: bigint,
  rating_estrelas: double, distribuicao_estrelas: map<string, int>,
  dados_brutos: struct<melidata: struct<catalog_product_id: string, official_store_id: string, logistic_type: string, reviews: struct<rate: double, count: int>,
    alternative_buying_options: array<struct<seller_id: string>>, shipping_promise: struct<address_options: array<struct<origins: array<struct<value: string>>>>>>>>"""


def raw_listings(t: Tables):
    """Parts as raw listing records: whole branches, fields and list items are missing by turns."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    alternatives = F.when(size % 2 == 1, F.array(
        F.named_struct(F.lit("seller_id"), size.cast("string")), F.named_struct(F.lit("seller_id"), F.lit("")), F.named_struct(F.lit("seller_id"), key)))
    origins = F.when(size % 7 > 0, F.array(F.named_struct(F.lit("value"), F.col("p_brand")))).otherwise(F.array())
    data = F.named_struct(
        F.lit("catalog_product_id"), F.when(size % 3 > 0, F.concat(F.lit("C"), key)), F.lit("official_store_id"), F.lit(""), F.lit("logistic_type"), F.col("p_type"),
        F.lit("reviews"), F.when(size % 4 > 0, F.named_struct(F.lit("rate"), size / 10, F.lit("count"), size)),
        F.lit("alternative_buying_options"), alternatives,
        F.lit("shipping_promise"), F.named_struct(F.lit("address_options"), F.array(F.named_struct(F.lit("origins"), origins))))
    record = F.to_json(F.named_struct(
        F.lit("id"), key, F.lit("titulo"), F.col("p_name"), F.lit("modelo"), F.lit(""), F.lit("marca"), F.col("p_brand"),
        F.lit("seller_id"), F.when(size % 6 == 0, F.lit("unknown")).otherwise(size.cast("string")),
        F.lit("preco"), F.when(size % 9 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")),
        F.lit("vendedor_nome"), F.when(size % 5 > 0, F.col("p_brand")).otherwise(F.lit("")),
        F.lit("vendedor_total_transacoes"), F.when(size % 2 == 0, size), F.lit("rating_estrelas"), size * 1.0,
        F.lit("dados_brutos"), F.when(size % 11 > 0, F.named_struct(F.lit("melidata"), data))))
    return t["part"].select(F.from_json(record, RECORD).alias("r")).select("r.*")


@query("essential_listings", """
SELECT CAST(p_partkey AS VARCHAR) AS listing_id, CASE WHEN p_size % 11 > 0 AND p_size % 3 > 0 THEN concat('C', p_partkey) END AS catalog_id, p_name AS title, p_brand AS brand,
  NULL AS model, CASE WHEN p_size % 6 > 0 THEN p_size END AS seller_id, CASE WHEN p_size % 9 > 0 THEN CAST(p_retailprice AS DOUBLE) END AS price,
  CASE WHEN p_size % 5 > 0 THEN p_brand WHEN p_size % 6 = 0 THEN 'Vendedor_unknown' ELSE concat('Vendedor_', p_size) END AS seller_name,
  CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS transactions,
  CASE WHEN p_size % 11 > 0 AND p_size % 4 > 0 THEN p_size / 10 ELSE p_size END AS rating, CASE WHEN p_size % 11 > 0 AND p_size % 4 > 0 THEN p_size ELSE 0 END AS n_reviews,
  CASE WHEN p_size % 11 > 0 AND p_size % 2 = 1 THEN concat(p_size, ',', p_partkey) ELSE '' END AS alt_sellers, CASE WHEN p_size % 11 > 0 AND p_size % 7 > 0 THEN p_brand END AS ship_origin FROM part""")
def essential_listings(t: Tables):
    rows = essential.essential(raw_listings(t))
    return rows.select("listing_id", "catalog_id", "title", "brand", "model", "seller_id", "price", "seller_name", "transactions", "rating", "n_reviews",
                       F.array_join("alt_sellers", ",").alias("alt_sellers"), "ship_origin")


# ---------------------------------------------------------------- embedded data and specifications

def _page_of(t: Tables):
    """Parts as stored product pages: JSON-LD on all, one or two events on some, more specification rows than any screen shows."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    ld = F.to_json(F.named_struct(
        F.lit("name"), F.col("p_name"), F.lit("sku"), F.concat(F.lit("S"), key), F.lit("offers"), F.named_struct(F.lit("price"), F.col("p_retailprice").cast("string")),
        F.lit("aggregateRating"), F.named_struct(F.lit("ratingValue"), F.lit("4.5"), F.lit("ratingCount"), size.cast("string"))))

    def event(*fields):
        return F.concat(F.lit('<script>melidata("add", "event_data", '), F.to_json(F.named_struct(*fields)), F.lit(");</script>"))

    first = event(F.lit("seller_id"), key, F.lit("price"), F.lit("1.5"), F.lit("seller_name"), F.col("p_brand"))
    second = event(F.lit("price"), size.cast("string"))
    field = F.transform(F.sequence(F.lit(1), size + 20), lambda i: F.concat(F.lit("<tr class='x'><th>Campo "), i.cast("string"), F.lit("</th><td><b>"), (i + size).cast("string"), F.lit("</b></td></tr>")))
    table = F.concat(F.lit("<table><tr><th>Modelo</th><td>old</td></tr>"), F.array_join(field, "\n"), F.lit("<tr><th>Marca</th><td>"), F.col("p_brand"),
                     F.lit("</td></tr><tr><th>MODELO</th><td>"), key, F.lit("</td></tr></table>"))
    html = F.concat(F.lit("<title>"), F.when(size % 3 > 0, F.col("p_name")).otherwise(F.lit("")), F.lit('</title><script type="application/ld+json">'), ld, F.lit("</script>"),
                    F.when(size % 2 == 0, first).otherwise(F.lit("")), F.when(size % 4 == 0, second).otherwise(F.lit("")), table)
    return t.spread("part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://x/"), key).alias("url"), html.alias("html"))


@query("embedded_pages", """
SELECT p_partkey AS page_id, concat('S', p_partkey) AS id, p_name AS title, concat('https://x/', p_partkey) AS link,
  CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 2 = 0 THEN '1.5' END AS event_price, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS seller_name,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS seller_id, 4.5e0 AS rating, p_size AS n_reviews FROM part""")
def embedded_pages(t: Tables):
    """Later events override earlier ones, events override JSON-LD, and the page's own title comes first."""
    return P.merged_listing(_page_of(t)).select("page_id", "id", "title", "link", "event_price", "seller_name", "seller_id", "rating", "n_reviews")


@query("page_specifications", """
SELECT p_partkey AS page_id, p_size + 23 AS n_rows, p_size + 22 AS n_names, CAST(2 * p_size + 20 AS VARCHAR) AS last_field, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS model FROM part""")
def page_specifications(t: Tables):
    """Every row counts, a repeated name keeps its last value."""
    rows = F.col("r")
    spec = _page_of(t).select("page_id", P.spec_rows(F.col("html")).alias("r")).select(
        "page_id", "r", P.spec_map(rows).alias("m"), P.spec_attributes(rows).alias("a"))
    last = F.try_element_at("m", F.concat(F.lit("campo "), (F.size("r") - 3).cast("string")))
    return spec.select("page_id", F.size("r").alias("n_rows"), F.size("m").alias("n_names"), last.alias("last_field"), "a.brand", "a.model")


# ---------------------------------------------------------------- review pages

@query("page_reviews", """
SELECT conv_id AS product_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS review_no, turn % 5 + 1 AS rating, turn AS likes,
  CASE WHEN trim(regexp_replace(translate(text, '<>&', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) = '' THEN 'Sem texto.'
    ELSE trim(regexp_replace(translate(text, '<>&', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) END AS text,
  turn % 3 = 0 AS has_images FROM conversations""")
def page_reviews(t: Tables):
    """Conversations as review pages of as many reviews as they have turns."""
    turn = F.col("turn")
    image = F.when(turn % 3 == 0, '<img class="andes-carousel-mobile__img" src="a.jpg">').otherwise("")
    article = F.concat(
        F.lit('<article class="ui-review-capability-comments__comment review-capability-comments__comment"><p class="andes-visually-hidden">'), (turn % 5 + 1).cast("string"),
        F.lit(' de 5</p><p class="ui-review-capability-comments__comment__content">'), F.translate("text", "<>&", ""), F.lit("</p>"), image,
        F.lit('<button data-testid="like-button"><p>'), turn.cast("string"), F.lit("</p></button></article>"))
    pages = t["conversations"].where(F.col("text").isNotNull()).groupBy(F.col("conv_id").alias("product_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", article.alias("a")))), lambda x: x["a"]), "\n").alias("html"))
    rows = P.review_rows(pages.withColumns({"title": F.lit(""), "url": F.lit("")}))
    return rows.select("product_id", "review_no", "rating", "likes", "text", "has_images")


# ---------------------------------------------------------------- nested pages, read by their elements

def _tidy(text):
    """Table text that can stand in a page as it is."""
    return F.trim(F.regexp_replace(F.translate(text, "<>&", ""), r"[ \t\n\x0B\f\r]+", " "))


TIDY = "trim(regexp_replace(translate({}, '<>&', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("nested_descriptions", """
SELECT p_partkey AS page_id, CASE WHEN p_size % 4 = 3 THEN '' WHEN p_size % 4 = 2 THEN concat('Code ', p_partkey) ELSE concat(p_name, ' ', p_brand, p_type, ' R$ ', p_size) END AS description,
  CASE WHEN p_size % 3 > 0 THEN concat(p_brand, ' ', p_type, ' ', p_size) END AS category FROM part""")
def nested_descriptions(t: Tables):
    """Descriptions in nested, unclosed and empty elements under four of the places where one may stand; categories as nested lists."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    body = F.concat(F.lit("<div><p>"), "p_name", F.lit("<p><b>"), "p_brand", F.lit("</b><i>"), "p_type", F.lit("</i><div>R$&nbsp;"), size.cast("string"), F.lit("</div>"))
    box = F.when(size % 4 == 0, F.concat(F.lit('<div class="x ui-pdp-description__content">'), body, F.lit("</div></div>"))).when(
        size % 4 == 1, F.concat(F.lit('<div class="ui-pdp-description__content"> <div></div></div><section data-testid=content>'), body, F.lit("</section>"))).when(
        size % 4 == 2, F.concat(F.lit('<span class="seo-description-box">Code <div>'), key, F.lit("</div></span>"))).otherwise("")
    trail = F.when(size % 3 > 0, F.concat(F.lit('<nav class="ui-search-breadcrumb"><ol><li><a href="/">'), "p_brand", F.lit("</a><li>"), "p_type", F.lit("<ul><li>"), size.cast("string"),
                                          F.lit("</ul></ol>"))).otherwise("")
    page = F.concat(F.lit("<html><body>"), trail, F.lit("</nav><main>"), box, F.lit("</main><footer>after</footer>"))
    pages = t.spread("part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return pages.select("page_id", P.description(F.col("html")).alias("description"), P.breadcrumb(F.col("html")).alias("category"))


@query("nested_reviews", f"""
SELECT conv_id AS product_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS review_no, turn % 5 + 1 AS rating, concat('day ', turn) AS date,
  CASE WHEN {TIDY.format('text')} = '' THEN concat('turn ', turn) ELSE concat({TIDY.format('text')}, ' turn ', turn) END AS text, turn AS likes, turn % 4 AS image_count,
  CASE WHEN turn % 4 > 0 THEN concat(turn, '-1.jpg') END AS first_image FROM conversations WHERE text IS NOT NULL""")
def nested_reviews(t: Tables):
    """Review pages whose texts, dates, likes and images stand in elements inside elements of the same name."""
    turn = F.col("turn").cast("string")
    images = F.array_join(F.transform(F.sequence(F.lit(0), F.col("turn") % 4), lambda i: F.when(i > 0, F.concat(
        F.lit('<div><img class="ui-review-capability-carousel-mobile__img" src="'), turn, F.lit("-"), i.cast("string"), F.lit('.jpg"></div>'))).otherwise("")), "")
    article = F.concat(
        F.lit('<article class="ui-review-capability-comments__comment"><div><p class="andes-visually-hidden">Nota '), (F.col("turn") % 5 + 1).cast("string"),
        F.lit(' de 5</p><span class="ui-review-capability-comments__comment__date"><span>day</span> '), turn,
        F.lit('</span></div><div class="ui-review-capability-comments__comment__content"><div>'), _tidy(F.col("text")), F.lit("</div><div>turn <div>"), turn,
        F.lit("</div></div></div>"), images, F.lit('<button data-testid="like-button"><p>likes</p><div><p><span>'), turn, F.lit("</span></p></div></button></article>"))
    pages = t["conversations"].where(F.col("text").isNotNull()).groupBy(F.col("conv_id").alias("product_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", article.alias("a")))), lambda x: x["a"]), "\n").alias("html"))
    rows = P.review_rows(pages.withColumns({"title": F.lit(""), "url": F.lit("")}))
    return rows.select("product_id", "review_no", "rating", "date", "text", "likes", "image_count", F.try_element_at("images", F.lit(1)).alias("first_image"))


@query("review_summaries", """
SELECT p_partkey AS page_id, p_size / 10 AS average_rating, p_size AS total_reviews, CASE WHEN p_size % 3 > 0 THEN concat(p_name, ' ', p_brand) END AS summary,
  CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END AS likes, p_size % 3 > 0 AS available, p_size % 6 AS n_characteristics, CASE WHEN p_size % 6 > 0 THEN p_size / 10 END AS first_value FROM part""")
def review_summaries(t: Tables):
    """Rating, summary and characteristics of review pages; without its like button a summary does not count."""
    size = F.col("p_size")
    text = size.cast("string")
    value = (size / 10).cast("string")
    button = F.when(size % 3 > 0, F.concat(F.lit('<div><button data-testid="like-button"><div><p><b>'), text, F.lit("</b></p></div></button></div>"))).otherwise("")
    rows = F.array_join(F.transform(F.sequence(F.lit(0), size % 6), lambda i: F.when(i > 0, F.concat(
        F.lit('<tr class="ui-review-capability-categories__mobile--row"><td><div>Kind <div>'), i.cast("string"), F.lit('</div></div><td><table><tr><td><p class="andes-visually-hidden">Nota '),
        value, F.lit(" de 5</p></table>"))).otherwise("")), "")
    page = F.concat(
        F.lit('<div class="ui-review-capability__rating__average"><span>'), value, F.lit('</span></div><p class="ui-review-capability__rating__label"><b>'), text, F.lit("</b> notas"),
        F.lit('<div data-testid="summary-component"><div><p class="ui-review-capability__summary__plain_text__summary_container">'), "p_name", F.lit(" <span><span>"), "p_brand",
        F.lit("</span></span></p></div>"), button, F.lit("</div><table>"), rows, F.lit("</table>"))
    found = t.spread("part").select(F.col("p_partkey").alias("page_id"), P.review_page_summary(page).alias("s"))
    marks = F.col("s.characteristics")
    return found.select("page_id", "s.average_rating", "s.total_reviews", "s.summary", "s.likes", "s.available", F.size(marks).alias("n_characteristics"),
                        F.try_element_at(marks, F.lit("Kind 1")).alias("first_value"))


@query("page_elements", r"""
WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>', '', 'g') AS h FROM pages),
tags AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM bare)
SELECT page_id, tag, count(*) AS n FROM tags GROUP BY page_id, tag""")
def page_elements(t: Tables):
    """How many elements of every tag the given pages hold."""
    found = E.element_table(t["pages"]).where(~F.col("tag").startswith("#") & ~F.col("tag").isin("script", "style"))
    return found.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
