"""Stored product and review pages to listing and review columns.

Everything is a column expression over ``html``, so a page table of any size is
one narrow scan. Flat values are matched by pattern; what may hold nested tags
(descriptions, reviews, summaries) is read from the page's elements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.functions import elements as E
from listingscope.functions.urls import SITE_PREFIXES, SKIPPED_LINKS, first_match, product_code
from listingscope.operators.dedupe import keep_first

JSON_LD = """name string, image string, brand string, sku string, description string,
    offers struct<price: string, availability: string>,
    aggregateRating struct<ratingValue: string, ratingCount: string>"""
EVENT = """catalog_product_id string, seller_id string, seller_name string, price string,
    free_shipping boolean, reputation_level string, power_seller_status string,
    reviews struct<rate: double, count: int>"""
JSON_LD_SCRIPT = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
EVENT_CALL = r"""(?s)melidata\("add", "event_data", (\{.*?\})\)"""


def inner_text(html: Column) -> Column:
    """Tags out, the common entities back, blanks tidy."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def text_of_class(html: Column, class_name: str, tag: str = r"\w+") -> Column:
    """Text of the first element of that class, up to its first closing tag."""
    pattern = rf"""(?is)<({tag})\b[^>]*class=["'][^"']*\b{class_name}\b[^"']*["'][^>]*>(.*?)</\1>"""
    hit = inner_text(F.regexp_extract(html, pattern, 2))
    return F.when(hit != "", hit)


def page_title(html: Column) -> Column:
    hit = inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(hit != "", hit)


def json_ld(html: Column) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(html, JSON_LD_SCRIPT, 1), F.lit("")), JSON_LD)


def event_payload(html: Column) -> Column:
    """All embedded events as one struct; for each field the last event that has it."""
    events = F.transform(F.regexp_extract_all(html, F.lit(EVENT_CALL), F.lit(1)), lambda e: F.from_json(e, EVENT))

    def last(found: Column, name: str) -> Column:
        values = F.filter(F.transform(found, lambda e: e[name]), lambda v: v.isNotNull())
        return F.try_element_at(values, F.lit(-1))

    names = ("catalog_product_id", "seller_id", "seller_name", "price", "free_shipping", "reputation_level", "power_seller_status", "reviews")
    return E.let(events, lambda found: F.struct(*[last(found, n).alias(n) for n in names]))


def merged_listing(pages: DataFrame) -> DataFrame:
    """Page fields by precedence: page title and address, then events, then JSON-LD."""
    html = F.col("html")
    parsed = pages.withColumn("_ld", json_ld(html)).withColumn("_ev", event_payload(html))
    blank = F.lit("")
    return parsed.select(
        "page_id",
        F.coalesce("_ev.catalog_product_id", "_ld.sku", blank).alias("id"),
        F.coalesce(page_title(html), F.col("_ld.name"), blank).alias("title"),
        F.coalesce("url", blank).alias("link"),
        F.coalesce("_ev.price", "_ld.offers.price", blank).alias("price"),
        F.col("_ev.price").alias("event_price"),
        F.coalesce("_ev.seller_name", blank).alias("seller_name"),
        F.coalesce("_ev.seller_id", blank).alias("seller_id"),
        F.coalesce("_ev.reputation_level", blank).alias("reputation_level"),
        F.coalesce("_ev.power_seller_status", blank).alias("power_status"),
        F.coalesce(F.col("_ev.reviews.rate"), F.col("_ld.aggregateRating.ratingValue").try_cast("double"), F.lit(0.0)).alias("rating"),
        F.coalesce(F.col("_ev.reviews.count"), F.col("_ld.aggregateRating.ratingCount").try_cast("int"), F.lit(0)).alias("n_reviews"),
        F.coalesce("_ld.image", blank).alias("image_url"),
        F.coalesce("_ld.brand", blank).alias("brand"),
        F.coalesce("_ld.description", blank).alias("description"),
        F.coalesce("_ld.offers.availability", blank).alias("availability"),
        F.coalesce("_ev.free_shipping", F.lit(False)).alias("free_shipping"),
    )


# Words in a specification's name and the attribute they feed.
SPEC_WORDS = (
    ("brand", ("marca",)),
    ("model", ("modelo",)),
    ("page_yield", ("rendimento", "páginas", "pagina")),
    ("line", ("linha",)),
    ("cartridge_type", ("tipo de cartucho",)),
    ("ink_colour", ("cor da tinta",)),
    ("volume", ("conteúdo total em volume",)),
    ("ink_type", ("tipo de tinta",)),
    ("refillable", ("recarregável",)),
)
# Pairs of words that also select an attribute.
SPEC_PAIRS = {"cartridge_type": ("tipo", "cartucho"), "ink_colour": ("cor", "tinta"), "volume": ("volume", "total")}
ALPHANUMERIC = "alfanumérico"


def spec_rows(html: Column) -> Column:
    """array<struct<name, value>> of all rows of the specification table."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    pairs = F.transform(rows, lambda r: F.struct(
        F.lower(inner_text(F.regexp_extract(r, r"(?is)<th[^>]*>(.*?)</th>", 1))).alias("name"),
        inner_text(F.regexp_extract(r, r"(?is)<td[^>]*>(.*?)</td>", 1)).alias("value"),
    ))
    return F.filter(pairs, lambda p: (F.length(p["name"]) > 1) & (p["value"] != ""))


def spec_map(rows: Column) -> Column:
    """name → value; a repeated name keeps its last value."""
    placed = F.sort_array(F.transform(rows, lambda r, i: F.struct(r["name"].alias("name"), i.alias("i"), r["value"].alias("value"))))
    return E.let(placed, lambda p: F.map_from_entries(F.transform(
        F.filter(p, lambda r, i: ~F.coalesce(F.get(p, i + 1)["name"] == r["name"], F.lit(False))), lambda r: F.struct(r["name"], r["value"]))))


def spec_attribute(name: Column) -> Column:
    """Which named attribute a specification feeds, by the first rule that fits."""
    out = F.when(name.contains("marca"), "brand")
    for attribute, words in SPEC_WORDS[1:]:
        test = F.lit(False)
        for w in words:
            test = test | name.contains(w)
        if attribute in SPEC_PAIRS:
            a, b = SPEC_PAIRS[attribute]
            test = test | (name.contains(a) & name.contains(b))
        if attribute == "model":
            out = out.when(test & ~name.contains(ALPHANUMERIC), "model").when(name.contains(ALPHANUMERIC), "model_code")
        else:
            out = out.when(test, attribute)
    return out


def spec_attributes(rows: Column) -> Column:
    """struct of the ten attributes, each from the last row that feeds it."""
    tagged = F.transform(rows, lambda r: F.struct(spec_attribute(r["name"]).alias("k"), r["value"].alias("v")))
    names = ["brand", "model", "model_code"] + [a for a, _ in SPEC_WORDS[2:]]

    def last(found: Column, name: str) -> Column:
        return F.try_element_at(F.filter(found, lambda t: t["k"] == name), F.lit(-1))["v"]

    return E.let(tagged, lambda found: F.struct(*[last(found, n).alias(n) for n in names]))


# Bar widths assumed by position when all five levels show none.
DEFAULT_STAR_PERCENTS = (78, 6, 3, 2, 11)


def star_estimate(pct: Column, total: Column) -> Column:
    """Reviews at a star level from its bar width, cut to a whole number."""
    return F.when(total > 0, (pct / 100 * total).cast("int")).otherwise(0)


def star_distribution(levels: Column, total: Column, defaults: Sequence[float] = DEFAULT_STAR_PERCENTS) -> Column:
    """map "n_estrelas" → count from array<struct<star int, pct double>> in page order."""
    five = F.size(levels) == 5
    by_place = F.array(*[F.lit(float(p)) for p in defaults])
    filled = F.transform(levels, lambda l, i: F.struct(
        F.concat(l["star"].cast("string"), F.lit("_estrelas")).alias("key"),
        star_estimate(F.when((F.coalesce(l["pct"], F.lit(0.0)) == 0) & five, F.get(by_place, i)).otherwise(F.coalesce(l["pct"], F.lit(0.0))), total).alias("value"),
    ))
    return F.map_from_entries(F.filter(filled, lambda e: e["key"].isNotNull()))


def star_levels(html: Column) -> Column:
    """array<struct<star, pct>> of the rating levels on a page."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*rating__level[^>]*>(.*?)</li>"), F.lit(1))
    return F.transform(items, lambda i: F.struct(
        F.regexp_extract(inner_text(i), r"([1-5])", 1).try_cast("int").alias("star"),
        F.regexp_extract(i, r"width:\s*([\d.]+)%", 1).try_cast("double").alias("pct"),
    ))


# Phrasings of "units sold".
SOLD_PATTERNS = (
    r"(?i)(\+?[\d.,]+(?:mil|k)?)\s*vendidos?",
    r"(?i)Mais de ([\d.,]+(?:mil|k)?)\s*vendidos?",
    r"(?i)([\d.,]+(?:mil|k)?)\s*vendidos?",
    r"(?i)(\+?[\d.,]+(?:mil|k)?)\s*sold",
    r"(?i)Vendido (\d+) vezes?",
    r"(?i)(\d+)\s*unidades?\s*vendidas?",
)


def sold_quantity(text: Column, patterns: Sequence[str] = SOLD_PATTERNS) -> Column:
    return F.coalesce(first_match(text, patterns), F.lit(""))


# Where a description may stand, in order of preference.
DESCRIPTION_PLACES = (
    E.of_class("ui-pdp-description__content"), E.with_attribute("data-testid", "content"), E.of_class("ui-pdp-description"), E.of_class("description"),
    E.class_holds("description"))


def description(html: Column) -> Column:
    """Text of the first place that has any; of several elements in one place the first counts."""
    return E.let(E.nodes(html), lambda nodes: F.coalesce(*[E.first_text(nodes, place) for place in DESCRIPTION_PLACES], F.lit("")))


def breadcrumb(html: Column) -> Column:
    return E.first_text(E.nodes(html), E.of_class("ui-search-breadcrumb"))


# Marks of an error page and of a product page.
ERROR_URL_MARKS = ("error", "not-found", "pagina-nao-encontrada")
ERROR_TITLE_MARKS = ("página não encontrada", "produto não encontrado")
PRODUCT_MARKS = r"(?i)<h1[\s>]|ui-pdp-|andes-card|ui-vip-core|data-testid=[\"']product-title|class=[\"'][^\"']*product"
ERROR_BOXES = r"(?i)class=[\"'][^\"']*(?:ui-empty-state|not-found-page|error-page)"


def is_error_page(url: Column, html: Column) -> Column:
    """Clear marks first; otherwise a page of any length without product marks but with an error box."""
    where = F.lower(url)
    title = F.lower(F.coalesce(page_title(html), F.lit("")))
    state = F.lower(F.coalesce(text_of_class(html, "ui-empty-state__title"), F.lit("")))
    clear = F.lit(False)
    for mark in ERROR_URL_MARKS:
        clear = clear | where.contains(mark)
    for mark in ERROR_TITLE_MARKS:
        clear = clear | title.contains(mark)
    clear = clear | (title.contains("erro") & title.contains("404"))
    clear = clear | state.contains("não encontrado") | state.contains("erro")
    clear = clear | (html.contains("ui-empty-state__icon") & ~F.lower(html).contains("produto"))
    bare = ~html.rlike(PRODUCT_MARKS) & html.rlike(ERROR_BOXES)
    return F.coalesce(clear | bare, F.lit(False))


LIKE_BUTTON = E.with_attribute("data-testid", "like-button", "button")
HIDDEN_TEXT = E.of_class("andes-visually-hidden", "p")


def review_rows(pages: DataFrame) -> DataFrame:
    """One row per review of a stored page, stamped with the page's product.

    Texts are whole, whatever tags they hold. A review without text says so, one without likes has 0.
    """
    articles = E.parts(E.nodes(F.col("html")), E.of_class("ui-review-capability-comments__comment", "article"))
    rows = pages.select("product_id", "title", "url", F.posexplode(articles).alias("_pos", "_r"))
    r = F.col("_r")
    sources = F.transform(F.filter(r, E.class_holds("carousel-mobile__img")), lambda x: E.attribute(x, "src"))
    images = F.filter(sources, lambda s: F.coalesce(s, F.lit("")) != "")
    likes = E.text_of(F.try_element_at(E.parts(E.first_part(r, LIKE_BUTTON), E.of_tag("p")), F.lit(-1)))
    return rows.select(
        "product_id", "title", "url",
        (F.col("_pos") + 1).alias("review_no"),
        F.regexp_extract(F.coalesce(E.first_text(r, HIDDEN_TEXT), F.lit("")), r"(\d+)", 1).try_cast("int").alias("rating"),
        E.first_text(r, E.of_class("ui-review-capability-comments__comment__date")).alias("date"),
        F.coalesce(E.first_text(r, E.of_class("ui-review-capability-comments__comment__content")), F.lit("Sem texto.")).alias("text"),
        F.coalesce(likes.try_cast("int"), F.lit(0)).alias("likes"),
        images.alias("images"),
        F.size(images).alias("image_count"),
        (F.size(images) > 0).alias("has_images"),
    )


def result_links(
    pages: DataFrame,
    host: str,
    direct_mark: str,
    skipped: Sequence[str] = SKIPPED_LINKS,
    prefixes: Sequence[str] = SITE_PREFIXES,
    min_length: int = 8,
    code=product_code,
) -> DataFrame:
    """Distinct product codes linked from result pages, at their first place.

    ``pages`` has ``(term_no, page_id, html)``; order is term, page, place.
    """
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a[^>]*\shref=["']([^"']*)["']"""), F.lit(1))
    links = pages.select("term_no", "page_id", F.posexplode(hrefs).alias("place", "url"))
    lowered = F.lower("url")
    allowed = F.col("url").contains(host) | F.col("url").contains(direct_mark)
    for part in skipped:
        allowed = allowed & ~lowered.contains(part)
    coded = links.where(allowed).withColumn("code", code(F.col("url")))
    known = F.lit(False)
    for p in prefixes:
        known = known | F.col("code").startswith(p)
    valid = coded.where(known & (F.length("code") >= min_length))
    return keep_first(valid.select("code", "term_no", "page_id", "place"), ["code"], ["term_no", "page_id", "place"])


def review_page_summary(html: Column) -> Column:
    """struct(average_rating, total_reviews, summary, likes, available, characteristics)."""
    return E.let(E.nodes(html), _review_summary)


def _review_summary(nodes: Column) -> Column:
    average = E.first_text(nodes, E.of_class("ui-review-capability__rating__average")).try_cast("double")
    label = F.coalesce(E.first_text(nodes, E.of_class("ui-review-capability__rating__label")), F.lit(""))
    found = E.let(E.first_part(nodes, E.with_attribute("data-testid", "summary-component", "div")), lambda box: F.struct(
        E.first_text(box, E.of_class("ui-review-capability__summary__plain_text__summary_container", "p")).alias("summary"),
        E.first_text(E.first_part(box, LIKE_BUTTON), E.of_tag("p")).try_cast("int").alias("likes")))
    rows = E.parts(nodes, lambda x: (x["tag"] == "tr") & E.class_holds("categories__mobile--row")(x))
    rated = F.transform(rows, lambda r: F.struct(
        E.first_text(r, E.of_tag("td")).alias("name"),
        F.regexp_extract(F.coalesce(E.first_text(r, HIDDEN_TEXT), F.lit("")), r"(\d+\.?\d*)", 1).try_cast("double").alias("value"),
    ))

    def summed(box: Column) -> Column:
        complete = box["summary"].isNotNull() & box["likes"].isNotNull()
        return F.struct(
            average.alias("average_rating"),
            F.regexp_extract(label, r"(\d+)", 1).try_cast("int").alias("total_reviews"),
            F.when(complete, box["summary"]).alias("summary"),
            F.when(complete, box["likes"]).otherwise(0).alias("likes"),
            complete.alias("available"),
            E.let(F.filter(rated, lambda x: x["name"].isNotNull() & x["value"].isNotNull()), spec_map).alias("characteristics"),
        )

    return E.let(found, summed)
