"""Review text, attributes, vectors, page addresses and stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingscope.functions import columns as C
from listingscope.functions import pages as P
from listingscope.functions import text as T
from listingscope.functions import urls as U
from listingscope.operators import enrich, keywords
from listingscope.plans.registry import Tables, query, rounded

STRIP = f"regexp_replace(text, '^{C.BLANK}+|{C.BLANK}+$', '', 'g')"
# Frequent syllables of the invented prose stand in for the two word lists.
FRAUD, PERFORMANCE = ("the", "der d", "a."), ("que", "tion", "ou ou")


def _hits(words, text: str = "lower(text)") -> str:
    """Non-overlapping occurrences in SQL: how much shorter the text gets without the word."""
    return " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words)


TEXTS_SQL = f"texts AS (SELECT conv_id AS product_id, turn, {STRIP} AS text FROM conversations WHERE length({STRIP}) > 0)"


@query("review_texts", f"WITH {TEXTS_SQL} SELECT product_id, turn AS review_no, text FROM texts")
def review_texts(t: Tables):
    return T.usable_reviews(t.reviews(), "product_id").select("product_id", "review_no", "text")


@query("keyword_hits", f"""
WITH {TEXTS_SQL} SELECT product_id, count(*) AS n_texts, CAST(sum({_hits(FRAUD)}) AS BIGINT) AS fraud_hits, CAST(sum({_hits(PERFORMANCE)}) AS BIGINT) AS performance_hits,
  1 AS has_review_text FROM texts GROUP BY product_id""")
def keyword_hits(t: Tables):
    found = T.review_features(t.reviews(), "product_id", fraud_words=FRAUD, performance_words=PERFORMANCE)
    return found.select("product_id", "n_texts", "fraud_hits", "performance_hits", "has_review_text")


@query("document_keyword_hits", f"SELECT doc_id, {_hits(FRAUD)} AS fraud_hits, {_hits(PERFORMANCE)} AS performance_hits FROM documents")
def document_keyword_hits(t: Tables):
    return t["documents"].select("doc_id", T.word_hits(F.col("text"), FRAUD).cast("bigint").alias("fraud_hits"),
                                 T.word_hits(F.col("text"), PERFORMANCE).cast("bigint").alias("performance_hits"))


@query("keyword_table_hits", """
WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM benchmark),
listed AS (SELECT word, CAST(len(word) % 3 AS INTEGER) AS list FROM words WHERE word <> ''),
hits AS (SELECT doc_id, list, (len(lower(text)) - len(replace(lower(text), word, ''))) // len(word) AS n FROM documents, listed)
SELECT doc_id, list, CAST(sum(n) AS BIGINT) AS hits FROM hits GROUP BY doc_id, list HAVING sum(n) > 0""")
def keyword_table_hits(t: Tables):
    """Every word of the benchmark, in three lists, searched in every document at once."""
    words = t["benchmark"].select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).withColumn("list", F.length("word") % 3)
    return keywords.keyword_hits(t["documents"], words, ["doc_id"])


@query("mean_sentiment", f"""
WITH {TEXTS_SQL},
words AS (SELECT product_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM texts),
lex AS (SELECT * FROM (VALUES ('the', 1.5e0), ('that', -1.0e0), ('der', 2.0e0), ('que', -2.5e0), ('le', 0.5e0)) v(word, valence)),
s AS (SELECT product_id, turn, sum(valence) AS s FROM words JOIN lex USING (word) GROUP BY 1, 2)
SELECT product_id, round(sum(coalesce(s / sqrt(s * s + 15), 0)) / count(*), 6) AS sentiment FROM texts LEFT JOIN s USING (product_id, turn) GROUP BY 1""")
def mean_sentiment(t: Tables):
    lexicon = t.spark.createDataFrame([("the", 1.5), ("that", -1.0), ("der", 2.0), ("que", -2.5), ("le", 0.5)], "word string, valence double")
    texts = T.usable_reviews(t.reviews(), "product_id")
    return rounded(T.mean_sentiment(texts, "product_id", lexicon), "sentiment")


@query("merge_text_features", f"""
WITH {TEXTS_SQL}, f AS (SELECT product_id, count(*) AS n_texts, CAST(sum({_hits(FRAUD)}) AS BIGINT) AS fraud_hits FROM texts GROUP BY 1)
SELECT p_partkey AS product_id, coalesce(n_texts, 0) AS n_texts, coalesce(fraud_hits, 0) AS fraud_hits, CAST(n_texts IS NOT NULL AS INTEGER) AS has_review_text
FROM part LEFT JOIN f ON product_id = p_partkey""")
def merge_text_features(t: Tables):
    found = T.review_features(t.reviews(), "product_id", fraud_words=FRAUD).select("product_id", "n_texts", "fraud_hits", "has_review_text")
    return enrich.with_columns_of(t["part"].select(F.col("p_partkey").alias("product_id")), found, "product_id")


TITLE_SQL = """
titles AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_quantity AS INTEGER) AS q,
  CASE l_partkey % 4 WHEN 0 THEN '662' WHEN 1 THEN '664XL' WHEN 2 THEN '667 xl' ELSE 'F6V29AB' END AS model, l_suppkey % 3 AS tint, l_linenumber % 4 AS shape FROM lineitem)"""


def _titles(t: Tables):
    """Listing titles with the model as number, XL or code, one, both or no colour and four ways to say how many."""
    model = F.element_at(F.array(*map(F.lit, ("662", "664XL", "667 xl", "F6V29AB"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    tint = F.element_at(F.array(*map(F.lit, ("preto", "preto e colorido", ""))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    q = F.col("l_quantity").cast("int").cast("string")
    shape = F.col("l_linenumber") % 4
    head = F.when(shape == 0, F.concat(F.lit("Kit com "), q)).when(shape == 1, F.concat(q, F.lit("x "))).when(
        shape == 2, F.concat(q, F.lit(" unidades"))).otherwise("Cartucho usado")
    return t["lineitem"].withColumn("title", F.concat_ws(" ", head, F.lit("cartucho"), model, tint))


@query("title_attributes", f"""
WITH {TITLE_SQL.strip()},
a AS (SELECT *, CASE l_partkey % 4 WHEN 0 THEN '662' WHEN 1 THEN '664xl' WHEN 2 THEN '667xl' ELSE '664' END AS cartridge_type,
  1 AS preto, CAST(tint = 1 AS INTEGER) AS colorido, CASE WHEN shape = 3 THEN 1 ELSE q END AS n FROM titles)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cartridge_type, preto, colorido, greatest(n, CASE WHEN colorido = 1 THEN 2 ELSE 1 END) AS quantity,
  CAST(shape = 3 AS INTEGER) AS used FROM a""")
def title_attributes(t: Tables):
    read = _titles(t).withColumn("a", T.attributes(F.col("title")))
    return read.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "a.cartridge_type", "a.colours.preto", "a.colours.colorido", "a.quantity", "a.used")


@query("attribute_summary", f"""
WITH {TITLE_SQL.strip()}
SELECT CASE l_partkey % 4 WHEN 0 THEN '662' WHEN 1 THEN '664xl' WHEN 2 THEN '667xl' ELSE '664' END AS cartridge_type, count(*) AS listings, count(*) AS black,
  count(*) FILTER (WHERE tint = 1) AS colour, count(*) FILTER (WHERE shape = 3) AS used FROM titles GROUP BY 1""")
def attribute_summary(t: Tables):
    return T.attribute_summary(_titles(t).withColumn("a", T.attributes(F.col("title"))).select("a.*"))


@query("validated_attributes", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'desconhecido' ELSE trim(string_split(trim(lower(p_brand || ',' || p_name)), ',')[1]) END AS cartridge_type,
  CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN 1 ELSE p_size % 2 END AS preto,
  CASE WHEN p_size % 7 = 0 THEN 0 ELSE CAST(p_size % 3 = 0 AS INTEGER) END AS colorido,
  CASE WHEN p_size % 7 = 0 THEN 1 ELSE greatest(p_size % 5 - 1, CASE WHEN p_size % 2 = 1 AND p_size % 3 = 0 THEN 2 ELSE 1 END) END AS quantity FROM part""")
def validated_attributes(t: Tables):
    size = F.col("p_size")
    kind = F.when(size % 7 != 0, F.concat("p_brand", F.lit(","), "p_name"))
    a = T.validated(kind, size % 2, (size % 3 == 0).cast("int"), size % 5 - 1, F.lit(0))
    return t["part"].withColumn("a", a).select("p_partkey", "a.cartridge_type", "a.colours.preto", "a.colours.colorido", "a.quantity")


@query("embedding_inputs", f"""
WITH whole AS (SELECT doc_id, {STRIP} AS whole FROM documents),
numbered AS (SELECT doc_id, whole, unnest(range(0, greatest(CAST(ceil(length(whole) / 8000.0) AS BIGINT), 1))) AS piece_no FROM whole)
SELECT doc_id, CAST(piece_no AS INTEGER) AS piece_no, substr(whole, piece_no * 8000 + 1, 8000) AS text FROM numbered""")
def embedding_inputs(t: Tables):
    return T.embedding_pieces(t["documents"].select("doc_id", "text"))


@query("parsed_vectors", """
SELECT vec_id, CASE WHEN label % 4 < 2 THEN 64 END AS dim, CASE WHEN label % 4 = 0 THEN 0 WHEN label % 4 = 1 THEN 1 END AS zero FROM embeddings""")
def parsed_vectors(t: Tables):
    """Vectors as JSON text: whole, cut short, and absent."""
    kind = F.col("label") % 4
    whole = F.to_json("embedding")
    text = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("[1.0,"), F.substring(whole, 2, 40))).otherwise(F.lit(None))
    parsed = t["embeddings"].select("vec_id", T.parse_vector(text, 64).alias("v"))
    return parsed.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dim"), T.is_zero_vector(F.col("v")).cast("int").alias("zero"))


# ---------------------------------------------------------------- addresses

LINKS_SQL = """
links AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber
  WHEN 1 THEN concat('https://produto.mercadolivre.com.br/MLB-', l_partkey + 1000000, '-cartucho#x') WHEN 2 THEN concat('https://www.mercadolivre.com.br/p/MLB', l_partkey + 1000000, '?a=1#b')
  WHEN 3 THEN concat('https://www.mercadolivre.com.br/x?item=MLB', l_partkey + 1000000) WHEN 4 THEN concat('https://loja.example/', l_partkey, '-cartucho')
  WHEN 5 THEN concat('www.mercadolivre.com.br/MLB', l_partkey + 1000000) WHEN 6 THEN '' END AS url FROM lineitem)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _links(t: Tables):
    """Order lines with the address forms met in listings, by line number."""
    big, part, n = (F.col("l_partkey") + 1000000).cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber")
    site = "https://www.mercadolivre.com.br"
    url = (F.when(n == 1, F.concat(F.lit("https://produto.mercadolivre.com.br/MLB-"), big, F.lit("-cartucho#x")))
           .when(n == 2, F.concat(F.lit(f"{site}/p/MLB"), big, F.lit("?a=1#b"))).when(n == 3, F.concat(F.lit(f"{site}/x?item=MLB"), big))
           .when(n == 4, F.concat(F.lit("https://loja.example/"), part, F.lit("-cartucho"))).when(n == 5, F.concat(F.lit("www.mercadolivre.com.br/MLB"), big))
           .when(n == 6, ""))
    return t["lineitem"].select(*KEYS, url.alias("url"))


@query("url_product_ids", f"""
WITH {LINKS_SQL.strip()} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN l_linenumber = 4 THEN concat('MLB', l_partkey) WHEN l_linenumber < 6 THEN concat('MLB', l_partkey + 1000000) END AS product_id,
  CASE WHEN l_linenumber <> 4 AND l_linenumber < 6 THEN concat('MLB', l_partkey + 1000000) END AS product_code,
  CASE WHEN l_linenumber <> 4 AND l_linenumber < 6 THEN concat('https://www.mercadolivre.com.br/p/MLB', l_partkey + 1000000) END AS product_url FROM links""")
def url_product_ids(t: Tables):
    code = U.product_code(F.col("url"))
    return _links(t).select(*KEYS, U.product_id(F.col("url")).alias("product_id"), code.alias("product_code"), U.product_url(code).alias("product_url"))


@query("url_checks", f"""
WITH {LINKS_SQL.strip()}, c AS (SELECT *, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN NOT contains(lower(url), 'mercadolivre.com.br') THEN 'wrong host'
  WHEN NOT starts_with(lower(url), 'http') THEN 'wrong scheme' ELSE 'ok' END AS reason FROM links)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, reason, CAST(reason = 'ok' AS INTEGER) AS valid,
  CASE WHEN url <> '' THEN string_split(string_split(url, '#')[1], '?')[1] END AS clean FROM c""")
def url_checks(t: Tables):
    rows = _links(t).withColumn("c", U.check_url(F.col("url")))
    return rows.select(*KEYS, "c.reason", F.col("c.valid").cast("int").alias("valid"), U.clean_url(F.col("url")).alias("clean"))


@query("clean_page_urls", "SELECT page_id, string_split(string_split(url, '#')[1], '?')[1] AS url FROM pages")
def clean_page_urls(t: Tables):
    return t["pages"].select("page_id", U.clean_url(F.col("url")).alias("url"))


# ---------------------------------------------------------------- stored pages

TITLE = ("trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'),"
         " '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))")


@query("page_titles", f"SELECT page_id, nullif({TITLE}, '') AS title FROM pages")
def page_titles(t: Tables):
    return t["pages"].select("page_id", P.page_title(F.col("html")).alias("title"))


@query("merged_pages", f"SELECT page_id, coalesce(nullif({TITLE}, ''), '') AS title, url AS link, '' AS price, 0 AS n_reviews FROM pages")
def merged_pages(t: Tables):
    """The test pages carry no embedded data, so title and address are what is left."""
    return P.merged_listing(t["pages"]).select("page_id", "title", "link", "price", "n_reviews")


@query("error_pages", f"""
SELECT page_id, CAST(contains(lower(url), 'error') OR contains(lower(url), 'not-found') OR contains(lower({TITLE}), 'página não encontrada')
  OR (contains(lower({TITLE}), 'erro') AND contains(lower({TITLE}), '404'))
  OR (NOT regexp_matches(html, '(?i)<h1[\\s>]|ui-pdp-|andes-card|ui-vip-core|class=["''][^"'']*product')
      AND regexp_matches(html, '(?i)class=["''][^"'']*(ui-empty-state|not-found-page|error-page)')) AS INTEGER) AS error FROM pages""")
def error_pages(t: Tables):
    return t["pages"].select("page_id", P.is_error_page(F.col("url"), F.col("html")).cast("int").alias("error"))


@query("result_links", """
WITH l AS (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) - 1 AS place FROM (
  SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*\\shref=["'']([^"'']*)["'']', 1) AS u FROM pages)),
c AS (SELECT regexp_extract(url, '/([A-Za-z]+)', 1) AS code, page_id % 5 AS term_no, page_id, place FROM l
  WHERE contains(url, '/') AND NOT contains(lower(url), 'click1') AND NOT contains(lower(url), 'noindex/catalog/reviews')),
v AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY term_no, page_id, place) AS n FROM c WHERE code <> '')
SELECT code, term_no, page_id, place FROM v WHERE n = 1""")
def result_links(t: Tables):
    """Links of the test pages with their first path word as the code."""
    pages = t["pages"].withColumn("term_no", F.col("page_id") % 5)
    return P.result_links(pages, "/", "/", ("click1", "noindex/catalog/reviews"), ("",), 1,
                          code=lambda url: F.nullif(F.regexp_extract(url, "/([A-Za-z]+)", 1), F.lit("")))


@query("star_estimates", """
SELECT l_partkey, CAST(floor(CAST(a AS DOUBLE) / n * 100 / 100 * n) AS INTEGER) AS one, CAST(trunc(CAST(b AS DOUBLE) / n * 100 / 100 * n) AS INTEGER) AS five FROM (
  SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 1) AS a, count(*) FILTER (WHERE l_linenumber = 5) AS b FROM lineitem GROUP BY 1)""")
def star_estimates(t: Tables):
    rows = t["lineitem"].groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), C.count_where(F.col("l_linenumber") == 1).alias("a"), C.count_where(F.col("l_linenumber") == 5).alias("b"))
    pct = lambda c: F.col(c).cast("double") / F.col("n") * 100
    return rows.select("l_partkey", P.star_estimate(pct("a"), F.col("n")).alias("one"), P.star_estimate(pct("b"), F.col("n")).alias("five"))


@query("star_distributions", """
WITH s AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 6) AS w FROM lineitem GROUP BY 1)
SELECT l_partkey, CAST(trunc(78e0 / 100 * n) AS INTEGER) AS five, CAST(trunc(CASE WHEN w = 0 THEN 6e0 ELSE w * 10e0 END / 100 * n) AS INTEGER) AS four,
  CAST(trunc(3e0 / 100 * n) AS INTEGER) AS three, CAST(trunc(2e0 / 100 * n) AS INTEGER) AS two, CAST(trunc(11e0 / 100 * n) AS INTEGER) AS one FROM s""")
def star_distributions(t: Tables):
    """Five levels of which only the second may show a width."""
    rows = t["lineitem"].groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), C.count_where(F.col("l_linenumber") == 6).alias("w"))
    level = lambda star, pct: F.struct(F.lit(star).alias("star"), pct.cast("double").alias("pct"))
    levels = F.array(*[level(s, F.col("w") * 10 if s == 4 else F.lit(0)) for s in (5, 4, 3, 2, 1)])
    stars = rows.select("l_partkey", P.star_distribution(levels, F.col("n")).alias("m"))
    names = ("one", "two", "three", "four", "five")
    return stars.select("l_partkey", *[F.try_element_at("m", F.lit(f"{i}_estrelas")).alias(n) for i, n in enumerate(names, 1)])


@query("sold_quantities", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber WHEN 1 THEN concat('+', q, 'mil') WHEN 2 THEN concat(q, '.000') WHEN 3 THEN concat('+', q, 'k')
  WHEN 4 THEN CAST(q AS VARCHAR) WHEN 5 THEN CAST(q AS VARCHAR) WHEN 6 THEN concat(q, 'mil') ELSE '' END AS sold FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""")
def sold_quantities(t: Tables):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = (F.when(n == 1, F.concat(F.lit("Novo | +"), q, F.lit("mil vendidos"))).when(n == 2, F.concat(F.lit("Mais de "), q, F.lit(".000 vendidos")))
            .when(n == 3, F.concat(F.lit("+"), q, F.lit("k SOLD"))).when(n == 4, F.concat(F.lit("Vendido "), q, F.lit(" vezes")))
            .when(n == 5, F.concat(q, F.lit(" unidades vendidas"))).when(n == 6, F.concat(F.lit("Usado | "), q, F.lit("mil vendido"))).otherwise("Novo"))
    return t["lineitem"].select(*KEYS, P.sold_quantity(text).alias("sold"))
