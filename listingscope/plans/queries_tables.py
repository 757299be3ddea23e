"""Sources, cleaning, joins, features and scoring over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listingscope.functions import columns as C
from listingscope.functions import listing as L
from listingscope.functions import text as T
from listingscope.operators import dedupe, enrich, essential, images, reports, rules
from listingscope.plans.queries_pages import RECORD
from listingscope.plans.registry import FEATURES_SQL, LISTINGS_SQL, REPORT_SQL, SCORED_SQL, Tables, query, rounded, sql
from listingscope.session import shared_folder
from listingscope.sources import store
from listingscope.streaming import reuse

# ---------------------------------------------------------------- exports and the report table

BLANK_SQL = C.BLANK


@query("csv_export", f"""
SELECT doc_id, lang, n_chars, source, trim(regexp_replace(text, '{BLANK_SQL}+', ' ', 'g')) AS text FROM documents""")
def csv_export(t: Tables):
    return store.csv_safe(t["documents"])


NESTED_SQL = """
SELECT p_partkey AS product_id, CAST(coalesce(n, 0) AS INTEGER) AS n_all_reviews, CAST(coalesce(chars, 0) AS BIGINT) AS chars
FROM part LEFT JOIN (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) ON conv_id = p_partkey"""


@query("nested_review_listings", NESTED_SQL)
def nested_review_listings(t: Tables):
    """Every product with the array of its reviews, and what the arrays hold."""
    nested = enrich.nested_reviews(t["part"].select(F.col("p_partkey").alias("product_id")), t.reviews(), "product_id", "product_id",
                                   ["review_no", "text"])
    chars = F.aggregate("all_reviews", F.lit(0).cast("bigint"), lambda s, r: s + F.length(r["text"]))
    return nested.select("product_id", F.size("all_reviews").alias("n_all_reviews"), chars.alias("chars"))


@query("reviews_beside_listings", """
SELECT p_partkey AS product_id, coalesce(n, 0) AS n_all_reviews, turn AS review_no, text
FROM part LEFT JOIN conversations ON conv_id = p_partkey LEFT JOIN (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY 1) ON c = p_partkey""")
def reviews_beside_listings(t: Tables):
    """The same reviews at their own grain, one row each."""
    return enrich.listing_reviews(t["part"].select(F.col("p_partkey").alias("product_id")), t.reviews(), "product_id", "product_id", ["review_no", "text"])


@query("export_summary", """
SELECT count(*) AS products, count(n) AS with_reviews, count(*) - count(n) AS without_reviews, CAST(coalesce(sum(n), 0) AS BIGINT) AS reviews
FROM part LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ON conv_id = p_partkey""")
def export_summary(t: Tables):
    return store.export_summary(enrich.review_totals(t["part"].select(F.col("p_partkey").alias("product_id")), t.reviews(), "product_id", "product_id"))


@query("report_table", sql(SCORED_SQL, """
SELECT listing_id, seller_id, score, suspect, price,
       CASE WHEN score > 10 THEN NULL WHEN score <= 3 THEN 'low' WHEN score <= 6 THEN 'medium' WHEN score <= 8 THEN 'high' ELSE 'critical' END AS risk
FROM scored WHERE coalesce(used, 0) <> 1"""))
def report_table(t: Tables):
    """Loaded twice over on purpose: repeated ids keep their first row."""
    scored = t.scored().select("listing_id", "seller_id", "score", "suspect", "price", "used")
    twice = scored.withColumn("copy", F.lit(0)).unionByName(scored.withColumn("copy", F.lit(1)).withColumn("score", F.lit(0.0)))
    return reports.report_table(twice, ["copy"]).select("listing_id", "seller_id", "score", "suspect", "price", "risk")


@query("upsert", sql(LISTINGS_SQL, """
SELECT listing_id, seller_id, CASE WHEN official = 1 THEN price * 0.5 ELSE price END AS price, official FROM listings
UNION ALL SELECT -listing_id, seller_id, price, official FROM listings WHERE official = 1"""))
def upsert(t: Tables):
    """Official sellers' listings arrive again at half the price, and once more under a new id."""
    base = t.listings().select("listing_id", "seller_id", "price", "official")
    official = base.where("official = 1")
    again = official.withColumn("price", F.col("price") * 0.5)
    new = official.withColumn("listing_id", -F.col("listing_id"))
    return store.overlay(base, again.unionByName(new), "listing_id")


@query("point_lookup", "SELECT doc_id, text, lang FROM documents WHERE doc_id = 42")
def point_lookup(t: Tables):
    return t["documents"].select("doc_id", "text", "lang").where(F.col("doc_id") == 42)


@query("union_of_sources", """
SELECT kind, count(*) AS n, count(chars) AS with_chars, count(role) AS with_role FROM (
  SELECT 'document' AS kind, n_chars AS chars, NULL AS role FROM documents UNION ALL SELECT 'turn', NULL, role FROM conversations) GROUP BY kind""")
def union_of_sources(t: Tables):
    documents = t["documents"].select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("chars"))
    turns = t["conversations"].select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role")
    both = enrich.unify({"document": documents, "turn": turns})
    return both.groupBy(F.col("cartridge_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count("chars").alias("with_chars"), F.count("role").alias("with_role"))


# ---------------------------------------------------------------- projection helpers

@query("seller_name_fallback", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'Vendedor_Desconhecido'
  WHEN c_nationkey % 3 < 2 THEN concat('Vendedor_', c_custkey) ELSE c_name END AS seller_name FROM customer""")
def seller_name_fallback(t: Tables):
    nation, key = F.col("c_nationkey") % 3, F.col("c_custkey")
    name = F.when(nation == 0, F.lit(None)).when(nation == 1, "").otherwise(F.col("c_name"))
    known = F.when((nation == 0) & (key % 2 == 0), "").otherwise(key.cast("string"))
    return t["customer"].select("c_custkey", essential.seller_name(name, known).alias("seller_name"))


@query("rating_fallback", """
SELECT doc_id, coalesce(CAST(quality AS DOUBLE) + 4, CAST(n_chars % 5 AS DOUBLE)) AS rating FROM documents LEFT JOIN labels USING (doc_id)""")
def rating_fallback(t: Tables):
    """Through the projection of raw records: the payload's rate first, then the page's own."""
    joined = t["documents"].select("doc_id", "n_chars").join(t["labels"], "doc_id", "left")
    payload = F.when(F.col("quality").isNotNull(), F.named_struct(F.lit("rate"), F.col("quality").cast("double") + 4))
    record = F.to_json(F.named_struct(
        F.lit("id"), F.col("doc_id").cast("string"), F.lit("rating_estrelas"), (F.col("n_chars") % 5).cast("double"),
        F.lit("dados_brutos"), F.named_struct(F.lit("melidata"), F.named_struct(F.lit("reviews"), payload))))
    rows = joined.select(F.from_json(record, RECORD).alias("r")).select("r.*")
    return essential.essential(rows).select(F.col("listing_id").cast("bigint").alias("doc_id"), "rating")


@query("column_coverage", """
WITH d AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN '' ELSE lang END AS lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT count(*) AS total, count(doc_id) AS a, count(nullif(text, '')) AS b, count(nullif(lang, '')) AS c, count(quality) AS d, count(toxic) AS e FROM d)
SELECT col AS "column", filled, total, round(filled * 100e0 / total, 6) AS percent FROM (
  SELECT 'doc_id' AS col, a AS filled, total FROM s UNION ALL SELECT 'text', b, total FROM s UNION ALL SELECT 'lang', c, total FROM s
  UNION ALL SELECT 'quality', d, total FROM s UNION ALL SELECT 'toxic', e, total FROM s)""")
def column_coverage(t: Tables):
    lang = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    joined = t["documents"].select("doc_id", "text", lang.alias("lang")).join(t["labels"], "doc_id", "left")
    return rounded(enrich.coverage(joined), "percent")


ALTERNATIVES_SQL = """
alt AS (SELECT a.l_partkey * 100000 + a.l_suppkey AS listing_id, a.l_suppkey AS seller_id, b.l_suppkey AS other
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 AND a.l_linenumber > 1)"""


@query("alternative_shares", f"""
WITH {LISTINGS_SQL.strip()}, {ALTERNATIVES_SQL.strip()},
has AS (SELECT DISTINCT listing_id FROM alt)
SELECT count(*) AS listings, count(h.listing_id) AS with_alternatives, count(*) FILTER (WHERE status = 'gold') AS gold,
       round(count(h.listing_id) * 100e0 / count(*), 6) AS alternative_percent
FROM listings l LEFT JOIN has h USING (listing_id)""")
def alternative_shares(t: Tables):
    has = alternatives(t).select("listing_id").distinct().withColumn("has", F.lit(True))
    out = t.listings().join(has, "listing_id", "left").agg(
        F.count(F.lit(1)).alias("listings"), C.count_where(F.col("has")).alias("with_alternatives"),
        C.count_where(F.col("status") == "gold").alias("gold"))
    return rounded(out.withColumn("alternative_percent", C.share(F.col("with_alternatives"), F.col("listings")) * 100), "alternative_percent")


def alternatives(t: Tables):
    """(listing_id, seller_id, alt_sellers): the supplier of an order's first line is the alternative."""
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    first = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("other"))
    rest = lines.where("l_linenumber > 1")
    met = rest.join(first, "l_orderkey")
    return met.select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("listing_id"), F.col("l_suppkey").alias("seller_id"),
                      F.array(F.col("other").cast("string"), F.lit("x")).alias("alt_sellers"))


# ---------------------------------------------------------------- cleaning

ORDER = "l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"


@query("first_per_key", f"""
SELECT l_partkey, l_orderkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER}) AS n FROM lineitem) WHERE n = 1""")
def first_per_key(t: Tables):
    return dedupe.keep_first(t["lineitem"].select("l_partkey", *ORDER.split(", ")), ["l_partkey"], ORDER.split(", ")).select("l_partkey", "l_orderkey", "l_suppkey", "l_quantity")


@query("last_per_key", f"""
SELECT l_partkey, l_orderkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(c + " DESC" for c in ORDER.split(", "))}) AS n FROM lineitem) WHERE n = 1""")
def last_per_key(t: Tables):
    return dedupe.keep_last(t["lineitem"].select("l_partkey", *ORDER.split(", ")), ["l_partkey"], ORDER.split(", ")).select("l_partkey", "l_orderkey", "l_suppkey", "l_quantity")


@query("latest_row", "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_row(t: Tables):
    return dedupe.latest(t["events"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("first_n_per_term", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5""")
def first_n_per_term(t: Tables):
    return dedupe.first_n(t["events"], ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "value")


@query("typed_ids", """
SELECT p_partkey, CASE WHEN regexp_full_match(id, '[0-9]+') THEN TRY_CAST(id AS BIGINT) END AS seller_id FROM (
  SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN substr(p_brand, 7) ELSE concat('99999999999999999', substr(p_brand, 7), '00') END AS id FROM part)""")
def typed_ids(t: Tables):
    number = F.substring("p_brand", 7, 20)
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, number).otherwise(
        F.concat(F.lit("99999999999999999"), number, F.lit("00")))
    return dedupe.typed_key(t["part"].select("p_partkey", text.alias("seller_id")), "seller_id")


@query("without_used", sql(LISTINGS_SQL, """
SELECT CAST(used AS INTEGER) AS used, count(*) AS n FROM listings WHERE coalesce(used, 0) <> 1 GROUP BY used"""))
def without_used(t: Tables):
    return dedupe.without_used(t.listings()).groupBy("used").agg(F.count(F.lit(1)).alias("n"))


@query("known_sellers", """
SELECT c_mktsegment, count(*) AS n FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_custkey END AS seller_id FROM customer) WHERE seller_id IS NOT NULL GROUP BY 1""")
def known_sellers(t: Tables):
    rows = t["customer"].withColumn("seller_id", F.when(F.col("c_acctbal") > 0, F.col("c_custkey")))
    return dedupe.drop_missing_key(rows, "seller_id").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("fill_policy", """
SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 0) AS sentiment, coalesce(toxic, 0) AS fraud_hits, coalesce(image_reuse, 1) AS image_reuse,
       coalesce(community, -1) AS community
FROM documents LEFT JOIN (SELECT doc_id, quality, toxic, toxic + 5 AS image_reuse, quality AS community FROM labels) USING (doc_id)""")
def fill_policy(t: Tables):
    extra = t["labels"].select("doc_id", F.col("quality").cast("double").alias("sentiment"), F.col("toxic").alias("fraud_hits"),
                               (F.col("toxic") + 5).alias("image_reuse"), F.col("quality").alias("community"))
    return C.fill(t["documents"].select("doc_id").join(extra, "doc_id", "left"), C.MERGE_FILLS)


@query("codes_first_seen", """
SELECT code, term, place FROM (
  SELECT l_partkey AS code, l_linenumber AS term, l_orderkey AS place, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey) AS n
  FROM lineitem) WHERE n = 1""")
def codes_first_seen(t: Tables):
    rows = t["lineitem"].select(F.col("l_partkey").alias("code"), F.col("l_linenumber").alias("term"), F.col("l_orderkey").alias("place"))
    return dedupe.keep_first(rows, ["code"], ["term", "place"])


@query("dense_codes", "SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_name FROM part)")
def dense_codes(t: Tables):
    """Label encoding: classes in text order from 0."""
    from listingscope.operators.ridge import encoder

    return encoder(t["part"], "p_name").select(F.col("value").alias("p_name"), "code")


# ---------------------------------------------------------------- joins

@query("with_sellers", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, s_name AS nickname, CAST(floor(s_acctbal) AS BIGINT) AS transactions
FROM (SELECT *, CASE WHEN l_linenumber < 6 THEN l_suppkey END AS k FROM lineitem) LEFT JOIN supplier ON k = s_suppkey""")
def with_sellers(t: Tables):
    text = F.when(F.col("l_linenumber") < 6, F.col("l_suppkey").cast("string")).when(F.col("l_linenumber") == 6, "none")
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", text.alias("seller_id"))
    sellers = t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nickname"), F.floor("s_acctbal").alias("transactions"))
    return enrich.with_sellers(lines, sellers).drop("seller_id")


@query("review_counts", f"""
SELECT p_partkey AS product_id, coalesce(stars_1, 0) AS stars_1, coalesce(stars_2, 0) AS stars_2, coalesce(stars_3, 0) AS stars_3,
       coalesce(stars_4, 0) AS stars_4, coalesce(stars_5, 0) AS stars_5, coalesce(with_text, 0) AS with_text,
       coalesce(with_images, 0) AS with_images, coalesce(reviews, 0) AS reviews
FROM part LEFT JOIN (
  SELECT conv_id, count(*) FILTER (WHERE turn % 5 = 0) AS stars_1, count(*) FILTER (WHERE turn % 5 = 1) AS stars_2,
         count(*) FILTER (WHERE turn % 5 = 2) AS stars_3, count(*) FILTER (WHERE turn % 5 = 3) AS stars_4, count(*) FILTER (WHERE turn % 5 = 4) AS stars_5,
         count(*) FILTER (WHERE regexp_replace(text, '{BLANK_SQL}', '', 'g') <> '') AS with_text,
         count(*) FILTER (WHERE role = 'user') AS with_images, count(*) AS reviews
  FROM conversations GROUP BY conv_id) ON conv_id = p_partkey""")
def review_counts(t: Tables):
    products = t["part"].select(F.col("p_partkey").alias("product_id"))
    return enrich.with_review_counts(products, enrich.review_counts(t.reviews(), "product_id"), "product_id", "product_id")


@query("attribute_match_rate", """
SELECT count(*) AS listings, CAST(count(l.doc_id) AS BIGINT) AS matched, round(count(l.doc_id) * 1e0 / count(*), 6) AS rate
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def attribute_match_rate(t: Tables):
    """Each label is given twice; the first of a repeated id is the one joined."""
    labels = t["labels"].withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = enrich.with_attributes(t["documents"].select("doc_id", "lang"), labels, "doc_id", ["n"])
    return rounded(enrich.match_rate(joined), "rate")


HASHES_SQL = """
i AS (SELECT l_partkey * 100000 + l_suppkey AS listing_id, l_suppkey AS seller_id,
        CASE WHEN l_returnflag = 'A' AND l_discount = 0 THEN 'ERRO'
             ELSE concat(l_partkey, '-', CAST(l_quantity AS INTEGER), '-', CAST(round(l_discount * 100) AS INTEGER)) END AS image_hash FROM lineitem)"""


@query("merge_images", f"""
WITH {HASHES_SQL.strip()},
r AS (SELECT listing_id, CASE WHEN image_hash = 'ERRO' THEN 0 ELSE count(*) OVER (PARTITION BY image_hash) END AS reuse FROM i)
SELECT listing_id, max(reuse) AS image_reuse, count(*) AS n_images FROM r GROUP BY listing_id""")
def merge_images(t: Tables):
    hashed = images.with_reuse(t.images())
    return enrich.with_columns_of(t.listings().select("listing_id"), images.per_listing(hashed), "listing_id")


@query("image_owners", f"""
WITH {HASHES_SQL.strip()}, o AS (SELECT DISTINCT listing_id, seller_id FROM i)
SELECT image_hash, o.seller_id, count(*) AS n FROM i JOIN o USING (listing_id) GROUP BY 1, 2""")
def image_owners(t: Tables):
    owners = t.listings().select("listing_id", "seller_id")
    return t.images().drop("seller_id").join(owners, "listing_id").groupBy("image_hash", "seller_id").agg(F.count(F.lit(1)).alias("n"))


@query("image_reuse_summary", f"""
WITH {HASHES_SQL.strip()}, c AS (SELECT image_hash, count(*) AS n FROM i WHERE image_hash <> 'ERRO' GROUP BY 1)
SELECT count(*) AS hashes, count(*) FILTER (WHERE n > 1) AS reused, max(n) AS top FROM c""")
def image_reuse_summary(t: Tables):
    return images.reuse_summary(t.images())


@query("most_reused_images", f"""
WITH {HASHES_SQL.strip()}, c AS (SELECT image_hash, count(*) AS image_reuse FROM i WHERE image_hash <> 'ERRO' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
d AS (SELECT image_hash, list_sort(list(DISTINCT CAST(listing_id AS VARCHAR))) AS ids FROM i GROUP BY 1)
SELECT image_hash, image_reuse, ids[1] AS sample_1, ids[2] AS sample_2, ids[3] AS sample_3 FROM c JOIN d USING (image_hash)""")
def most_reused_images(t: Tables):
    return images.most_reused(t.images(), "listing_id")


@query("image_reuse_bands", f"""
WITH {HASHES_SQL.strip()}, r AS (SELECT CASE WHEN image_hash = 'ERRO' THEN 0 ELSE count(*) OVER (PARTITION BY image_hash) END AS n FROM i)
SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS band, count(*) AS n FROM r GROUP BY 1""")
def image_reuse_bands(t: Tables):
    return images.reuse_bands(images.with_reuse(t.images()))


@query("download_status", """
SELECT CASE WHEN bad THEN 'error' WHEN img THEN 'ok' ELSE 'no url' END AS status, count(*) AS n
FROM (SELECT NOT contains(html, '</body>') OR NOT starts_with(url, 'https:') AS bad, contains(html, '<a ') AS img FROM pages) GROUP BY 1""")
def download_status(t: Tables):
    """A page that ends before its body does, or came over an unsafe address, is an error at any length."""
    broken = ~F.col("html").contains("</body>") | ~F.col("url").startswith("https:")
    status = F.when(broken, "error").when(F.col("html").contains("<a "), "ok").otherwise("no url")
    return images.download_summary(t["pages"].withColumn("status", status))


@query("image_file_names", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       CASE l_linenumber % 3 WHEN 0 THEN 'webp' WHEN 1 THEN 'png' ELSE 'jpg' END AS extension, concat('P', l_partkey) AS stem FROM lineitem""")
def image_file_names(t: Tables):
    """Addresses with the format in upper case, as an option or not at all."""
    line = F.col("l_linenumber") % 3
    url = F.concat(F.lit("https://img.example/"), F.col("l_partkey"), F.when(line == 0, "-O.WEBP").when(line == 1, "?f=png").otherwise(".gif"))
    extension = T.image_extension(url)
    name = F.concat(F.lit("images/P"), F.col("l_partkey"), F.lit("."), extension)
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                extension.alias("extension"), T.file_stem(name).alias("stem"))


@query("merge_vectors", "SELECT doc_id, lang, label, len(embedding) AS dim FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def merge_vectors(t: Tables):
    vectors = t["embeddings"].select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").alias("dim"))
    return t["documents"].select("doc_id", "lang").join(vectors, "doc_id", "left")


PRICES_SQL = """
prices AS (
  SELECT lower(replace(p_brand, 'Brand#', '')) AS fam, lower(p_name) AS prod, p_retailprice, p_partkey FROM part),
keyed AS (
  SELECT concat(fam, CASE WHEN contains(prod, 'xl') THEN 'xl' ELSE '' END, '_', CASE WHEN contains(prod, 'red') THEN 'preto' ELSE 'colorido' END) AS price_key,
         max_by(p_retailprice, p_partkey) AS unit_price FROM prices GROUP BY 1)"""


def _prices(t: Tables):
    """Parts as a price list: brand number as family, "red" products as the black ones."""
    rows = t["part"].select(F.replace("p_name", F.lit("red"), F.lit("preto")).alias("product"),
                            F.replace("p_brand", F.lit("Brand#"), F.lit("HP ")).alias("family"),
                            F.col("p_retailprice").alias("suggested_price"), F.col("p_partkey").alias("line_no"))
    return L.price_table(rows)


@query("price_keys", f"WITH {PRICES_SQL.strip()} SELECT price_key, unit_price FROM keyed")
def price_keys(t: Tables):
    return _prices(t)


@query("suggested_prices", f"""
WITH {PRICES_SQL.strip()},
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, replace(p_brand, 'Brand#', '') AS kind,
        CAST(l_linenumber % 2 AS INTEGER) AS black, CAST(l_linenumber % 3 > 0 AS INTEGER) AS colour,
        CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_quantity AS INTEGER) % 4 END AS qty FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT l.*, coalesce(qty, 1) AS u, b.unit_price AS pb, c.unit_price AS pc FROM l LEFT JOIN keyed b ON b.price_key = concat(kind, '_preto') LEFT JOIN keyed c ON c.price_key = concat(kind, '_colorido')),
s AS (SELECT *, CASE WHEN u = 1 THEN CASE WHEN black = 1 THEN pb ELSE pc END WHEN u = 2 AND black = 1 AND colour = 1 THEN pb + pc
   WHEN u > 1 AND black = 1 AND colour = 0 THEN pb * u WHEN u > 1 AND black = 0 AND colour = 1 THEN pc * u END AS sug FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, sug AS suggested_price,
       CASE WHEN sug > 0 THEN (l_extendedprice - sug) / sug END AS price_gap FROM s""")
def suggested_prices(t: Tables):
    part = t["part"].select(F.col("p_partkey").alias("l_partkey"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("cartridge_type"))
    line = F.col("l_linenumber")
    rows = t["lineitem"].join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "cartridge_type",
        F.struct((line % 2).alias("preto"), (line % 3 > 0).cast("int").alias("colorido")).alias("colours"),
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("int") % 4).alias("quantity"))
    priced = L.suggested_price(rows, _prices(t))
    gap = L.price_gap(F.col("l_extendedprice"), F.col("suggested_price")).alias("price_gap")
    return priced.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "suggested_price", gap)


# ---------------------------------------------------------------- features and rules

@query("reputation_numbers", """
SELECT s_suppkey, CASE s_nationkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 ELSE 0 END AS reputation,
       CAST(s_nationkey % 3 = 1 AS INTEGER) AS official, CAST(s_nationkey % 4 > 1 AS INTEGER) AS leader FROM supplier""")
def reputation_numbers(t: Tables):
    n = F.col("s_nationkey")
    level = C.lookup(n % 7, {1: "1_red", 2: "2_orange", 3: "3_yellow", 4: "4_light_green", 5: "5_green", 6: "newbie"})
    store_id = F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("s_suppkey").cast("string"))
    status = F.when(n % 4 == 0, "").when(n % 4 > 1, "gold")
    return t["supplier"].select("s_suppkey", L.reputation_number(level).alias("reputation"),
                                L.is_official(store_id).alias("official"), L.is_leader(status).alias("leader"))


@query("listing_features", sql(FEATURES_SQL, """
SELECT listing_id, price_gap, negative_share, round(weighted_rating, 6) AS weighted_rating, xl_mismatch, image_reuse FROM features"""))
def listing_features(t: Tables):
    return rounded(t.features(), "weighted_rating").select("listing_id", "price_gap", "negative_share", "weighted_rating", "xl_mismatch", "image_reuse")


@query("star_map_share", """
SELECT l_partkey, CASE WHEN n > 0 THEN CAST(coalesce(a, 0) + coalesce(b, 0) AS DOUBLE) / n ELSE 0 END AS negative_share FROM (
  SELECT l_partkey, nullif(count(*) FILTER (WHERE l_linenumber = 1), 0) AS a, nullif(count(*) FILTER (WHERE l_linenumber = 2), 0) AS b,
         count(*) FILTER (WHERE l_linenumber < 6) AS n FROM lineitem GROUP BY 1)""")
def star_map_share(t: Tables):
    """Star counts as a map with the stars nobody gave left out."""
    counts = [C.count_where(F.col("l_linenumber") == s).alias(f"s{s}") for s in range(1, 6)]
    rows = t["lineitem"].groupBy("l_partkey").agg(*counts)
    stars = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(f"{s}_estrelas").alias("k"), F.col(f"s{s}").alias("v")) for s in range(1, 6)]), lambda e: e["v"] > 0))
    total = sum(F.col(f"s{s}") for s in range(1, 6))
    return rows.select("l_partkey", L.negative_share(stars, total).alias("negative_share"))


@query("rule_scores", sql(SCORED_SQL, """
SELECT listing_id, score, suspect, flag_price_very_low, flag_price_medium_low, flag_price_slightly_low, flag_instant_fraud,
  0 AS flag_image_reuse_high, 0 AS flag_xl_mismatch,
  CASE WHEN score <= 1 THEN '0-1' WHEN score <= 2 THEN '1-2' WHEN score <= 3 THEN '2-3' WHEN score <= 4 THEN '3-4' WHEN score <= 5 THEN '4-5' ELSE '5-100' END AS band
FROM scored"""))
def rule_scores(t: Tables):
    return t.scored().select(
        "listing_id", "score", "suspect", "flag_price_very_low", "flag_price_medium_low", "flag_price_slightly_low", "flag_instant_fraud",
        "flag_image_reuse_high", "flag_xl_mismatch", rules.score_band(F.col("score")).alias("band"))


@query("rule_scores_documented", sql(SCORED_SQL, """
SELECT listing_id, CAST(r2 + CASE WHEN official = 1 AND r2 >= 2.0 THEN 1.0 ELSE 0 END + CASE WHEN price_gap < -0.30 THEN 8.0 ELSE 0 END AS DOUBLE) AS score,
  CAST(image_reuse BETWEEN 3 AND 10 AS INTEGER) AS flag_image_reuse_medium, CAST(reputation = 1 AS INTEGER) AS flag_reputation_very_bad,
  CAST(negative_share > 0.30 AS INTEGER) AS flag_reviews_very_negative, xl_mismatch AS flag_xl_mismatch, CAST(transactions < 50 AS INTEGER) AS flag_new_seller,
  CAST(official = 1 AND r2 >= 2.0 AS INTEGER) AS flag_official_suspect
FROM (SELECT *, running + xl_mismatch AS r2 FROM scored)"""))
def rule_scores_documented(t: Tables):
    return t.scored("as_documented").select(
        "listing_id", "score", "flag_image_reuse_medium", "flag_reputation_very_bad", "flag_reviews_very_negative", "flag_xl_mismatch",
        "flag_new_seller", "flag_official_suspect")


@query("rule_hits", sql(SCORED_SQL, """
SELECT rule, CAST(hits AS BIGINT) AS hits FROM (SELECT
  sum(CAST(price_gap < -0.30 AS INT)) AS price_very_low, sum(CAST(price_gap >= -0.30 AND price_gap < -0.15 AS INT)) AS price_medium_low,
  sum(CAST(price_gap >= -0.15 AND price_gap < -0.05 AS INT)) AS price_slightly_low,
  sum(CAST(image_reuse > 10 AS INT)) AS image_reuse_high, sum(CAST(image_reuse BETWEEN 3 AND 10 AS INT)) AS image_reuse_medium,
  sum(CAST(reputation = 1 AS INT)) AS reputation_very_bad, sum(CAST(reputation = 2 AS INT)) AS reputation_bad,
  sum(CAST(negative_share > 0.30 AS INT)) AS reviews_very_negative, sum(CAST(negative_share BETWEEN 0.15 AND 0.30 AS INT)) AS reviews_negative,
  sum(xl_mismatch) AS xl_mismatch, sum(CAST(transactions < 50 AS INT)) AS new_seller,
  sum(CAST(official = 1 AND running + xl_mismatch >= 2.0 AS INT)) AS official_suspect, sum(CAST(price_gap < -0.30 AS INT)) AS instant_fraud
  FROM scored) UNPIVOT (hits FOR rule IN (price_very_low, price_medium_low, price_slightly_low, image_reuse_high, image_reuse_medium, reputation_very_bad,
  reputation_bad, reviews_very_negative, reviews_negative, xl_mismatch, new_seller, official_suspect, instant_fraud))"""))
def rule_hits(t: Tables):
    return rules.rule_hits(t.features())


@query("risk_and_hybrid", sql(REPORT_SQL, """
SELECT listing_id, risk, coalesce(risk, 'critical') AS open_risk, hybrid, CASE suspect WHEN 1 THEN 'suspect' ELSE 'legitimate' END AS label FROM report"""))
def risk_and_hybrid(t: Tables):
    return t.report().select("listing_id", "risk", rules.risk_category(F.col("score"), open_ended=True).alias("open_risk"), "hybrid",
                             rules.class_label(F.col("suspect")).alias("label"))


@query("flag_titles", """
SELECT p_partkey, array_to_string(list_transform(string_split(concat(lower(p_type), ' ', p_name), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS label FROM part""")
def flag_titles(t: Tables):
    name = F.concat(F.lit("flag_"), F.lower("p_type"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return t["part"].select("p_partkey", rules.flag_title(name).alias("label"))


# ---------------------------------------------------------------- stream

@query("streamed_reuse", sql("""
shown AS (
  SELECT l_orderkey AS listing_id, l_shipdate AS t,
    CASE WHEN l_returnflag = 'A' AND l_discount = 0 THEN 'ERRO' ELSE concat(l_partkey, '-', CAST(l_quantity AS INTEGER) % 5) END AS image FROM lineitem WHERE l_shipdate IS NOT NULL),
last AS (SELECT listing_id, image AS image_hash FROM shown QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY t DESC, image DESC) = 1)""",
    "SELECT listing_id, image_hash, CASE WHEN image_hash = 'ERRO' THEN 0 ELSE count(*) OVER (PARTITION BY image_hash) END AS image_reuse FROM last"))
def streamed_reuse(t: Tables):
    """Order lines arrive in three batches as the changing images of their order; an order counts for its newest image only."""
    failed = (F.col("l_returnflag") == "A") & (F.col("l_discount") == 0)
    rows = t["lineitem"].select(
        F.col("l_orderkey").alias("listing_id"), F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.when(failed, "ERRO").otherwise(F.concat_ws("-", "l_partkey", F.col("l_quantity").cast("int") % 5)).alias("image_hash"), (F.col("l_linenumber") % 3).alias("part"))
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    for part in range(3):
        slim = rows.where(F.col("part") == part).drop("part")
        slim.write.mode("append").parquet(f"{folder}/in")
        arriving = t.spark.readStream.schema(slim.schema).parquet(f"{folder}/in")
        reuse.start(t.spark, arriving, f"{folder}/out", lambda scored: scored, f"{folder}/check").awaitTermination()
    return reuse.scored_table(t.spark, f"{folder}/out").read().select("listing_id", "image_hash", "image_reuse")


@query("stored_upserts", """
SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 5 = 0 THEN 'late' WHEN o_orderkey % 3 = 0 THEN 'second' ELSE o_orderstatus END AS state,
  CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS ingested_at FROM orders""")
def stored_upserts(t: Tables):
    """Orders written as a table, replaced in part, folded into a new base, replaced again and read; a batch that comes twice changes nothing."""
    key = F.col("o_orderkey")
    rows = t["orders"].select(key.alias("listing_id"), F.col("o_orderstatus").alias("state"), F.lit(1).alias("ingested_at"))
    table = store.ListingStore(t.spark, f"{shared_folder(t.spark)}/table-{uuid.uuid4().hex}")
    table.upsert(rows, "a")
    second = rows.where("listing_id % 3 = 0").withColumns({"state": F.lit("second"), "ingested_at": F.lit(2)})
    table.upsert(second.unionByName(second.withColumns({"state": F.lit("older"), "ingested_at": F.lit(0)})), "b")
    table.compact()
    for _ in range(2):
        table.upsert(rows.where("listing_id % 5 = 0").withColumns({"state": F.lit("late"), "ingested_at": F.lit(3)}), "c")
    return table.read()
