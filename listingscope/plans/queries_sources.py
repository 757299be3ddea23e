"""Raw files: the driver's tables written as JSON and CSV into the shared folder and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.plans.registry import Tables, query
from listingscope.session import shared_folder
from listingscope.sources import raw


def _file(t: Tables, lines: DataFrame) -> str:
    """A folder of text files with the one column's lines."""
    path = f"{shared_folder(t.spark)}/raw-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _record(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])


@query("raw_listing_sets", """
WITH first AS (SELECT p_partkey, p_name, p_brand, p_size FROM part)
SELECT concat('P', p_partkey) AS product_id, '664' AS cartridge_type, p_name AS title, CAST(p_size AS VARCHAR) AS price FROM first WHERE p_size % 3 <> 1
UNION ALL SELECT concat('P', p_partkey), '664', p_name, '0' FROM first WHERE p_size % 3 = 2
UNION ALL SELECT concat('P', p_partkey), '667', p_brand, NULL FROM first WHERE p_size % 3 <> 0""")
def raw_listing_sets(t: Tables):
    """Listings of two types in the three wrappings, several files a type; A1, A5, K6."""
    size = F.col("p_size")
    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    one = _record(id=key, titulo=F.col("p_name"), preco=size.cast("string"))
    other = _record(id=key, titulo=F.col("p_name"), preco=F.lit("0"))
    part = t["part"]
    bare = _file(t, part.where("p_size % 3 = 0").select(F.to_json(one)))
    listed = _file(t, part.where("p_size % 3 = 2").select(F.to_json(_record(produtos=F.array(one, other)))))
    single = _file(t, part.where("p_size % 3 <> 0").select(F.to_json(_record(produto=_record(id=key, titulo=F.col("p_brand"))))))
    rows = raw.read_listing_sets(t.spark, {"664": [bare, listed], "667": single}, lines=True)
    return rows.select("product_id", "cartridge_type", F.col("titulo").alias("title"), F.col("preco").alias("price"))


@query("raw_first_in_source_order", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN concat('early ', c_name) ELSE c_name END AS nickname, c_nationkey AS transactions FROM customer WHERE c_custkey <> 0""")
def raw_first_in_source_order(t: Tables):
    """Seller files in which an id comes up to four times, in one record, in two records and in two files: the first in source order stays; A3, C2."""
    name, key = F.col("c_name"), F.col("c_custkey")

    def seller(nickname: Column) -> Column:
        return _record(id=key, nickname=nickname, seller_reputation=_record(transactions=_record(total=F.col("c_nationkey").cast("bigint"))))

    early = t["customer"].where("c_custkey % 4 = 0").select(
        F.to_json(_record(dados_vendedores=F.array(seller(F.concat(F.lit("early "), name)), seller(F.concat(F.lit("a "), name))))).alias("value"))
    # The second record of an id stands behind the first, at an earlier place inside its own list.
    first = _record(dados_vendedores=F.array(_record(id=F.lit(0).cast("bigint"), nickname=F.lit("none"), seller_reputation=F.lit(None)), seller(name)))
    again = _record(dados_vendedores=F.array(seller(F.concat(F.lit("a "), name))))
    late = t["customer"].select(F.explode(F.array(F.to_json(first), F.to_json(again))).alias("value"))
    found = raw.read_sellers(t.spark, [_file(t, early), _file(t, late)], lines=True)
    return found.select("id", "nickname", "transactions")


@query("raw_reviews", """
SELECT CAST(conv_id AS VARCHAR) AS product_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS review_no, turn % 5 + 1 AS rating, text, role = 'user' AS has_images FROM conversations""")
def raw_reviews(t: Tables):
    """Review bundles, one a product; A2."""
    review = F.struct((F.col("turn") % 5 + 1).alias("rating"), "text", (F.col("role") == "user").alias("has_images"))
    bundles = t["conversations"].groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", review.alias("r")))).alias("all"))
    lines = bundles.select(F.to_json(_record(product_id=F.col("conv_id").cast("string"), reviews=F.transform("all", lambda x: x["r"]))))
    rows = raw.exploded_reviews(raw.read_reviews(t.spark, _file(t, lines), lines=True))
    return rows.select("product_id", "review_no", "rating", "text", "has_images")


@query("raw_prices", """
SELECT p_name AS product, p_brand AS family, p_size + 0.25 AS suggested_price FROM part WHERE p_size % 4 > 0""")
def raw_prices(t: Tables):
    """Price lines with decimal commas; lines without a number are dropped; A7."""
    size = F.col("p_size").cast("string")
    price = F.when(F.col("p_size") % 4 > 0, F.concat(size, F.lit(",25"))).otherwise(F.lit("sob consulta"))
    path = f"{shared_folder(t.spark)}/prices-{uuid.uuid4().hex}"
    t["part"].select(F.col("p_name").alias("product"), F.col("p_brand").alias("family"), price.alias("price")).write.option("header", True).option("sep", ";").csv(path)
    return raw.read_prices(t.spark, path).select("product", "family", "suggested_price")
