"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[["Tables"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Means and ratios to six places: two engines add in different orders."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


class Tables:
    """The driver's tables in the roles of a listing market."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """Rows dealt over all cores: a file of short rows is one split, whatever long pages are made of them."""
        rows = self[name]
        return rows.repartition(max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def listings(self, lines: DataFrame | None = None) -> DataFrame:
        """One listing per (part, supplier); order lines, all or those given, are summed before the joins."""
        star = F.col("l_linenumber") % 5 + 1
        lines = (self["lineitem"] if lines is None else lines).groupBy("l_partkey", "l_suppkey").agg(
            F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.count(F.lit(1)).alias("n_reviews"),
            F.sum(F.when(star <= 2, 1).otherwise(0)).alias("neg_reviews"),
            F.min(star).cast("double").alias("rating"),
            (F.max("l_discount") * 10).alias("model_score"),
        )
        joined = lines.join(self["part"], F.col("l_partkey") == F.col("p_partkey")).join(
            self["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        nation, size = F.col("s_nationkey"), F.col("p_size") % 10
        return joined.select(
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("listing_id"),
            F.col("l_suppkey").alias("seller_id"), F.col("l_partkey").alias("catalog_id"),
            F.col("s_name").alias("seller_name"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"),
            "price", F.col("p_retailprice").alias("list_price"),
            (1 + nation % 5).cast("bigint").alias("reputation"),
            F.floor(F.col("s_acctbal") / 20).alias("transactions"),
            F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0).alias("official"),
            "n_reviews", "neg_reviews", "rating", "model_score",
            F.concat_ws("-", F.col("l_suppkey"), "p_brand", "p_type").alias("image_hash"),
            F.when(size == 0, 1).when(size != 1, 0).alias("used"),
            F.when(nation % 4 == 1, "silver").when(nation % 4 == 2, "gold").when(nation % 4 == 3, "platinum").alias("status"),
            F.when(nation == 0, -1).otherwise(nation).cast("bigint").alias("community"),
        )

    def features(self, seller: int | None = None) -> DataFrame:
        """Features of all listings, or of one seller's: then only order lines that show a picture of that seller are summed."""
        from listingscope.functions.columns import share
        from listingscope.functions.listing import price_gap, text_mismatch, weighted_rating
        from listingscope.operators.images import with_reuse

        if seller is None:
            rows = with_reuse(self.listings())
        else:
            own = self.listings(self["lineitem"].where(F.col("l_suppkey") == seller))
            part = self["part"].select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
            shown = self["lineitem"].join(part, "l_partkey").withColumn("image_hash", F.concat_ws("-", "l_suppkey", "p_brand", "p_type"))
            alike = shown.join(own.select("image_hash").distinct(), "image_hash", "left_semi").drop("image_hash", "p_brand", "p_type")
            rows = with_reuse(own, among=self.listings(alike))
        return rows.withColumns({
            "price_gap": price_gap(F.col("price"), F.col("list_price")),
            "negative_share": share(F.col("neg_reviews"), F.col("n_reviews")),
            "weighted_rating": weighted_rating(F.col("rating"), F.col("n_reviews")),
            "xl_mismatch": text_mismatch(F.col("title"), F.col("kind"), "large"),
        })

    def scored(self, mode: str = "as_coded", seller: int | None = None) -> DataFrame:
        from listingscope.operators.rules import score

        return score(self.features(seller), mode=mode)

    def report(self, seller: int | None = None) -> DataFrame:
        from listingscope.operators.dedupe import drop_missing_key, without_used
        from listingscope.operators.rules import hybrid_score, risk_category

        rows = without_used(drop_missing_key(self.scored(seller=seller), "seller_id"))
        return rows.withColumn("risk", risk_category(F.col("score"))).withColumn(
            "hybrid", hybrid_score(F.col("score"), F.col("model_score")))

    def images(self) -> DataFrame:
        """One image per order line; lines of one part, quantity and discount show the same picture.

        Returned lines without a discount are the images that could not be hashed.
        """
        shown = F.concat_ws("-", F.col("l_partkey"), F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"))
        failed = (F.col("l_returnflag") == "A") & (F.col("l_discount") == 0)
        return self["lineitem"].select(
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("listing_id"), F.col("l_suppkey").alias("seller_id"),
            F.when(failed, "ERRO").otherwise(shown).alias("image_hash"))

    def vectors(self) -> DataFrame:
        return self["embeddings"].select(F.col("vec_id").alias("listing_id"), (F.col("vec_id") % 50).alias("seller_id"), F.col("embedding").alias("vec"))

    def reviews(self) -> DataFrame:
        """Conversation turns as the reviews of one product."""
        return self["conversations"].select(
            F.col("conv_id").alias("product_id"), F.col("turn").alias("review_no"), (F.col("turn") % 5 + 1).alias("rating"), "text",
            (F.col("role") == "user").alias("has_images"))


LISTINGS_SQL = """
lines AS (
  SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS price, count(*) AS n_reviews,
         CAST(sum(CASE WHEN l_linenumber % 5 + 1 <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS neg_reviews,
         CAST(min(l_linenumber % 5 + 1) AS DOUBLE) AS rating, max(l_discount) * 10 AS model_score
  FROM lineitem GROUP BY l_partkey, l_suppkey),
listings AS (
  SELECT l_partkey * 100000 + l_suppkey AS listing_id, l_suppkey AS seller_id, l_partkey AS catalog_id,
         s_name AS seller_name, p_name AS title, p_type AS kind, price, p_retailprice AS list_price,
         CAST(1 + s_nationkey % 5 AS BIGINT) AS reputation, CAST(floor(s_acctbal / 20) AS BIGINT) AS transactions,
         CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS official, n_reviews, neg_reviews, rating, model_score,
         concat(l_suppkey, '-', p_brand, '-', p_type) AS image_hash,
         CASE p_size % 10 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS used,
         CASE s_nationkey % 4 WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' WHEN 3 THEN 'platinum' END AS status,
         CAST(CASE WHEN s_nationkey = 0 THEN -1 ELSE s_nationkey END AS BIGINT) AS community
  FROM lines JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
FEATURES_SQL = LISTINGS_SQL + """,
features AS (
  SELECT *, count(*) OVER (PARTITION BY image_hash) AS image_reuse, (price - list_price) / list_price AS price_gap,
         CAST(neg_reviews AS DOUBLE) / n_reviews AS negative_share, rating * ln(n_reviews + 1) AS weighted_rating,
         CASE WHEN contains(lower(title), 'large') <> contains(lower(kind), 'large') THEN 1 ELSE 0 END AS xl_mismatch
  FROM listings)"""
SCORED_SQL = FEATURES_SQL + """,
base AS (
  SELECT *, CASE WHEN price_gap < -0.30 THEN 2.0 WHEN price_gap < -0.15 THEN 1.0 WHEN price_gap < -0.05 THEN 0.5 ELSE 0 END
       + CASE WHEN image_reuse > 10 THEN 2.0 WHEN image_reuse >= 3 THEN 1.0 ELSE 0 END
       + CASE reputation WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0 END
       + CASE WHEN negative_share > 0.30 THEN 2.0 WHEN negative_share >= 0.15 THEN 0.5 ELSE 0 END
       + CASE WHEN transactions < 50 THEN 1.0 ELSE 0 END AS running
  FROM features),
scored AS (
  SELECT *, CAST(price_gap < -0.30 AS INTEGER) AS flag_price_very_low,
         CAST(price_gap >= -0.30 AND price_gap < -0.15 AS INTEGER) AS flag_price_medium_low,
         CAST(price_gap >= -0.15 AND price_gap < -0.05 AS INTEGER) AS flag_price_slightly_low,
         CAST(price_gap < -0.30 AS INTEGER) AS flag_instant_fraud, CAST(s AS DOUBLE) AS score, CAST(s >= 3.0 AS INTEGER) AS suspect
  FROM (SELECT *, running + CASE WHEN official = 1 AND running >= 2.0 THEN 1.0 ELSE 0 END
                          + CASE WHEN price_gap < -0.30 THEN 8.0 ELSE 0 END AS s FROM base))"""
REPORT_SQL = SCORED_SQL + """,
report AS (
  SELECT *, CASE WHEN score > 10 THEN NULL WHEN score <= 3 THEN 'low' WHEN score <= 6 THEN 'medium' WHEN score <= 8 THEN 'high' ELSE 'critical' END AS risk,
         0.5 * score / 10.0 + 0.5 * model_score AS hybrid
  FROM scored WHERE coalesce(used, 0) <> 1)"""
SELLERS_SQL = REPORT_SQL + """,
sellers AS (
  SELECT seller_id, seller_name, count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects, avg(score) AS mean_score,
         avg(price) AS mean_price, avg(price_gap) AS mean_gap, min_by(transactions, listing_id) AS transactions,
         min_by(status, listing_id) AS status, min_by(official, listing_id) AS official, min_by(reputation, listing_id) AS reputation,
         round_even(CAST(sum(suspect) AS DOUBLE) / count(*) * 100, 1) AS suspect_rate
  FROM report GROUP BY seller_id, seller_name)"""
COMMUNITIES_SQL = REPORT_SQL + """,
communities AS (
  SELECT community, count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects, avg(score) AS mean_score,
         count(DISTINCT seller_id) AS sellers, round_even(CAST(sum(suspect) AS DOUBLE) / count(*) * 100, 1) AS suspect_rate
  FROM report GROUP BY community)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
