"""Reading raw listing, review, seller and price files.

Pretty-printed JSON cannot be split, so one such file is one task; write large
inputs as JSON lines and pass ``lines=True``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.functions.columns import decimal_comma
from listingscope.operators.dedupe import keep_first
from listingscope.operators.enrich import unify
from listingscope.sources import schemas


def _json(spark: SparkSession, paths, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(paths)


def _placed(spark: SparkSession, paths, schema: str, lines: bool = False) -> DataFrame:
    """Rows with ``source_order``, which sorts as the rows stand in the files: by path as given, file, part of the file and place in the part."""
    given = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, path in enumerate(given):
        rows = _json(spark, path, schema, lines)
        # A task reads its part of a file from front to back and numbers upwards.
        rows = rows.withColumn("source_order", F.struct(
            F.lit(i).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _listing_fields(spark: SparkSession) -> list[str]:
    return T._parse_datatype_string(schemas.LISTING).fieldNames()


def listing_rows(files: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per listing from any of the three wrappings: list field, single object, bare list."""
    bare = F.struct(*fields)
    rows = F.when(F.col("produtos").isNotNull(), F.col("produtos")).when(
        F.col("produto").isNotNull(), F.array("produto")).otherwise(F.array(bare))
    kept = [c for c in files.columns if c not in (*fields, "produtos", "produto")]
    return files.select(*kept, F.posexplode(rows).alias("position", "_l")).select(*kept, "position", "_l.*")


def read_listings(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """One row per listing with its place among all (``source_order``)."""
    rows = listing_rows(_placed(spark, paths, schemas.LISTING_FILE, lines), _listing_fields(spark))
    return rows.withColumn("source_order", F.struct("source_order.*", "position"))


def read_listing_sets(spark: SparkSession, paths: dict[str, str], lines: bool = False) -> DataFrame:
    """Files by type, stacked, each listing tagged with its type; types follow one another in ``source_order``."""
    def read(i: int, p) -> DataFrame:
        return read_listings(spark, p, lines).withColumn("source_order", F.struct(F.lit(i).alias("set"), "source_order.*"))
    return unify({kind: read(i, p) for i, (kind, p) in enumerate(paths.items())})


def read_reviews(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """Review bundles with the file they came from; a later file wins over an earlier one."""
    rows = _json(spark, paths, schemas.REVIEW_BUNDLE, lines)
    return rows.where("product_id is not null").withColumn("source", F.col("_metadata.file_name"))


def exploded_reviews(bundles: DataFrame) -> DataFrame:
    """Reviews at their own grain: (product_id, review_no, rating, text, has_images, …)."""
    rows = bundles.select("product_id", F.posexplode("reviews").alias("_p", "_r"))
    return rows.select("product_id", (F.col("_p") + 1).alias("review_no"), "_r.rating", "_r.text", "_r.likes", "_r.has_images", "_r.date")


def read_sellers(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """Sellers flattened, the first record of an id in the order of paths, files and records kept."""
    rows = _placed(spark, paths, schemas.SELLER_FILE, lines)
    flat = rows.select("source_order", F.posexplode("dados_vendedores").alias("_p", "s")).select(
        F.col("s.id").alias("id"), F.col("s.nickname").alias("nickname"), F.col("s.address.state").alias("state"),
        F.col("s.address.city").alias("city"), F.col("s.user_type").alias("user_type"),
        F.col("s.seller_reputation.level_id").alias("seller_level"),
        F.col("s.seller_reputation.power_seller_status").alias("seller_power_status"),
        F.col("s.seller_reputation.transactions.total").alias("transactions"),
        F.col("s.status.site_status").alias("site_status"), "source_order", "_p")
    return keep_first(flat.where("id <> 0"), ["id"], ["source_order", "_p"]).drop("source_order", "_p")


def read_prices(spark: SparkSession, path: str) -> DataFrame | None:
    """Suggested prices; lines without a number are dropped, an absent file is None."""
    try:
        rows = spark.read.schema(schemas.PRICE_FILE).csv(path, sep=";", header=True)
    except AnalysisException:
        return None
    price = decimal_comma(F.col("price_text"))
    # Line order inside the file decides which of two equal keys wins.
    return rows.select("product", "family", price.alias("suggested_price"), F.monotonically_increasing_id().alias("line_no")).dropna(
        subset=["suggested_price"])


REVIEW_SUFFIX = "_reviews.json"


def batch_files(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Every row of a folder's files with (base, role): product files and their review files."""
    schema = f"{schemas.LISTING_FILE}, reviews array<{schemas._as_struct(schemas.REVIEW)}>"
    rows = spark.read.schema(schema).option("multiLine", not lines).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("file_name", F.col("_metadata.file_name")).where(~F.col("file_name").startswith("consolidado"))
    is_review = F.col("file_name").endswith(REVIEW_SUFFIX)
    return rows.withColumn("base", F.regexp_replace("file_name", r"(_reviews)?\.json$", "")).withColumn(
        "role", F.when(is_review, "reviews").otherwise("products"))


def file_pairs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paired, unpaired) base names; a product file needs its review file and vice versa."""
    roles = files.select("base", "role").distinct()
    products, reviews = roles.where("role = 'products'"), roles.where("role = 'reviews'")
    paired = products.select("base").join(reviews.select("base"), "base")
    return paired, roles.join(paired, "base", "left_anti")


def paired_listings(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, reviews) of paired files, reviews keyed by (base, product)."""
    paired, _ = file_pairs(files)
    kept = files.join(paired, "base", "left_semi")
    listings = listing_rows(kept.where("role = 'products'").drop("reviews"), _listing_fields(spark)).where("id is not null and id <> ''")
    reviews = kept.where("role = 'reviews'").select("base", F.explode("reviews").alias("_r")).select("base", "_r.*")
    return listings, reviews.where("produto_id is not null")


def single_listing(files: DataFrame, fields: Sequence[str], dashboard: bool = False) -> DataFrame:
    """Listings of single-listing files with ``product_id`` from the first id field present."""
    rows = listing_rows(files, fields)
    names = ("id", "product_code") if dashboard else ("id", "product_id", "catalog_product_id")
    present = [F.nullif(F.col(c), F.lit("")) for c in names]
    return rows.withColumn("product_id", F.coalesce(*present))


def single_listing_reviews(listings: DataFrame) -> DataFrame:
    """(product_id, reviews): one row per listing that has an id, empty lists included."""
    empty = F.array().cast(listings.schema["todos_reviews"].dataType)
    return listings.where("product_id is not null").select("product_id", F.coalesce("todos_reviews", empty).alias("reviews"))


def newest_files(df: DataFrame) -> DataFrame:
    """Rows of the most recently written file of a scan."""
    stamped = df.withColumn("_t", F.col("_metadata.file_modification_time"))
    return stamped.where(F.col("_t") == stamped.agg(F.max("_t")).scalar()).drop("_t")
