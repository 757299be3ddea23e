"""From raw nested listings to the 22 essential columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.functions.columns import missing_to_null


def nested(path: str, default=None) -> Column:
    """Field at a dotted path, ``default`` when any part is missing."""
    return F.coalesce(F.col(path), F.lit(default))


def alternative_sellers(options: Column) -> Column:
    ids = F.transform(options, lambda o: o["seller_id"].cast("string"))
    return F.coalesce(F.filter(ids, lambda i: i.isNotNull() & (i != "")), F.array().cast("array<string>"))


def ship_origin(address_options: Column) -> Column:
    first = F.get(address_options, F.lit(0))
    return F.get(first["origins"], F.lit(0))["value"]


def seller_name(name: Column, seller_id: Column) -> Column:
    made_up = F.concat(F.lit("Vendedor_"), F.nullif(seller_id.cast("string"), F.lit("")))
    return F.coalesce(F.nullif(name, F.lit("")), made_up, F.lit("Vendedor_Desconhecido"))


def essential(listings: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One projection: renames, nested fields, defaults; blanks become null. Columns named in ``extra`` stay as they are."""
    data = "dados_brutos.melidata"
    text = {
        "listing_id": "id", "catalog_id": f"{data}.catalog_product_id", "link": "link", "title": "titulo",
        "image_url": "imagem_url", "description": "descricao", "condition": "condicao", "brand": "marca", "model": "modelo",
        "reputation_level": "reputation_level", "power_status": "power_seller_status",
        "official_store_id": f"{data}.official_store_id", "logistic_type": f"{data}.logistic_type",
    }
    return listings.select(
        *[missing_to_null(F.col(path)).alias(name) for name, path in text.items()],
        F.col("seller_id").try_cast("bigint").alias("seller_id"),
        F.col("preco").try_cast("double").alias("price"),
        seller_name(F.col("vendedor_nome"), F.col("seller_id")).alias("seller_name"),
        nested("vendedor_total_transacoes", 0).alias("transactions"),
        F.coalesce(f"{data}.reviews.rate", "rating_estrelas").alias("rating"),
        nested(f"{data}.reviews.count", 0).alias("n_reviews"),
        F.col("distribuicao_estrelas").alias("star_counts"),
        alternative_sellers(F.col(f"{data}.alternative_buying_options")).alias("alt_sellers"),
        ship_origin(F.col(f"{data}.shipping_promise.address_options")).alias("ship_origin"),
        *extra,
    )


# The 34 columns of the feature table, in our names.
FEATURE_COLUMNS = (
    "listing_id", "seller_id", "catalog_id", "title", "link", "image_url", "description",
    "cartridge_type", "quantity", "colours", "used",
    "seller_name", "transactions", "power_status", "official_store_id", "reputation_level",
    "reputation", "leader", "official",
    "price", "suggested_price", "price_gap",
    "rating", "n_reviews", "star_counts", "negative_share", "weighted_rating",
    "xl_mismatch",
    "condition", "logistic_type", "ship_origin", "alt_sellers", "brand", "model",
)


def keep_existing(df: DataFrame, wanted: Sequence[str] = FEATURE_COLUMNS) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names that do not."""
    return df.select(*[c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]
