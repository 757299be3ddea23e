"""Row-level listing features: reputation, stores, reviews, price gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.functions.columns import flag, lookup, missing_to_null, share
from listingscope.operators.dedupe import keep_last

# Reputation levels; the first two are attested, the rest assumed.
REPUTATION_LEVELS = {"1_red": 1, "2_orange": 2, "3_yellow": 3, "4_light_green": 4, "5_green": 5}


def reputation_number(level: Column, levels: dict[str, int] = REPUTATION_LEVELS) -> Column:
    return lookup(level, levels, 0)


def is_official(store_id: Column) -> Column:
    return missing_to_null(store_id.cast("string")).isNotNull().cast("int")


def is_leader(status: Column) -> Column:
    return missing_to_null(status).isNotNull().cast("int")


def negative_share(stars: Column, total: Column) -> Column:
    """One- and two-star reviews over all reviews, from a star-count map."""
    low = sum(F.coalesce(F.try_element_at(stars, F.lit(k)), F.lit(0)) for k in ("1_estrelas", "2_estrelas"))
    return share(low, F.coalesce(total, F.lit(0)))


def weighted_rating(rating: Column, reviews: Column) -> Column:
    return F.coalesce(rating, F.lit(0.0)) * F.log1p(F.coalesce(reviews, F.lit(0)).cast("double"))


def text_mismatch(title: Column, kind: Column, word: str = "xl") -> Column:
    """1 when exactly one of the two texts has the word; null text has none."""
    return (flag(F.lower(title).contains(word)) != flag(F.lower(kind).contains(word))).cast("int")


def price_gap(price: Column, suggested: Column) -> Column:
    return F.when(suggested > 0, (price - suggested) / suggested)


def price_key(product: Column, family: Column, brand_word: str = "hp") -> Column:
    name = F.lower(product)
    base = F.trim(F.regexp_replace(F.lower(family), brand_word, ""))
    size = F.when(name.contains("xl"), "xl").otherwise("")
    colour = F.when(name.contains("preto"), "preto").otherwise("colorido")
    return F.concat(base, size, F.lit("_"), colour)


def price_table(prices: DataFrame) -> DataFrame:
    """(price_key, unit_price); the last line of a repeated key wins."""
    keyed = prices.select(price_key(F.col("product"), F.col("family")).alias("price_key"),
                          F.col("suggested_price").alias("unit_price"), "line_no")
    return keep_last(keyed, ["price_key"], ["line_no"]).drop("line_no")


def suggested_price(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``suggested_price`` from a unit-price table ``(price_key, unit_price)``.

    Two lookups per listing, black and colour. Kits of one colour multiply, a
    pair of both colours adds, any larger mix has no suggested price.
    """
    kind = F.lower(F.trim("cartridge_type"))

    def side(colour: str) -> DataFrame:
        return prices.select(F.col("price_key").alias(f"_key_{colour}"), F.col("unit_price").alias(f"_unit_{colour}"))

    found = df
    for colour in ("preto", "colorido"):
        key = F.concat(kind, F.lit(f"_{colour}"))
        found = found.join(side(colour), key == F.col(f"_key_{colour}"), "left").drop(f"_key_{colour}")
    black, colour = F.col("_unit_preto"), F.col("_unit_colorido")
    units = F.coalesce(F.col("quantity"), F.lit(1))
    has_black = F.coalesce(F.col("colours.preto") == 1, F.lit(False))
    has_colour = F.coalesce(F.col("colours.colorido") == 1, F.lit(False))
    total = (
        F.when(F.col("colours").isNull(), F.lit(None).cast("double"))
        .when((units == 1) & has_black, black)
        .when(units == 1, colour)
        .when((units == 2) & has_black & has_colour & (black != 0) & (colour != 0), black + colour)
        .when((units > 1) & has_black & ~has_colour & (black != 0), black * units)
        .when((units > 1) & ~has_black & has_colour & (colour != 0), colour * units)
    )
    return found.withColumn("suggested_price", total).drop("_unit_preto", "_unit_colorido")


def basic_features(df: DataFrame, levels: dict[str, int] = REPUTATION_LEVELS) -> DataFrame:
    """All scalar features of a listing that already has ``suggested_price``."""
    return df.withColumns({
        "reputation": reputation_number(F.col("reputation_level"), levels),
        "official": is_official(F.col("official_store_id")),
        "leader": is_leader(F.col("power_status")),
        "negative_share": negative_share(F.col("star_counts"), F.col("n_reviews")),
        "weighted_rating": weighted_rating(F.col("rating"), F.col("n_reviews")),
        "xl_mismatch": text_mismatch(F.col("title"), F.col("cartridge_type")),
        "price_gap": price_gap(F.col("price"), F.col("suggested_price")),
    })
