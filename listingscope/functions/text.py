"""Review text, keywords, sentiment, attributes in titles, embedding hygiene."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.functions.columns import count_where, flag, strip

# Word lists named in the public report.
FRAUD_WORDS = ("falso", "pirata", "genérico vendido como original", "não é hp", "falsa", "contrabando")
PERFORMANCE_WORDS = ("vazou", "quebrou", "ruim")


def is_text(text: Column, min_chars: int = 0, placeholders: Sequence[str] = ()) -> Column:
    """Longer than ``min_chars`` after trimming and none of the placeholders."""
    kept = F.length(strip(text)) > min_chars
    return kept & ~strip(text).isin(*placeholders) if placeholders else kept


def usable_reviews(reviews: DataFrame, key: str, min_chars: int = 0, placeholders: Sequence[str] = ()) -> DataFrame:
    kept = reviews.where(F.col(key).isNotNull() & is_text(F.col("text"), min_chars, placeholders))
    return kept.withColumn("text", strip(F.col("text")))


def word_hits(text: Column, words: Sequence[str]) -> Column:
    """Non-overlapping occurrences of each word, summed over the list."""
    lowered = F.lower(text)
    counts = [F.regexp_count(lowered, F.lit(_quoted(w))) for w in words]
    return reduce(lambda a, b: a + b, counts, F.lit(0))


def _quoted(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def review_features(
    reviews: DataFrame,
    key: str,
    lexicon: DataFrame | None = None,
    fraud_words: Sequence[str] = FRAUD_WORDS,
    performance_words: Sequence[str] = PERFORMANCE_WORDS,
    min_chars: int = 0,
    placeholders: Sequence[str] = (),
) -> DataFrame:
    """One row per product: texts analysed, keyword hits, mean sentiment.

    Hits are counted review by review and summed, so no product's reviews are
    ever joined into one string. A word cannot start in one review and end in
    the next unless it holds the joining blank at that very place; words are
    searched inside reviews only.
    """
    texts = usable_reviews(reviews, key, min_chars, placeholders)
    counted = texts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(word_hits(F.col("text"), fraud_words)).alias("fraud_hits"),
        F.sum(word_hits(F.col("text"), performance_words)).alias("performance_hits"),
    ).withColumn("has_review_text", F.lit(1))
    if lexicon is None:
        return counted.withColumn("sentiment", F.lit(0.0))
    return counted.join(mean_sentiment(texts, key, lexicon), key, "left").fillna({"sentiment": 0.0})


def mean_sentiment(texts: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """Mean over a product's reviews of s / sqrt(s² + 15), s the summed word valence.

    ``lexicon`` is the caller's ``(word, valence)`` table. Words are counted per
    review before the lookup, a review without any known word scores 0.
    """
    numbered = texts.select(key, "review_no", "text")
    words = numbered.select(key, "review_no", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    valued = words.where("word <> ''").groupBy(key, "review_no", "word").agg(F.count(F.lit(1)).alias("n")).join(lexicon, "word")
    sums = valued.groupBy(key, "review_no").agg(F.sum(F.col("n") * F.col("valence")).alias("s"))
    per_review = sums.select(key, (F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15.0)).alias("compound"))
    totals = numbered.groupBy(key).agg(F.count(F.lit(1)).alias("n_all"))
    scored = per_review.groupBy(key).agg(F.sum("compound").alias("total"))
    return totals.join(scored, key, "left").select(key, (F.coalesce("total", F.lit(0.0)) / F.col("n_all")).alias("sentiment"))


# Reference codes and what they stand for (type, colour).
CARTRIDGE_CODES = {
    "CZ103AB": ("662", "preto"), "CZ104AB": ("662", "colorido"), "CZ105AB": ("662xl", "preto"), "CZ106AB": ("662xl", "colorido"),
    "F6V28AB": ("664", "colorido"), "F6V29AB": ("664", "preto"), "F6V30AB": ("664xl", "colorido"), "F6V31AB": ("664xl", "preto"),
    "3YM78AB": ("667", "colorido"), "3YM79AB": ("667", "preto"), "3YM80AB": ("667xl", "colorido"), "3YM81AB": ("667xl", "preto"),
}
# Known models and the words for colours and used goods.
CARTRIDGE_MODELS = ("662", "664", "667", "62")
BLACK_WORDS = ("preto", "black")
COLOUR_WORDS = ("colorid", "tricolor", "tri-color", "color")
USED_WORDS = ("usado", "seminovo", "recondicionado", "remanufaturado", "vazio")


def attributes(
    title: Column,
    description: Column | None = None,
    codes: dict[str, tuple[str, str]] = CARTRIDGE_CODES,
    models: Sequence[str] = CARTRIDGE_MODELS,
    black: Sequence[str] = BLACK_WORDS,
    colour: Sequence[str] = COLOUR_WORDS,
    used: Sequence[str] = USED_WORDS,
) -> Column:
    """struct(cartridge_type, colours, quantity, used) read from free text.

    Type: the first size-XL model if any, else the first model, else what the
    first code stands for. Quantity: a counted kit, "Nx", "N unidades" or one.
    """
    text = F.lower(F.concat_ws(" ", title, description) if description is not None else F.coalesce(title, F.lit("")))
    any_model = "|".join(models)
    any_code = "|".join(c.lower() for c in codes)
    code_kinds = F.create_map(*[F.lit(v) for c, (kind, _) in codes.items() for v in (c.lower(), kind)])

    def found(pattern: str, group: int = 1) -> Column:
        hit = F.regexp_extract(text, pattern, group)
        return F.when(hit != "", hit)

    def mentions(words: Sequence[str], colour_name: str | None = None) -> Column:
        tests = [text.contains(w) for w in words]
        if colour_name:
            tests += [text.contains(c.lower()) for c, (_, tint) in codes.items() if tint == colour_name]
        return flag(reduce(lambda a, b: a | b, tests))

    xl_model = found(rf"\b({any_model})\s*-?xl\b")
    plain_model = found(rf"\b({any_model})\b")
    code = found(rf"\b({any_code})\b")
    loose_xl = F.when(text.rlike(r"\bxl\b"), "xl").otherwise("")
    kind = F.coalesce(
        F.concat(xl_model, F.lit("xl")),
        F.concat(plain_model, loose_xl),
        F.try_element_at(code_kinds, code),
        F.lit("desconhecido"),
    )
    counted = F.coalesce(
        found(r"\b(?:kit|pack|conjunto)\s+(?:com\s+|de\s+)?(\d{1,3})\b(?!\s*(?:xl|preto|colorid))"),
        found(r"\b(\d{1,3})\s*x\s"),
        found(r"\b(\d{1,3})\s*(?:unidades?|cartuchos?|pe[çc]as?|unid)\b"),
    ).try_cast("int")
    return validated(kind, mentions(black, "preto"), mentions(colour, "colorido"), F.coalesce(counted, F.lit(1)), mentions(used))


def validated(kind: Column, black: Column, colour: Column, quantity: Column, used: Column) -> Column:
    """The consistency rules applied to any extraction result."""
    one_kind = F.trim(F.get(F.split(F.trim(F.lower(kind)), ","), F.lit(0)))
    none = (black == 0) & (colour == 0)
    both = (black == 1) & (colour == 1)
    failed = kind.isNull() | black.isNull() | colour.isNull() | quantity.isNull() | used.isNull()
    good = F.struct(
        one_kind.alias("cartridge_type"),
        F.struct(F.when(none, 1).otherwise(black).alias("preto"), colour.alias("colorido")).alias("colours"),
        F.greatest(quantity, F.when(both, 2).otherwise(1)).alias("quantity"),
        used.alias("used"),
    )
    bad = F.struct(
        F.lit("desconhecido").alias("cartridge_type"),
        F.struct(F.lit(0).alias("preto"), F.lit(0).alias("colorido")).alias("colours"),
        F.lit(1).alias("quantity"),
        F.lit(0).alias("used"),
    )
    return F.when(failed, bad).otherwise(good)


def attribute_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("cartridge_type").agg(
        F.count(F.lit(1)).alias("listings"),
        count_where(F.col("colours.preto") == 1).alias("black"),
        count_where(F.col("colours.colorido") == 1).alias("colour"),
        count_where(F.col("used") == 1).alias("used"),
    ).orderBy(F.desc("listings"), "cartridge_type")


def embedding_pieces(rows: DataFrame, text: str = "text", size: int = 8000) -> DataFrame:
    """The whole text for an external encoder: rows of at most ``size`` characters each, numbered from 0.

    The pieces of a text, put together, are the stripped text; an empty text has one empty piece, null has none.
    """
    whole = strip(F.col(text))
    last = F.greatest(F.ceil(F.length(whole) / size) - 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(whole, (i * size + 1).cast("int"), F.lit(size)))
    others = [c for c in rows.columns if c != text]
    return rows.where(F.col(text).isNotNull()).select(*others, F.posexplode(pieces).alias("piece_no", text))


def parse_vector(json_text: Column, dim: int) -> Column:
    """JSON list as a vector; null stays null, a broken one becomes zeros."""
    parsed = F.from_json(json_text, "array<double>")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.when(json_text.isNotNull(), F.when(F.size(parsed) == dim, parsed).otherwise(zeros))


def is_zero_vector(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def image_extension(url: Column) -> Column:
    lowered = F.lower(url)
    return F.when(lowered.contains("webp"), "webp").when(lowered.contains("png"), "png").otherwise("jpg")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"\.[^.]*$", "")
