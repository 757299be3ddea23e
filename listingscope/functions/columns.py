"""Column helpers shared by every stage: missing values, numbers, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of "missing" that a CSV round trip turns into null.
MISSING_TEXTS = ("", "N/A", "NA", "NaN", "nan", "null", "None")


# Every blank a text file may hold, as one pattern class.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Without leading and trailing blanks of any kind."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def missing_to_null(c: Column, texts: Sequence[str] = MISSING_TEXTS) -> Column:
    return F.when(~c.isin(*texts), c)


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number here, so it must not reach a comparison."""
    return F.when(~F.isnan(c), c)


def digits_to_long(c: Column) -> Column:
    """Digits-only text as a 64-bit id, anything else null."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def decimal_comma(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def round_even(c: Column, digits: int) -> Column:
    """Half-even on the scaled double, the rounding the report figures use."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def share(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_even(F.when(whole > 0, part / whole * 100.0), digits)


def csv_text(c: Column) -> Column:
    """One-line text for CSV: blank runs to one space, nothing cut."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", " "))


def lookup(c: Column, table: dict, default=None) -> Column:
    """Value of ``c`` in a small fixed table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def count_where(c: Column) -> Column:
    """Rows where ``c`` holds; null counts as no, an empty input gives 0."""
    return F.count(F.when(c, F.lit(1)))


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def fill(df: DataFrame, policy: dict) -> DataFrame:
    """Per-column fill for the columns that exist."""
    return df.fillna({name: value for name, value in policy.items() if has(df, name)})


# Fill policy of the merged table.
MERGE_FILLS = {
    "sentiment": 0.0, "fraud_hits": 0, "performance_hits": 0, "has_review_text": 0,
    "n_texts": 0, "image_reuse": 1, "n_images": 0, "suspect": 0,
    "degree": 0, "community": -1, "betweenness": 0.0, "closeness": 0.0, "pagerank": 0.0,
}
