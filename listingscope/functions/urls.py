"""Product ids, codes and checks on listing URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL shapes, host and site prefixes of the marketplace.
ID_PATTERNS = (r"/MLB-(\d+)", r"/p/MLB(\d+)", r"MLB(\d+)", r"/(\d+)-")
CODE_PATTERNS = (r"/p/([A-Z]+[\d]+)", r"/([A-Z]+[\d]+)", r"/([A-Z]+-[\d]+)", r"([A-Z]+[\d]+)")
SITE_PREFIXES = ("MLB", "MLU", "MLC", "MCO", "MLV", "MPE", "MPT", "MLM")
HOST = "mercadolivre.com.br"
PRODUCT_URL = "https://www.mercadolivre.com.br/p/"
SKIPPED_LINKS = ("click1.mercadolivre.com.br", "publicidade.mercadolivre.com.br", "noindex/catalog/reviews")


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def product_id(url: Column, patterns: Sequence[str] = ID_PATTERNS, prefix: str = "MLB") -> Column:
    return F.concat(F.lit(prefix), first_match(url, patterns))


def product_code(url: Column, patterns: Sequence[str] = CODE_PATTERNS) -> Column:
    return F.regexp_replace(first_match(url, patterns), "-", "")


def clean_url(url: Column) -> Column:
    """Without fragment and query; empty is missing."""
    return F.when(url != "", F.get(F.split(F.get(F.split(url, "#"), F.lit(0)), r"\?"), F.lit(0)))


def product_url(code: Column, base: str = PRODUCT_URL) -> Column:
    return F.when(code != "", F.concat(F.lit(base), code))


def check_url(url: Column, host: str = HOST) -> Column:
    """struct(valid, reason) with the first failed check as the reason."""
    lowered = F.trim(F.lower(url))
    reason = (
        F.when(url.isNull() | (url == ""), "empty")
        .when(~lowered.contains(host), "wrong host")
        .when(~lowered.startswith("http"), "wrong scheme")
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("valid"), reason.alias("reason"))
