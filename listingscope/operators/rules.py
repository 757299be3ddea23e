"""The declarative suspicion score and the bands derived from it.

A rule is a name, a test, points and the flag it sets. Rules are summed in
order because one of them looks at the running score. A new criterion is one
more ``Rule``; its test may be any boolean column, a pandas UDF call included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.functions.columns import flag


@dataclass(frozen=True)
class Rule:
    name: str
    points: float
    test: Callable[[Column], Column]  # receives the running score
    needs: tuple[str, ...] = ()
    flag_live: bool = False           # the flag column is set in "as_coded" mode
    points_live: bool = True          # the points are given in "as_coded" mode
    looks_back: bool = False          # the test reads the running score, which is then computed once

    @property
    def flag_column(self) -> str:
        return f"flag_{self.name}"


def _on(name: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda running: test(F.col(name))


# Points and limits of the thirteen criteria.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("price_very_low", 2.0, _on("price_gap", lambda g: g < -0.30), ("price_gap",), flag_live=True),
    Rule("price_medium_low", 1.0, _on("price_gap", lambda g: (g >= -0.30) & (g < -0.15)), ("price_gap",), flag_live=True),
    Rule("price_slightly_low", 0.5, _on("price_gap", lambda g: (g >= -0.15) & (g < -0.05)), ("price_gap",), flag_live=True),
    Rule("image_reuse_high", 2.0, _on("image_reuse", lambda n: n > 10), ("image_reuse",)),
    Rule("image_reuse_medium", 1.0, _on("image_reuse", lambda n: n.between(3, 10)), ("image_reuse",)),
    Rule("reputation_very_bad", 2.0, _on("reputation", lambda r: r == 1), ("reputation",)),
    Rule("reputation_bad", 1.0, _on("reputation", lambda r: r == 2), ("reputation",)),
    Rule("reviews_very_negative", 2.0, _on("negative_share", lambda s: s > 0.30), ("negative_share",)),
    Rule("reviews_negative", 0.5, _on("negative_share", lambda s: s.between(0.15, 0.30)), ("negative_share",)),
    Rule("xl_mismatch", 1.0, _on("xl_mismatch", lambda x: x == 1), ("xl_mismatch",), points_live=False),
    Rule("new_seller", 1.0, _on("transactions", lambda t: t < 50), ("transactions",)),
    Rule("official_suspect", 1.0, lambda running: (F.col("official") == 1) & (running >= 2.0), ("official",), looks_back=True),
    # On top of the two price points: ten points in all.
    Rule("instant_fraud", 8.0, _on("price_gap", lambda g: g < -0.30), ("price_gap",), flag_live=True),
)
SUSPECT_AT = 3.0


def score(
    df: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    mode: str = "as_coded",
    threshold: float = SUSPECT_AT,
) -> DataFrame:
    """Adds one flag per rule, ``score`` and ``suspect``.

    ``as_coded`` keeps the known gaps of the original scoring: the size-mismatch
    rule gives no points and only price flags are ever set. ``as_documented``
    lets every rule count and set its flag. Rules whose input column is absent
    are skipped with a zero flag.
    """
    if mode not in ("as_coded", "as_documented"):
        raise ValueError(f"unknown mode {mode!r}")
    known = [c for c in df.columns if c not in {f"flag_{r.name}" for r in rules} | {"score", "suspect"}]
    running = F.lit(0.0)
    flags: list[Column] = []
    for rule in rules:
        usable = all(name in df.columns for name in rule.needs)
        if rule.looks_back:
            df, running = df.withColumn("_running", running), F.col("_running")
        hit = rule.test(running) if usable else F.lit(False)
        documented = mode == "as_documented"
        flags.append(flag(hit if documented or rule.flag_live else F.lit(False)).alias(rule.flag_column))
        if documented or rule.points_live:
            running = running + F.when(hit, rule.points).otherwise(0.0)
    scored = df.select(*known, *flags, running.alias("score"))
    return scored.withColumn("suspect", flag(F.col("score") >= threshold))


def rule_hits(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rows that meet each criterion, whether or not its flag is ever set."""
    full = score(df, rules, mode="as_documented")
    sums = full.agg(*[F.sum(r.flag_column).alias(r.name) for r in rules])
    return sums.unpivot([], [r.name for r in rules], "rule", "hits")


# Right-closed bands.
SCORE_BANDS = ((1, "0-1"), (2, "1-2"), (3, "2-3"), (4, "3-4"), (5, "4-5"), (100, "5-100"))
RISK_BANDS = ((3, "low"), (6, "medium"), (8, "high"), (10, "critical"))
RISK_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def right_closed(c: Column, bands, low: float = 0) -> Column:
    """Label of the first band whose upper end is not below ``c``."""
    out = F.when(c.isNull() | (c < low), F.lit(None).cast("string"))
    for upper, label in bands:
        out = out.when(c <= upper, label)
    return out


def score_band(c: Column) -> Column:
    return right_closed(c, SCORE_BANDS)


def risk_category(c: Column, open_ended: bool = False) -> Column:
    """Above the last band the category is null unless ``open_ended``."""
    banded = right_closed(c, RISK_BANDS)
    return F.when(c > 10, "critical").otherwise(banded) if open_ended else banded


def seller_class(rate: Column) -> Column:
    return F.when(rate == 100, "critical").when(rate >= 70, "high").when(rate >= 30, "medium").otherwise("low")


def community_class(rate: Column) -> Column:
    return F.when(rate >= 80, "critical").when(rate >= 60, "high").when(rate >= 30, "medium").otherwise("low")


def seller_level(rate: Column) -> Column:
    """Filter level of a seller; the four choices overlap at 100 by design."""
    return F.when(rate == 100, "critical").when(rate > 50, "high").when(rate >= 25, "medium").otherwise("low")


def hybrid_score(rule_score: Column, model_score: Column, weight: float = 0.5) -> Column:
    return F.lit(weight) * rule_score / 10.0 + F.lit(1.0 - weight) * model_score


def effect_label(coefficient: Column) -> Column:
    return F.when(coefficient > 0, "raises").when(coefficient < 0, "lowers").otherwise("neutral")


def class_label(c: Column) -> Column:
    return F.when(c == 1, "suspect").when(c == 0, "legitimate")


def flag_title(c: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(c, "^flag_", ""), "_", " "))
