"""The questions an investigator asks of the scored table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.functions.columns import count_where, flag, has, percent, round_even
from listingscope.operators.dedupe import drop_missing_key, keep_first, without_used
from listingscope.operators.rules import risk_category


def report_table(final: DataFrame, order: Sequence, open_ended: bool = False) -> DataFrame:
    """The table every report starts from: unique ids, known sellers, no used goods."""
    rows = keep_first(final, ["listing_id"], order)
    rows = drop_missing_key(rows, "seller_id").withColumn("seller_id", F.col("seller_id").cast("bigint"))
    if has(rows, "used"):
        rows = without_used(rows)
    return rows.withColumn("risk", risk_category(F.col("score"), open_ended))


# ---------------------------------------------------------------- filters

@dataclass(frozen=True)
class ListingFilter:
    """Every set field narrows; they combine with AND."""

    score: tuple[float, float] | None = None
    price: tuple[float, float] | None = None
    risk: str | None = None
    community: int | None = None
    status: str | None = None
    flags: tuple[str, ...] = ()

    def predicate(self) -> Column:
        tests = [F.lit(True)]
        if self.score:
            tests.append(F.col("score").between(*self.score))
        if self.price:
            tests.append(F.col("price").between(*self.price))
        for name in ("risk", "community", "status"):
            if getattr(self, name) is not None:
                tests.append(F.col(name) == getattr(self, name))
        tests += [F.col(f) == 1 for f in self.flags]
        return flag(reduce(lambda a, b: a & b, tests)) == 1


@dataclass(frozen=True)
class SellerFilter:
    level: str | None = None            # critical | high | medium | low
    min_listings: int = 0
    min_rate: float | None = None
    statuses: tuple[str, ...] = ()
    official: bool | None = None
    reputation: tuple[float, float] | None = None  # (low, high]
    min_score: float | None = None
    extra: tuple[Column, ...] = field(default=())

    def predicate(self) -> Column:
        rate = F.col("suspect_rate")
        tests = [F.col("listings") >= self.min_listings, *self.extra]
        if self.level:
            tests.append({"critical": rate == 100, "high": rate > 50, "medium": rate.between(25, 50), "low": rate < 25}[self.level])
        if self.min_rate is not None:
            tests.append(rate >= self.min_rate)
        if self.statuses:
            tests.append(F.col("status").isin(*self.statuses))
        if self.official is not None:
            tests.append(F.col("official") == int(self.official))
        if self.reputation:
            tests.append((F.col("reputation") > self.reputation[0]) & (F.col("reputation") <= self.reputation[1]))
        if self.min_score is not None:
            tests.append(F.col("mean_score") >= self.min_score)
        return reduce(lambda a, b: a & b, tests)


def filter_effect(df: DataFrame, spec: ListingFilter) -> DataFrame:
    """Kept, removed, share and suspect rate from one scan."""
    kept = spec.predicate()
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), count_where(kept).alias("kept"),
        count_where(kept & (F.col("suspect") == 1)).alias("kept_suspects"),
    )
    return counts.select(
        "kept", (F.col("total") - F.col("kept")).alias("removed"),
        percent(F.col("kept"), F.col("total")).alias("kept_percent"),
        percent(F.col("kept_suspects"), F.col("kept")).alias("suspect_rate"),
    )


def filter_bounds(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"),
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).where(F.col(name).isNotNull()).distinct()


def notable_communities(df: DataFrame, rate: float = 0.2) -> DataFrame:
    """Communities offered as a filter: those above a suspect share."""
    sums = df.where(F.col("community").isNotNull()).groupBy("community").agg(
        F.sum("suspect").alias("suspects"), F.count(F.lit(1)).alias("listings"))
    return sums.where(F.col("suspects") / F.col("listings") > rate).select("community")


# ---------------------------------------------------------------- sellers

def seller_metrics(df: DataFrame, order: Sequence = ("listing_id",)) -> DataFrame:
    """Per (seller, name): volumes, means, first known attributes, suspect rate.

    Optional columns are used when the table has them.
    """
    by = F.struct(*order)
    aggregates = [
        F.count("listing_id").alias("listings"), F.sum("suspect").alias("suspects"), F.avg("score").alias("mean_score"),
    ]
    for name, alias in (("price", "mean_price"), ("price_gap", "mean_gap"), ("community_rate", "mean_community_rate")):
        if has(df, name):
            aggregates.append(F.avg(name).alias(alias))
    for name in ("transactions", "status", "official", "reputation"):
        if has(df, name):  # first non-null value in order
            aggregates.append(F.min_by(F.col(name), F.when(F.col(name).isNotNull(), by)).alias(name))
    known = df.where(F.col("seller_id").isNotNull() & F.col("seller_name").isNotNull())
    out = known.groupBy("seller_id", "seller_name").agg(*aggregates)
    return out.withColumn("suspect_rate", percent(F.col("suspects"), F.col("listings")))


def community_metrics(df: DataFrame) -> DataFrame:
    """Volumes, mean score, sellers and suspect rate per community.

    Summed per seller first, so sellers are counted without a distinct.
    """
    per_seller = df.where(F.col("community").isNotNull()).groupBy("community", "seller_id").agg(
        F.count("listing_id").alias("n"), F.sum("suspect").alias("s"), F.sum("score").alias("t"), F.count("score").alias("k"))
    out = per_seller.groupBy("community").agg(
        F.sum("n").alias("listings"), F.sum("s").alias("suspects"), (F.sum("t") / F.sum("k")).alias("mean_score"),
        F.count("seller_id").alias("sellers"))
    return out.withColumn("suspect_rate", percent(F.col("suspects"), F.col("listings")))


def top(df: DataFrame, column: str, n: int | None, key: str, ascending: bool = False) -> DataFrame:
    """Sorted by one column, nulls last both ways, ties by id; all rows when ``n`` is None."""
    c = F.col(column)
    ordered = df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col(key).asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def status_summary(sellers: DataFrame) -> DataFrame:
    """Per seller status; sellers without one are left out."""
    out = sellers.where(F.col("status").isNotNull()).groupBy("status").agg(
        F.count("seller_name").alias("sellers"), F.sum("listings").alias("listings"), F.sum("suspects").alias("suspects"),
        F.avg("suspect_rate").alias("_rate"), F.avg("mean_score").alias("_score"))
    return out.select("status", "sellers", "listings", "suspects",
                      round_even(F.col("_rate"), 1).alias("mean_rate"), round_even(F.col("_score"), 2).alias("mean_score"))


def seller_listings(df: DataFrame, seller_id: int, suspect: bool, limit: int | None = None) -> DataFrame:
    rows = df.where((F.col("seller_id") == seller_id) & (F.col("suspect") == int(suspect)))
    return top(rows, "score", limit, "listing_id")


def top_sellers_by_name(df: DataFrame, n: int = 10) -> DataFrame:
    named = df.where(F.col("seller_name").isNotNull()).groupBy("seller_name").agg(
        F.count(F.lit(1)).alias("listings"), F.sum("suspect").alias("suspects"))
    return top(named, "suspects", n, "seller_name")


def action_buckets(sellers: DataFrame) -> DataFrame:
    rate = F.col("suspect_rate")
    return sellers.agg(
        count_where(rate == 100).alias("block_now"),
        count_where((rate > 50) & (rate < 100)).alias("review"),
        F.coalesce(F.sum("suspects"), F.lit(0)).alias("suspects"),
    )


# ---------------------------------------------------------------- panels

def panel(df: DataFrame) -> DataFrame:
    """Headline numbers; one row, summed per seller first."""
    bad = F.col("suspect") == 1
    per_seller = df.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("suspect").alias("s"), F.sum(F.when(bad, F.col("price"))).alias("v"))
    sums = per_seller.agg(
        F.sum("n").alias("listings"), F.sum("s").alias("suspects"), F.count("seller_id").alias("sellers"),
        count_where(F.col("seller_id").isNotNull() & (F.col("s") > 0)).alias("suspect_sellers"),
        F.sum("v").alias("value_at_risk"))
    return sums.select(
        "listings", "suspects", "sellers", "suspect_sellers", "value_at_risk",
        percent(F.col("suspects"), F.col("listings"), 6).alias("detection_rate"),
        F.try_divide("value_at_risk", "suspects").alias("value_per_suspect"),
    )


def risk_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("risk").agg(F.count("risk").alias("listings")).where("listings > 0")


def risk_means(df: DataFrame) -> DataFrame:
    return df.groupBy("risk").agg(F.avg("score").alias("mean_score"), F.count("risk").alias("_n")).where("_n > 0").drop("_n")


def flag_totals(df: DataFrame, n: int | None = None) -> DataFrame:
    flags = [c for c in df.columns if c.startswith("flag_")]
    long = df.agg(*[F.sum(c).alias(c) for c in flags]).unpivot([], flags, "flag", "hits")
    return top(long, "hits", n, "flag")


def band_counts(df: DataFrame, band: Column) -> DataFrame:
    """Rows without a band are counted out after the sums: a filter on the band would repeat the whole score in every branch."""
    rows = df.withColumn("band", band).groupBy("band").agg(F.count("band").alias("listings"), F.sum("suspect").alias("suspects"))
    return rows.where("listings > 0")


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of several scores, one row each."""
    stats = [f(c).alias(f"{c}|{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    one = df.agg(*stats)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|mean`").alias("mean"), F.col(f"`{c}|std`").alias("std")) for c in columns])
    return one.select(F.inline(rows))


def threshold_counts(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    hits = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_where(F.col(c) >= t).alias(c) for c, t in limits.items()])
    long = hits.unpivot(["_rows"], list(limits), "column", "n")
    return long.select("column", "n", percent(F.col("n"), F.col("_rows")).alias("percent"))


def executive_summary(df: DataFrame, sellers: DataFrame) -> DataFrame:
    left = df.agg(
        count_where(F.col("risk") == "critical").alias("critical"), count_where(F.col("risk") == "high").alias("high"),
        F.avg(F.when(F.col("suspect") == 1, F.col("price"))).alias("price_suspect"),
        F.avg(F.when(F.col("suspect") == 0, F.col("price"))).alias("price_legitimate"))
    right = sellers.agg(F.struct(
        count_where(F.col("suspect_rate") == 100).alias("sellers_all"),
        count_where(F.col("suspect_rate") > 50).alias("sellers_half")).alias("s"))
    return left.withColumn("_s", right.scalar()).select(*left.columns, "_s.sellers_all", "_s.sellers_half")


def network_panel(communities: DataFrame) -> DataFrame:
    return communities.agg(
        F.count(F.lit(1)).alias("communities"), count_where(F.col("suspect_rate") > 50).alias("suspect_communities"),
        F.avg("sellers").alias("mean_sellers"))


def sellers_in_communities(df: DataFrame) -> DataFrame:
    per_seller = df.groupBy("seller_id").agg(F.max(F.col("community").isNotNull().cast("int")).alias("_in"))
    return per_seller.agg(F.sum("_in").alias("in_communities"), F.count("seller_id").alias("sellers"))


def community_members(df: DataFrame, community: int) -> DataFrame:
    rows = df.where(F.col("community") == community).groupBy("seller_id", "seller_name").agg(
        F.count("listing_id").alias("listings"), F.sum("suspect").alias("suspects"),
        F.avg("score").alias("mean_score"), F.avg("price").alias("mean_price"))
    return rows.withColumn("suspect_rate", percent(F.col("suspects"), F.col("listings")))


def cluster_buckets(communities: DataFrame) -> DataFrame:
    rate = F.col("suspect_rate")
    return communities.agg(
        count_where(rate >= 80).alias("critical"), count_where((rate >= 50) & (rate < 80)).alias("high"),
        F.coalesce(F.sum("suspects"), F.lit(0)).alias("suspects"))


def recommendations(communities: DataFrame) -> DataFrame:
    rate = F.col("suspect_rate")
    return communities.agg(
        flag(F.max(rate) >= 80).alias("act_now"),
        flag(F.max(flag((rate >= 50) & (rate < 80))) == 1).alias("investigate"),
        flag(F.max("sellers") > 20).alias("watch_large"),
        flag(F.avg(rate) > 50).alias("systemic"),
        flag(F.max(rate) > 30).alias("any_problem"))


def correlations(df: DataFrame, columns: Sequence[str], target: str, n: int = 10) -> DataFrame:
    """Pearson correlation of each column with the target, strongest first."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    long = one.unpivot([], list(columns), "column", "correlation").where("correlation is not null")
    return long.orderBy(F.desc(F.abs("correlation")), "column").limit(n)


def trimmed_mean(df: DataFrame, column: str, low: float = -1, high: float = 2) -> DataFrame:
    kept = F.when(F.col(column).between(low, high), F.col(column))
    return df.agg(F.avg(kept).alias("mean"), F.count(kept).alias("kept"), F.count(column).alias("known"))


def score_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("listings"), F.sum("suspect").alias("suspects"), F.avg("suspect").alias("suspect_rate"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"))


def feature_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("negative_share").alias("negative_mean"), F.max("negative_share").alias("negative_max"),
        F.avg("weighted_rating").alias("rating_mean"), F.max("weighted_rating").alias("rating_max"),
        F.sum("xl_mismatch").alias("mismatches"), F.avg("xl_mismatch").alias("mismatch_share"),
        F.count("price_gap").alias("gap_known"))


def crawl_summary(items: DataFrame, term: str) -> DataFrame:
    """Found, extracted, skipped and reviews per search term."""
    return items.groupBy(term).agg(
        F.count(F.lit(1)).alias("found"), count_where(F.col("status") == "ok").alias("extracted"),
        count_where(F.col("status") == "skipped").alias("skipped"),
        count_where(F.col("n_reviews") > 0).alias("with_reviews"),
        F.coalesce(F.sum("n_reviews"), F.lit(0)).alias("reviews"))
