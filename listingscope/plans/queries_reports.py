"""The report questions over the scored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingscope.functions import columns as C
from listingscope.operators import enrich, quantiles, reports, rules
from listingscope.operators.reports import ListingFilter, SellerFilter
from listingscope.plans.queries_tables import alternatives
from listingscope.plans.registry import COMMUNITIES_SQL, FEATURES_SQL, REPORT_SQL, SCORED_SQL, SELLERS_SQL, Tables, query, rounded, sql

# ---------------------------------------------------------------- filters

SPEC = ListingFilter(score=(2.0, 15.0), price=(500.0, 3000.0), flags=("flag_price_very_low",))
SPEC_SQL = "score BETWEEN 2 AND 15 AND price BETWEEN 500 AND 3000 AND flag_price_very_low = 1"


@query("filtered_listings", sql(REPORT_SQL, f"SELECT listing_id, score, price, risk, status FROM report WHERE {SPEC_SQL}"))
def filtered_listings(t: Tables):
    return t.report().where(SPEC.predicate()).select("listing_id", "score", "price", "risk", "status")


@query("filtered_listings_by_label", sql(REPORT_SQL, "SELECT listing_id, score FROM report WHERE risk = 'medium' AND community = 7 AND status = 'platinum'"))
def filtered_listings_by_label(t: Tables):
    return t.report().where(ListingFilter(risk="medium", community=7, status="platinum").predicate()).select("listing_id", "score")


@query("filter_effect", sql(REPORT_SQL, f"""
SELECT kept, total - kept AS removed, round_even(CAST(kept AS DOUBLE) / total * 100, 1) AS kept_percent, round_even(CAST(bad AS DOUBLE) / kept * 100, 1) AS suspect_rate
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {SPEC_SQL}) AS kept, count(*) FILTER (WHERE {SPEC_SQL} AND suspect = 1) AS bad FROM report)"""))
def filter_effect(t: Tables):
    return reports.filter_effect(t.report(), SPEC)


@query("filter_bounds", sql(REPORT_SQL, "SELECT min(score) AS score_min, max(score) AS score_max, min(price) AS price_min, max(price) AS price_max FROM report"))
def filter_bounds(t: Tables):
    return reports.filter_bounds(t.report())


@query("filter_choices", sql(REPORT_SQL, "SELECT DISTINCT status FROM report WHERE status IS NOT NULL"))
def filter_choices(t: Tables):
    return reports.distinct_values(t.report(), "status")


@query("notable_communities", sql(REPORT_SQL, "SELECT community FROM report GROUP BY community HAVING sum(suspect) * 1e0 / count(*) > 0.6"))
def notable_communities(t: Tables):
    return reports.notable_communities(t.report(), 0.6)


@query("filtered_sellers", sql(SELLERS_SQL, """
SELECT seller_id, listings, suspect_rate FROM sellers WHERE suspect_rate > 50 AND listings >= 10 AND status IN ('gold', 'platinum') AND official = 0
  AND reputation > 1 AND reputation <= 3 AND mean_score >= 4"""))
def filtered_sellers(t: Tables):
    spec = SellerFilter(level="high", min_listings=10, statuses=("gold", "platinum"), official=False, reputation=(1, 3), min_score=4)
    return reports.seller_metrics(t.report()).where(spec.predicate()).select("seller_id", "listings", "suspect_rate")


@query("filtered_communities", sql(COMMUNITIES_SQL, "SELECT community, listings, sellers FROM communities WHERE suspect_rate >= 55 AND sellers >= 2 AND listings >= 100"))
def filtered_communities(t: Tables):
    rows = reports.community_metrics(t.report())
    return rows.where((F.col("suspect_rate") >= 55) & (F.col("sellers") >= 2) & (F.col("listings") >= 100)).select("community", "listings", "sellers")


@query("seller_suspects", sql(REPORT_SQL, "SELECT listing_id, score, price FROM report WHERE seller_id = 7 AND suspect = 1"))
def seller_suspects(t: Tables):
    return reports.seller_listings(t.report(7), 7, suspect=True).select("listing_id", "score", "price")


@query("seller_legitimate", sql(REPORT_SQL, "SELECT listing_id, score, price FROM report WHERE seller_id = 7 AND suspect = 0 ORDER BY score DESC, listing_id LIMIT 10"))
def seller_legitimate(t: Tables):
    return reports.seller_listings(t.report(7), 7, suspect=False, limit=10).select("listing_id", "score", "price")


@query("score_scatter", sql(REPORT_SQL, "SELECT listing_id, price_gap, score, model_score, hybrid, suspect FROM report"))
def score_scatter(t: Tables):
    return t.report().select("listing_id", "price_gap", "score", "model_score", "hybrid", "suspect")


# ---------------------------------------------------------------- sellers and communities

SELLER_COLUMNS = ["seller_id", "seller_name", "listings", "suspects", "mean_score", "mean_price", "mean_gap", "transactions", "status", "official",
                  "reputation", "suspect_rate"]
SELLER_SELECT = """SELECT seller_id, seller_name, listings, suspects, round(mean_score, 6) AS mean_score, round(mean_price, 6) AS mean_price,
  round(mean_gap, 6) AS mean_gap, transactions, status, official, reputation, suspect_rate"""
SELLER_CLASS_SQL = "CASE WHEN suspect_rate = 100 THEN 'critical' WHEN suspect_rate >= 70 THEN 'high' WHEN suspect_rate >= 30 THEN 'medium' ELSE 'low' END"


def sellers(t: Tables):
    return reports.seller_metrics(t.report())


@query("seller_metrics", sql(SELLERS_SQL, SELLER_SELECT + " FROM sellers"))
def seller_metrics(t: Tables):
    return rounded(sellers(t), "mean_score", "mean_price", "mean_gap").select(*SELLER_COLUMNS)


@query("top_sellers", sql(SELLERS_SQL, f"""
SELECT seller_id, seller_name, listings, suspects, suspect_rate, {SELLER_CLASS_SQL} AS class FROM sellers ORDER BY suspects DESC, seller_id LIMIT 20"""))
def top_sellers(t: Tables):
    best = reports.top(sellers(t), "suspects", 20, "seller_id")
    return best.select("seller_id", "seller_name", "listings", "suspects", "suspect_rate", rules.seller_class(F.col("suspect_rate")).alias("class"))


@query("seller_levels", sql(SELLERS_SQL, """
SELECT CASE WHEN suspect_rate = 100 THEN 'critical' WHEN suspect_rate > 50 THEN 'high' WHEN suspect_rate >= 25 THEN 'medium' ELSE 'low' END AS level,
  count(*) AS sellers FROM sellers GROUP BY 1"""))
def seller_levels(t: Tables):
    return sellers(t).groupBy(rules.seller_level(F.col("suspect_rate")).alias("level")).agg(F.count(F.lit(1)).alias("sellers"))


@query("community_metrics", sql(COMMUNITIES_SQL, """
SELECT community, listings, suspects, round(mean_score, 6) AS mean_score, sellers, suspect_rate,
  CASE WHEN suspect_rate >= 80 THEN 'critical' WHEN suspect_rate >= 60 THEN 'high' WHEN suspect_rate >= 30 THEN 'medium' ELSE 'low' END AS class FROM communities"""))
def community_metrics(t: Tables):
    rows = rounded(reports.community_metrics(t.report()), "mean_score")
    return rows.withColumn("class", rules.community_class(F.col("suspect_rate")))


@query("top_communities", sql(COMMUNITIES_SQL, "SELECT community, suspect_rate, sellers FROM communities ORDER BY suspect_rate DESC, community LIMIT 15"))
def top_communities(t: Tables):
    return reports.top(reports.community_metrics(t.report()), "suspect_rate", 15, "community").select("community", "suspect_rate", "sellers")


@query("communities_by_size", sql(COMMUNITIES_SQL, "SELECT community, listings FROM communities ORDER BY listings, community LIMIT 10"))
def communities_by_size(t: Tables):
    return reports.top(reports.community_metrics(t.report()), "listings", 10, "community", ascending=True).select("community", "listings")


@query("status_summary", sql(SELLERS_SQL, """
SELECT status, count(*) AS sellers, CAST(sum(listings) AS BIGINT) AS listings, CAST(sum(suspects) AS BIGINT) AS suspects,
  round_even(avg(suspect_rate), 1) AS mean_rate, round_even(avg(mean_score), 2) AS mean_score FROM sellers WHERE status IS NOT NULL GROUP BY status"""))
def status_summary(t: Tables):
    return reports.status_summary(sellers(t))


@query("top_sellers_in_filter", sql(REPORT_SQL, f"""
SELECT seller_name, count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects FROM report WHERE {SPEC_SQL} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10"""))
def top_sellers_in_filter(t: Tables):
    return reports.top_sellers_by_name(t.report().where(SPEC.predicate()))


@query("action_buckets", sql(SELLERS_SQL, """
SELECT count(*) FILTER (WHERE suspect_rate = 100) AS block_now, count(*) FILTER (WHERE suspect_rate > 50 AND suspect_rate < 100) AS review,
  CAST(sum(suspects) AS BIGINT) AS suspects FROM sellers"""))
def action_buckets(t: Tables):
    return reports.action_buckets(sellers(t))


@query("community_members", sql(REPORT_SQL, """
SELECT seller_id, seller_name, count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects, round(avg(score), 6) AS mean_score, round(avg(price), 6) AS mean_price,
  round_even(CAST(sum(suspect) AS DOUBLE) / count(*) * 100, 1) AS suspect_rate FROM report WHERE community = 7 GROUP BY 1, 2"""))
def community_members(t: Tables):
    return rounded(reports.community_members(t.report(), 7), "mean_score", "mean_price")


@query("network_panel", sql(COMMUNITIES_SQL, """
SELECT count(*) AS communities, count(*) FILTER (WHERE suspect_rate > 50) AS suspect_communities, round(avg(sellers), 6) AS mean_sellers FROM communities"""))
def network_panel(t: Tables):
    return rounded(reports.network_panel(reports.community_metrics(t.report())), "mean_sellers")


@query("sellers_in_communities", sql(REPORT_SQL, "SELECT count(DISTINCT CASE WHEN community > 5 THEN seller_id END) AS in_communities, count(DISTINCT seller_id) AS sellers FROM report"))
def sellers_in_communities(t: Tables):
    return reports.sellers_in_communities(t.report().withColumn("community", F.when(F.col("community") > 5, F.col("community"))))


@query("cluster_buckets", sql(COMMUNITIES_SQL, """
SELECT count(*) FILTER (WHERE suspect_rate >= 80) AS critical, count(*) FILTER (WHERE suspect_rate >= 50 AND suspect_rate < 80) AS high, CAST(sum(suspects) AS BIGINT) AS suspects FROM communities"""))
def cluster_buckets(t: Tables):
    return reports.cluster_buckets(reports.community_metrics(t.report()))


@query("recommendations", sql(COMMUNITIES_SQL, """
SELECT CAST(max(suspect_rate) >= 80 AS INTEGER) AS act_now, CAST(bool_or(suspect_rate >= 50 AND suspect_rate < 80) AS INTEGER) AS investigate,
  CAST(max(sellers) > 20 AS INTEGER) AS watch_large, CAST(avg(suspect_rate) > 50 AS INTEGER) AS systemic, CAST(max(suspect_rate) > 30 AS INTEGER) AS any_problem FROM communities"""))
def recommendations(t: Tables):
    return reports.recommendations(reports.community_metrics(t.report()))


# ---------------------------------------------------------------- panels and distributions

@query("panel", sql(REPORT_SQL, """
SELECT count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects, count(DISTINCT seller_id) AS sellers,
  count(DISTINCT CASE WHEN suspect = 1 THEN seller_id END) AS suspect_sellers, round(sum(CASE WHEN suspect = 1 THEN price END), 4) AS value_at_risk,
  round_even(CAST(sum(suspect) AS DOUBLE) / count(*) * 100, 6) AS detection_rate, round(sum(CASE WHEN suspect = 1 THEN price END) / sum(suspect), 6) AS value_per_suspect FROM report"""))
def panel(t: Tables):
    return rounded(rounded(reports.panel(t.report()), "value_at_risk", digits=4), "value_per_suspect")


@query("risk_counts", sql(REPORT_SQL, "SELECT risk, count(*) AS listings FROM report WHERE risk IS NOT NULL GROUP BY risk"))
def risk_counts(t: Tables):
    return reports.risk_counts(t.report())


@query("risk_means", sql(REPORT_SQL, "SELECT risk, round(avg(score), 6) AS mean_score FROM report WHERE risk IS NOT NULL GROUP BY risk"))
def risk_means(t: Tables):
    return rounded(reports.risk_means(t.report()), "mean_score")


@query("flag_totals", sql(REPORT_SQL, """
SELECT flag, CAST(hits AS BIGINT) AS hits FROM (SELECT sum(flag_price_very_low) AS flag_price_very_low, sum(flag_price_medium_low) AS flag_price_medium_low,
  sum(flag_price_slightly_low) AS flag_price_slightly_low, sum(flag_instant_fraud) AS flag_instant_fraud,
  0 AS flag_image_reuse_high, 0 AS flag_image_reuse_medium, 0 AS flag_new_seller FROM report)
  UNPIVOT (hits FOR flag IN (flag_price_very_low, flag_price_medium_low, flag_price_slightly_low, flag_instant_fraud, flag_image_reuse_high, flag_image_reuse_medium, flag_new_seller))"""))
def flag_totals(t: Tables):
    return reports.flag_totals(t.report(), 7)


@query("score_bands", sql(SCORED_SQL, """
SELECT CASE WHEN score <= 1 THEN '0-1' WHEN score <= 2 THEN '1-2' WHEN score <= 3 THEN '2-3' WHEN score <= 4 THEN '3-4' WHEN score <= 5 THEN '4-5' ELSE '5-100' END AS band,
  count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects FROM scored GROUP BY 1"""))
def score_bands(t: Tables):
    return reports.band_counts(t.scored(), rules.score_band(F.col("score")))


@query("score_summary", sql(SCORED_SQL, """
SELECT count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects, round(avg(suspect), 6) AS suspect_rate, min(score) AS score_min, max(score) AS score_max, round(avg(score), 6) AS score_mean FROM scored"""))
def score_summary(t: Tables):
    return rounded(reports.score_summary(t.scored()), "suspect_rate", "score_mean")


@query("score_median", sql(SCORED_SQL, "SELECT median(score) AS median FROM scored"))
def score_median(t: Tables):
    return quantiles.exact_quantiles(t.scored(), "score", {"median": 0.5})


def _histogram_sql(ctes: str, table: str, value: str, bins: int) -> str:
    return sql(ctes, f"""
SELECT CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / (hi - lo) * {bins}) END, {bins - 1}) AS INTEGER) AS bin, count(*) AS n,
  round(min(v), 6) AS low, round(max(v), 6) AS high
FROM (SELECT CAST({value} AS DOUBLE) AS v, min(CAST({value} AS DOUBLE)) OVER () AS lo, max(CAST({value} AS DOUBLE)) OVER () AS hi FROM {table}) GROUP BY 1""")


HISTOGRAMS = (
    ("score_histogram", REPORT_SQL, "report", "score", 20),
    ("model_histogram", REPORT_SQL, "report", "model_score", 30),
    ("hybrid_histogram", REPORT_SQL, "report", "hybrid", 30),
    ("seller_rate_histogram", SELLERS_SQL, "sellers", "suspect_rate", 20),
    ("community_size_histogram", COMMUNITIES_SQL, "communities", "listings", 15),
    ("community_sellers_histogram", COMMUNITIES_SQL, "communities", "sellers", 15),
)
for _name, _ctes, _table, _value, _bins in HISTOGRAMS:
    @query(_name, _histogram_sql(_ctes, _table, _value, _bins))
    def _histogram(t: Tables, table=_table, value=_value, bins=_bins):
        rows = {"report": t.report, "sellers": lambda: sellers(t), "communities": lambda: reports.community_metrics(t.report())}[table]()
        return rounded(quantiles.histogram(rows, value, bins), "low", "high")


@query("community_score_histogram", _histogram_sql(REPORT_SQL + ", one AS (SELECT score FROM report WHERE community = 3)", "one", "score", 20))
def community_score_histogram(t: Tables):
    """Scores of the listings of one community."""
    return rounded(quantiles.histogram(t.report().where("community = 3"), "score", 20), "low", "high")


@query("price_boxes", sql(REPORT_SQL, """
SELECT suspect, count(*) AS n, min(price) AS min, max(price) AS max, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
  min(price) FILTER (WHERE price >= q1 - 1.5 * (q3 - q1)) AS low_fence, max(price) FILTER (WHERE price <= q3 + 1.5 * (q3 - q1)) AS high_fence
FROM report JOIN (SELECT suspect, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM report GROUP BY suspect) USING (suspect)
GROUP BY suspect"""))
def price_boxes(t: Tables):
    return rounded(quantiles.box_stats(t.report(), "price", "suspect"), "q1", "median", "q3")


@query("score_spread", sql(REPORT_SQL, """
SELECT 'score' AS "column", round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std FROM report
UNION ALL SELECT 'model_score', round(avg(model_score), 6), round(stddev_samp(model_score), 6) FROM report
UNION ALL SELECT 'hybrid', round(avg(hybrid), 6), round(stddev_samp(hybrid), 6) FROM report"""))
def score_spread(t: Tables):
    return rounded(reports.spread(t.report(), ["score", "model_score", "hybrid"]), "mean", "std")


@query("hybrid_median", sql(REPORT_SQL, "SELECT round(median(hybrid), 6) AS median FROM report"))
def hybrid_median(t: Tables):
    return rounded(quantiles.exact_quantiles(t.report(), "hybrid", {"median": 0.5}), "median")


@query("top_hybrid", sql(REPORT_SQL, """
SELECT listing_id, hybrid, score, CASE suspect WHEN 1 THEN 'suspect' ELSE 'legitimate' END AS label FROM report ORDER BY hybrid DESC, listing_id LIMIT 20"""))
def top_hybrid(t: Tables):
    return reports.top(t.report(), "hybrid", 20, "listing_id").select("listing_id", "hybrid", "score", rules.class_label(F.col("suspect")).alias("label"))


@query("ranked_listings", sql(REPORT_SQL, "SELECT listing_id, score, risk FROM report"))
def ranked_listings(t: Tables):
    return reports.top(t.report(), "score", None, "listing_id").select("listing_id", "score", "risk")


@query("threshold_counts", sql(REPORT_SQL, """
SELECT 'score' AS "column", count(*) FILTER (WHERE score >= 3) AS n, round_even(CAST(count(*) FILTER (WHERE score >= 3) AS DOUBLE) / count(*) * 100, 1) AS percent FROM report
UNION ALL SELECT 'model_score', count(*) FILTER (WHERE model_score >= 0.5), round_even(CAST(count(*) FILTER (WHERE model_score >= 0.5) AS DOUBLE) / count(*) * 100, 1) FROM report
UNION ALL SELECT 'hybrid', count(*) FILTER (WHERE hybrid >= 0.6), round_even(CAST(count(*) FILTER (WHERE hybrid >= 0.6) AS DOUBLE) / count(*) * 100, 1) FROM report"""))
def threshold_counts(t: Tables):
    return reports.threshold_counts(t.report(), {"score": 3, "model_score": 0.5, "hybrid": 0.6})


@query("executive_summary", sql(SELLERS_SQL, """
SELECT (SELECT count(*) FROM report WHERE risk = 'critical') AS critical, (SELECT count(*) FROM report WHERE risk = 'high') AS high,
  (SELECT round(avg(price), 6) FROM report WHERE suspect = 1) AS price_suspect, (SELECT round(avg(price), 6) FROM report WHERE suspect = 0) AS price_legitimate,
  (SELECT count(*) FROM sellers WHERE suspect_rate = 100) AS sellers_all, (SELECT count(*) FROM sellers WHERE suspect_rate > 50) AS sellers_half"""))
def executive_summary(t: Tables):
    return rounded(reports.executive_summary(t.report(), sellers(t)), "price_suspect", "price_legitimate")


DESCRIBED = ("price", "price_gap", "negative_share", "transactions")


@query("describe_features", sql(FEATURES_SQL, " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(CAST(min({c}) AS DOUBLE), 3) AS min, round(CAST(max({c}) AS DOUBLE), 3) AS max,
  round(quantile_cont({c}, 0.25), 3) AS q1, round(quantile_cont({c}, 0.5), 3) AS median, round(quantile_cont({c}, 0.75), 3) AS q3 FROM features""" for c in DESCRIBED)))
def describe_features(t: Tables):
    return rounded(quantiles.describe(t.features(), DESCRIBED), "mean", "std", "min", "max", "q1", "median", "q3", digits=3)


CORRELATED = ("price", "price_gap", "negative_share", "reputation", "transactions", "official", "image_reuse")


@query("target_correlations", sql(SCORED_SQL, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(corr({c}, suspect), 6) AS correlation FROM scored""" for c in CORRELATED)))
def target_correlations(t: Tables):
    return rounded(reports.correlations(t.scored(), CORRELATED, "suspect"), "correlation")


@query("gap_trimmed_mean", sql(FEATURES_SQL, """
SELECT round(avg(price_gap) FILTER (WHERE price_gap BETWEEN -1 AND 2), 6) AS mean, count(*) FILTER (WHERE price_gap BETWEEN -1 AND 2) AS kept, count(price_gap) AS known FROM features"""))
def gap_trimmed_mean(t: Tables):
    return rounded(reports.trimmed_mean(t.features(), "price_gap"), "mean")


@query("feature_summary", sql(FEATURES_SQL, """
SELECT round(avg(negative_share), 6) AS negative_mean, max(negative_share) AS negative_max, round(avg(weighted_rating), 6) AS rating_mean, round(max(weighted_rating), 6) AS rating_max,
  CAST(sum(xl_mismatch) AS BIGINT) AS mismatches, round(avg(xl_mismatch), 6) AS mismatch_share, count(price_gap) AS gap_known FROM features"""))
def feature_summary(t: Tables):
    return rounded(reports.feature_summary(t.features()), "negative_mean", "rating_mean", "rating_max", "mismatch_share")


@query("unify_summary", sql(FEATURES_SQL, """
SELECT kind, count(*) AS listings, count(*) FILTER (WHERE neg_reviews > 0) AS with_reviews, CAST(sum(neg_reviews) AS BIGINT) AS reviews, count(DISTINCT seller_id) AS sellers
FROM features GROUP BY kind"""))
def unify_summary(t: Tables):
    return enrich.unify_summary(t.listings(), "kind", "neg_reviews")


@query("crawl_summary", """
SELECT l_returnflag AS term, count(*) AS found, count(*) FILTER (WHERE l_quantity >= 10) AS extracted, count(*) FILTER (WHERE l_quantity < 5) AS skipped,
  count(*) FILTER (WHERE l_linenumber > 1) AS with_reviews, CAST(sum(l_linenumber - 1) AS BIGINT) AS reviews FROM lineitem GROUP BY 1""")
def crawl_summary(t: Tables):
    status = F.when(F.col("l_quantity") >= 10, "ok").when(F.col("l_quantity") < 5, "skipped").otherwise("failed")
    items = t["lineitem"].select(F.col("l_returnflag").alias("term"), status.alias("status"), (F.col("l_linenumber") - 1).alias("n_reviews"))
    return reports.crawl_summary(items, "term")


@query("alternative_counts", """
SELECT a.l_suppkey AS seller_id, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 AND a.l_linenumber > 1 GROUP BY 1""")
def alternative_counts(t: Tables):
    return alternatives(t).groupBy("seller_id").agg(F.count(F.lit(1)).alias("n"))


@query("model_quality", sql(REPORT_SQL, """
SELECT tp, fp, fn, tn, round(tp * 1e0 / (tp + fp), 6) AS precision, round(tp * 1e0 / (tp + fn), 6) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (
  SELECT count(*) FILTER (WHERE suspect = 1 AND model_score > 0.5) AS tp, count(*) FILTER (WHERE suspect = 0 AND model_score > 0.5) AS fp,
         count(*) FILTER (WHERE suspect = 1 AND NOT model_score > 0.5) AS fn, count(*) FILTER (WHERE suspect = 0 AND NOT model_score > 0.5) AS tn FROM report)"""))
def model_quality(t: Tables):
    from listingscope.operators.ridge import quality

    return rounded(quality(t.report().withColumn("predicted", C.flag(F.col("model_score") > 0.5))), "precision", "recall", "f1")
