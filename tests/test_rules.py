"""Bands at their edges and the fidelity traps of the scoring."""

import pytest
from pyspark.sql import functions as F

from listingscope.functions import columns as C
from listingscope.functions import listing as L
from listingscope.operators import reports, rules

SCHEMA = "id int, price_gap double, image_reuse int, reputation int, negative_share double, xl_mismatch int, transactions int, official int"


def scores(table, *rows, **kw):
    out = rules.score(table(SCHEMA, *rows), **kw).orderBy("id").collect()
    return [r.score for r in out], out


def test_price_bands_at_their_edges(table):
    found, rows = scores(table, *[(i, g, 1, 5, 0.0, 0, 99, 0) for i, g in enumerate((-0.301, -0.30, -0.15, -0.05, None))])
    assert found == [10.0, 1.0, 0.5, 0.0, 0.0]
    assert [r.flag_instant_fraud for r in rows] == [1, 0, 0, 0, 0]
    assert [r.flag_price_medium_low for r in rows] == [0, 1, 0, 0, 0]


def test_reuse_share_and_transactions_at_their_edges(table):
    found, _ = scores(table, *[(i, None, n, None, None, 0, None, 0) for i, n in enumerate((2, 3, 10, 11))])
    assert found == [0.0, 1.0, 1.0, 2.0]
    found, _ = scores(table, *[(i, None, 1, None, s, 0, None, 0) for i, s in enumerate((0.14, 0.15, 0.30, 0.31))])
    assert found == [0.0, 0.5, 0.5, 2.0]
    found, _ = scores(table, *[(i, None, 1, None, None, 0, n, 0) for i, n in enumerate((49, 50, None))])
    assert found == [1.0, 0.0, 0.0]


def test_official_store_pays_only_from_two_points(table):
    found, _ = scores(table, (1, -0.2, 1, 5, 0.2, 0, 99, 1), (2, -0.2, 3, 5, 0.0, 0, 99, 1))
    assert found == [1.5, 3.0]


def test_as_coded_gaps_and_documented_mode(table):  # T1
    row = (1, -0.2, 11, 1, 0.5, 1, 10, 1)
    coded, (r,) = scores(table, row)
    assert coded == [1 + 2 + 2 + 2 + 1 + 1]
    assert (r.flag_xl_mismatch, r.flag_image_reuse_high, r.flag_new_seller, r.flag_price_medium_low) == (0, 0, 0, 1)
    documented, (r,) = scores(table, row, mode="as_documented")
    assert documented == [coded[0] + 1]
    assert (r.flag_xl_mismatch, r.flag_image_reuse_high, r.flag_official_suspect) == (1, 1, 1)
    with pytest.raises(ValueError):
        scores(table, row, mode="other")


def test_highest_score(table):
    assert scores(table, (1, -0.9, 11, 1, 0.9, 1, 0, 1))[0] == [18.0]
    assert scores(table, (1, -0.9, 11, 1, 0.9, 1, 0, 1), mode="as_documented")[0] == [19.0]


def test_missing_columns_skip_their_rules(table):
    df = table("id int, price_gap double", (1, -0.5))
    assert rules.score(df).first().score == 10.0


def test_extra_rule_and_pandas_test(spark, table):  # N3
    import pandas as pd
    from pyspark.sql.types import BooleanType

    @F.pandas_udf(BooleanType())
    def cheap(s: pd.Series) -> pd.Series:
        return s < 10

    extra = rules.Rule("cheap", 4.0, lambda running: cheap(F.col("price")), ("price",), flag_live=True)
    df = table("id int, price double", (1, 5.0), (2, 50.0))
    found = rules.score(df, (extra,)).orderBy("id").collect()
    assert [(r.score, r.flag_cheap, r.suspect) for r in found] == [(4.0, 1, 1), (0.0, 0, 0)]


def test_risk_bands_and_open_end(table):  # T2
    df = table("s double", *[(x,) for x in (0.0, 3.0, 3.0001, 6.0, 8.0, 10.0, 10.5, None)])
    closed = [r[0] for r in df.select(rules.risk_category(F.col("s"))).collect()]
    assert closed == ["low", "low", "medium", "medium", "high", "critical", None, None]
    assert df.select(rules.risk_category(F.col("s"), True)).collect()[6][0] == "critical"


def test_half_even_rounding(table):  # T5
    df = table("x double", (12.25,), (12.35,), (0.15,))
    assert [r[0] for r in df.select(C.round_even(F.col("x"), 1)).collect()] == [12.2, 12.4, 0.2]


def test_nan_is_missing(table):  # T4
    df = table("x double", (float("nan"),), (11.0,))
    assert [r[0] for r in df.select(C.flag(C.nan_to_null(F.col("x")) > 10)).collect()] == [0, 1]


def test_bad_numbers_do_not_raise(table):  # T19
    df = table("s string", ("12",), ("1x",), ("99999999999999999999",), (None,))
    assert [r[0] for r in df.select(C.digits_to_long(F.col("s"))).collect()] == [12, None, None, None]
    assert df.select(C.decimal_comma(F.lit("12,5"))).first()[0] == 12.5


def test_blank_is_missing(table):  # T3
    df = table("s string", ("",), ("N/A",), ("7",), (None,))
    assert [r[0] for r in df.select(L.is_official(F.col("s"))).collect()] == [0, 0, 1, 0]


def test_empty_input_gives_no_division_error(table):  # T16
    from listingscope.operators import enrich, reports

    none = table("listing_id long, seller_id long, score double, suspect int, price double, risk string, matched int")
    assert reports.filter_effect(none, reports.ListingFilter()).first().kept == 0
    assert enrich.match_rate(none).first().rate == 0.0
    assert enrich.coverage(none).count() == 7


KITS = "id int, cartridge_type string, colours struct<preto:int, colorido:int>, quantity int"


def test_suggested_prices(table):  # D10, F8, T11
    prices = L.price_table(table("product string, family string, suggested_price double, line_no long",
                                 ("Cartucho Preto", "HP 664", 50.0, 1), ("Cartucho Preto", "HP 664", 60.0, 2), ("Cartucho Tricolor", "HP 664", 80.0, 3)))
    kits = table(KITS, (1, "664", (1, 0), 1), (2, " 664", (1, 1), 2), (3, "664", (0, 1), 3), (4, "664", (1, 1), 3), (5, "664", (1, 1), 1),
                 (6, "664", None, 1), (7, "664", (0, 0), None), (8, "999", (1, 0), 1))
    found = {r.id: r.suggested_price for r in L.suggested_price(kits, prices).collect()}
    assert found == {1: 60.0, 2: 140.0, 3: 240.0, 4: None, 5: 60.0, 6: None, 7: 80.0, 8: None}


def test_bands_read_a_score_that_is_computed_once(spark):
    rows = spark.range(30).selectExpr("id", "id / 20 - 1 as price_gap", "id % 13 as image_reuse", "id % 5 as reputation", "id / 60 as negative_share", "0 as xl_mismatch",
                                      "id * 5 as transactions", "id % 2 as official")
    scored = rules.score(rows)
    found = reports.band_counts(scored, rules.score_band(F.col("score")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("THEN 8.0") == 1
    assert found.agg(F.sum("listings"), F.sum("suspects")).first() == scored.agg(F.count("*"), F.sum("suspect")).first()
    none = reports.band_counts(scored.withColumn("score", F.lit(-1.0)), rules.score_band(F.col("score")))
    assert none.count() == 0


def test_one_seller_has_the_rows_of_the_whole_report(spark):
    from listingscope.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, t.report(7).collect())) == sorted(map(str, t.report().where("seller_id = 7").collect()))
