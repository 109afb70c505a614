"""Forecast frame, reports and stock figures."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import encoding, forecasting, metrics
from shelfcast.operators.anchors import daily_volatility, last_known_metrics
from shelfcast.operators.history import compact_history
from shelfcast.operators.inventory import inventory_plan
from shelfcast.operators.weekly import weekly_demand
from shelfcast.plans.planning import bulk_forecast, forecast, last_prices, stock_plan

START = datetime.date(2024, 3, 3)


@pytest.fixture
def sales(make_sales):
    rows = [("East", "A", "p", f"2024-02-{d:02d}", float(d)) for d in (4, 11, 18, 25)]
    rows += [("East", "B", "q", "2024-02-20", 7.0), ("West", "B", "r", "2024-04-01", 9.0)]
    return make_sales(rows)


def predictions(spark, values, pair=("A", "p")):
    rows = [("East", *pair, i, START + datetime.timedelta(weeks=i), 3.0, v) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows,
        "RegionName string, StoreName string, ProductName string, week_index int, week_start date, "
        "last_week_qty double, prediction double",
    )


def test_every_selectable_series_is_forecast(sales):
    got = forecast(sales, start=START, weeks=2)
    series = {(r.RegionName, r.StoreName, r.ProductName) for r in got.collect()}
    # Both products of store B can be selected in both of its regions.
    assert series == {("East", "A", "p")} | {(r, "B", p) for r in ("East", "West") for p in "qr"}
    by_pair = {(r.StoreName, r.ProductName): r.prediction for r in got.collect()}
    assert by_pair[("A", "p")] == 14.5 and by_pair[("B", "q")] == 7.0
    # Sales after the start are not known yet.
    assert by_pair[("B", "r")] == 0.0


def test_compact_history_gives_the_same_figures(spark, make_sales):
    rng = random.Random(12)
    rows = []
    for _ in range(400):
        store = "A" if rng.random() < 0.5 else f"S{rng.randint(0, 3)}"
        when = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 80), hours=rng.randint(0, 2))
        rows.append(("East", store, rng.choice("pq"), when.isoformat(sep=" "), float(rng.randint(0, 9))))
    sales = make_sales(rows).withColumns(
        {s.TRUE_DEMAND_RAW: F.col(s.QUANTITY) + 1, s.CASHBACK_RAW: F.concat(F.col(s.QUANTITY).cast("string"), F.lit(" pct"))}
    )
    compact = compact_history(sales)
    assert compact.agg(F.sum("lines")).first()[0] == 400
    for figures in (last_known_metrics, daily_volatility):
        want, got = (
            {(r[0], r[1]): list(r)[2:] for r in figures(t).collect()} for t in (sales, compact)
        )
        assert got.keys() == want.keys()
        for pair, values in want.items():
            assert got[pair] == pytest.approx(values)


def test_future_frame_is_flat(sales):
    rows = forecast(sales, start=START, weeks=3).where("StoreName = 'A'").orderBy("week_index").collect()
    assert [r.week_start for r in rows] == [START + datetime.timedelta(weeks=i) for i in range(3)]
    first = rows[0]
    assert first.Lag_12_Week == 25.0 and first.Rolling_Mean_2 == 14.5
    assert first.Rolling_Std_8 == pytest.approx(14.5 * 0.15)
    assert (first.DiscountPct, first.Effective_Price, first.Discount_Intensity) == (0.05, 100.0, 0)
    assert (first.Is_Month_Start, first.Is_Month_End, rows[2].Is_Month_Start) == (1, 0, 0)


def test_known_prices_replace_the_assumption(sales):
    prices = last_prices(_priced(sales))
    row = forecast(sales, start=START, weeks=1, prices=prices).where("StoreName = 'A'").first()
    assert row.DiscountPct == 0.0 and row.Effective_Price == 100.0


def _priced(sales):
    from shelfcast.plans.features import add_price_features

    return add_price_features(weekly_demand(sales))


def test_unseen_labels(spark, sales):
    seen = weekly_demand(sales.where("StoreName = 'A' OR ProductName = 'q'")).select(
        *s.SERIES, F.month(s.WEEK_END).alias("Month")
    )
    seen = seen.where("ProductName = 'q' OR Month = 2").unionByName(
        spark.createDataFrame([("East", "A", "p", 3)], seen.schema)
    )
    enc = encoding.fit_encoders(seen)
    frame = forecast(sales, start=START, weeks=3)
    rows = {
        (r.RegionName, r.StoreName, r.ProductName, r.week_index): r
        for r in forecasting.encode_future(frame, enc, start=START, weeks=3).collect()
    }
    assert len(rows) == frame.count()
    known = rows[("East", "A", "p", 0)]
    assert known.Status is None and known.Month_Product_ID > 0
    # March was never seen for q, so none of its weeks has a code.
    assert rows[("East", "B", "q", 0)].Month_Product_ID == 0
    failed = rows[("West", "B", "r", 0)]
    assert failed.Status == "Failed: unseen label West, r"


def test_future_codes_without_combination_tables(sales):
    seen = weekly_demand(sales).select(*s.SERIES, F.month(s.WEEK_END).alias("Month"))
    full = encoding.fit_encoders(seen)
    old = encoding.Encoders(full.region, full.store, full.product)
    rows = forecasting.encode_future(forecast(sales, start=START, weeks=1), old, start=START, weeks=1).collect()
    assert {(r.Product_Store_ID, r.Month_Product_ID) for r in rows} == {(0, 0)}


def test_bulk_report_horizons(spark):
    bulk = forecasting.bulk_report(predictions(spark, [0.5, 1.0, 1.0, 0.0] + [1.0] * 5), start=START).first()
    assert (bulk["30_Day_Forecast"], bulk["60_Day_Forecast"], bulk["Current_Weekly_Velocity"]) == (2, 8, 3.0)
    assert (bulk["Forecast_Start_Date"], bulk["Status"]) == ("2024-03-03", None)


def test_failed_series_are_reported_with_zeros(spark):
    failed = predictions(spark, [None] * 9).withColumn("Status", F.lit("Failed: unseen label StoreName"))
    bulk = forecasting.bulk_report(failed, start=START).first()
    assert (bulk["30_Day_Forecast"], bulk["60_Day_Forecast"]) == (0, 0) and bulk["Status"].startswith("Failed")


def test_product_report_and_summary(spark, sales):
    rows = forecasting.product_report(predictions(spark, [0.5, 1.5]), start=START).orderBy("Week_Starting").collect()
    assert [(r.Week_Starting, r.Week_Ending, r.Forecasted_Units) for r in rows] == [
        ("2024-03-03", "2024-03-09", 0),
        ("2024-03-10", "2024-03-16", 2),
    ]
    bulk = bulk_forecast(sales, start=START)
    row = forecasting.summary_input(bulk).where("product_name = 'p'").first()
    assert row.predictions == [14.5] * 4 and row.historical_avg == 25.0


def test_stock_figures(spark):
    volatility = spark.createDataFrame([("A", "p", 4.0)], "StoreName string, ProductName string, daily_sigma double")
    row = inventory_plan(predictions(spark, [10.0] * 5), volatility, horizon_days=30, lead_time_days=9, growth_pct=10).first()
    assert row.total_demand == 50 and row.daily_velocity == pytest.approx(50 / 30)
    assert row.safety_stock == round(1.65 * 4.0 * 3)
    assert row.reorder_point == round(50 / 30 * 9 + row.safety_stock)
    assert (row.procurement_quantity, row.estimated_stock) == (55, int(row.reorder_point * 0.8))


def test_safety_stock_grows_with_the_lead_time(spark):
    none = spark.createDataFrame([], "StoreName string, ProductName string, daily_sigma double")
    stocks = [
        inventory_plan(predictions(spark, [60.0] * 5), none, lead_time_days=days).first().safety_stock
        for days in (7, 30, 60)
    ]
    assert stocks == sorted(stocks) and stocks[0] == round(1.65 * (300 / 30 * 0.15) * 7**0.5)


def test_plan_has_one_row_per_series(sales):
    plan = stock_plan(sales, start=START)
    assert plan.count() == 5 and plan.where("total_demand < 0 OR safety_stock < 0").count() == 0


def test_metrics_by_hand(spark):
    scored = spark.createDataFrame([(4, 3.0), (0, 1.0), (6, 6.0)], "Quantity long, prediction double")
    row = metrics.regression_metrics(scored).first()
    assert row.mae == pytest.approx(2 / 3) and row.rmse == pytest.approx((2 / 3) ** 0.5)
    assert row.wape == pytest.approx(2 / (10 + 1e-5) * 100) and row.accuracy == pytest.approx(100 - row.wape)
    assert row.mape == pytest.approx((1 / (4 + 1e-5) + 1 / 1e-5 + 0) / 3 * 100)
    assert row.smape == pytest.approx((2 / 7.00001 + 2 / 1.00001 + 0) / 3 * 100)


def test_first_of_equal_models_wins(spark):
    rows = spark.createDataFrame([(0, "a", 2.0), (1, "b", 1.0), (2, "c", 1.0), (3, "d", None)], "position int, model string, mae double")
    assert metrics.best_model(rows).first().model == "b"
    assert metrics.best_model(rows.where("model = 'd'")).count() == 0


def test_align_fills_and_orders(sales):
    frame = forecasting.align(forecast(sales, start=START, weeks=1), keep=(s.STORE,))
    assert frame.columns == [s.STORE, *s.FEATURES] and len(s.FEATURES) == 48
    assert frame.agg(F.sum("RegionID")).first()[0] == 0.0
