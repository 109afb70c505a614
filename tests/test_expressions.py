"""Small cases of the row-level expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions import pricing, states, text
from shelfcast.operators import cleaning


def column(spark, values, kind):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, v {kind}")


def apply(spark, values, kind, f):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("v"))).collect()]


def test_first_number(spark):
    got = apply(spark, ["HDFC 7.5%", "2 to 3%", "-4", "no offer", None, "a+1.50b"], "string", text.first_number)
    assert got == [7.5, 2.0, -4.0, 0.0, 0.0, 1.5]


def test_offer_flag(spark):
    got = apply(spark, ["HDFC", " No ", "N/A", "", None, "\tnone\n", "nan", "0"], "string", text.offer_flag)
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_number_or_zero(spark):
    got = apply(spark, ["12", " 3.5 ", "12 units", "1d", "NaN", "-2e1", ".5", None], "string", text.number_or_zero)
    assert got == [12.0, 3.5, 0.0, 0.0, 0.0, -20.0, 0.5, 0.0]


def test_discount_band(spark):
    values = [0.0, 0.05, 0.051, 0.15, 0.3, 1.0, 1.2, -0.1, None]
    assert apply(spark, values, "double", pricing.discount_band) == [0, 0, 1, 1, 2, 3, 0, 0, 0]


def test_offer_band(spark):
    values = [-1.0, -0.5, 0.0, 0.1, 2.0, 5.0, 10.0, 100.0, 101.0]
    assert apply(spark, values, "double", pricing.offer_band) == [0, 0, 0, 1, 1, 2, 3, 4, 0]


def test_whole_units(spark):
    assert apply(spark, [0.5, 1.5, 2.5, -3.0, 7.2], "double", pricing.whole_units) == [0, 2, 2, 0, 7]


def test_zero_divisors(spark):
    row = (
        spark.range(1)
        .select(
            pricing.discount_pct(F.lit(5.0), F.lit(0.0), F.lit(0.0)),
            pricing.discount_pct(F.lit(5.0), F.lit(-1e-5), F.lit(1.0)),
            pricing.discount_pct(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)),
        )
        .first()
    )
    assert list(row) == [pytest.approx(5e5), 0.0, 0.0]


def test_states(spark):
    names = ["Tamil Nadu", "TAMILNADU", "ka", " Delhi ", "Atlantis 9", None, "Jammu & Kashmir"]
    assert apply(spark, names, "string", states.state_code) == ["TN", "TN", "KA", "DL", "Atlantis", None, "Jammukashmir"]
    strict = apply(spark, names, "string", lambda c: states.state_code(c, reference_case=True))
    assert strict == ["Tamilnadu", "Tamilnadu", "KA", "DL", "Atlantis", None, "Jammukashmir"]


def test_week_end_is_the_sunday(spark):
    days = [datetime.date(2024, 1, d) for d in (6, 7, 8)]
    expected = [datetime.date(2024, 1, 7), datetime.date(2024, 1, 7), datetime.date(2024, 1, 14)]
    assert apply(spark, days, "date", cal.week_end) == expected


def test_iso_week_with_calendar_year(spark):
    parts = cal.week_parts(F.col("v"))
    row = column(spark, [datetime.date(2023, 1, 1)], "date").select(parts["Year"], parts["Week"]).first()
    assert list(row) == [2023, 52]


def test_weeks_in_horizon():
    assert [cal.weeks_in_horizon(d) for d in (7, 30, 60)] == [1, 5, 9]


def test_rolling_window_clamps_leap_day(spark, make_sales):
    sales = make_sales(
        [
            ("R", "S", "P", "2021-02-28 12:59", 1.0),
            ("R", "S", "P", "2021-02-28 13:00", 2.0),
            ("R", "S", "P", "2024-02-29 13:00", 3.0),
        ]
    )
    kept = cleaning.retraining_window(sales, strategy="rolling")
    assert sorted(r.Quantity for r in kept.collect()) == [2.0, 3.0]
    assert cleaning.retraining_window(sales, strategy="full").count() == 3


def test_bad_dates_are_dropped(spark):
    sales = spark.createDataFrame([("2024-01-05",), ("05/01/2024",), ("",), (None,), ("2024-01-05 10:30:00",)], "BillDate string")
    assert cleaning.parse_bill_date(sales).count() == 2
    with pytest.raises(ValueError):
        cleaning.require_rows(cleaning.parse_bill_date(sales.where("BillDate = ''")))


def test_cutoff_is_midnight(make_sales):
    sales = make_sales([("R", "S", "P", "2024-01-05", 1.0), ("R", "S", "P", "2024-01-05 00:01", 2.0)])
    assert [r.Quantity for r in cleaning.up_to(sales, datetime.date(2024, 1, 5)).collect()] == [1.0]
