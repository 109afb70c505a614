"""Holidays, side tables, label codes and the split."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import encoding, external, holidays, split
from shelfcast.operators.weekly import weekly_demand

DATE = datetime.date.fromisoformat


def calendar_of(spark, rows):
    return spark.createDataFrame([(c, DATE(d), n) for c, d, n in rows], s.HOLIDAY_SCHEMA)


@pytest.fixture
def calendar(spark):
    return calendar_of(
        spark,
        [
            (None, "2024-01-01", "New Year"),
            (None, "2024-01-26", "Republic Day"),
            (None, "2024-12-25", "Christmas"),
            (None, "2025-01-01", "New Year"),
            ("KA", "2024-11-01", "Rajyotsava"),
            ("KA", "2024-01-01", "State day"),
        ],
    )


def weeks_of(spark, rows):
    return spark.createDataFrame([(r, DATE(d)) for r, d in rows], "RegionName string, week_end date")


def test_holiday_distances(spark, calendar):
    weeks = weeks_of(spark, [("Delhi", "2024-01-07"), ("Delhi", "2024-12-29"), ("Karnataka", "2024-11-03"), (None, "2024-01-07")])
    got = {
        (r.RegionName, r.week_end.isoformat()): (
            r.Holiday_Count,
            r.Is_Holiday_Week,
            r.Days_to_Next_Holiday,
            r.Days_since_Last_Holiday,
        )
        for r in holidays.add_holiday_features(weeks, calendar).collect()
    }
    assert got[("Delhi", "2024-01-07")] == (1, 1, 19, 6)
    # Holidays of a year without data do not count.
    assert got[("Delhi", "2024-12-29")] == (1, 1, 365, 4)
    assert got[("Karnataka", "2024-11-03")] == (1, 1, 52, 2)
    assert got[(None, "2024-01-07")] == (0, 0, 365, 365)


def test_holiday_features_by_hand(spark):
    rng = random.Random(9)
    year = [DATE("2023-01-01") + datetime.timedelta(days=i) for i in range(730)]
    rows = [(rng.choice([None, "KA", "MH"]), d.isoformat(), "x") for d in rng.sample(year, 40)]
    regions = {"Karnataka": "KA", "mh": "MH", "Nowhere": None}
    weeks = [(r, d) for r in regions for d in rng.sample(year, 60)] + [("mh", year[0]), ("mh", year[-1])]
    frame = weeks_of(spark, [(r, d.isoformat()) for r, d in weeks])
    got = holidays.add_holiday_features(frame, calendar_of(spark, rows)).collect()
    assert len(got) == len(weeks)
    for r in got:
        dates = sorted({DATE(d) for code, d, _ in rows if code is None or code == regions[r.RegionName]})
        w = r.week_end
        inside = [d for d in dates if w - datetime.timedelta(days=6) <= d <= w]
        assert r.Holiday_Count == len(inside) and r.Is_Holiday == int(w in dates)
        assert r.Days_to_Next_Holiday == min([(d - w).days for d in dates if d > w], default=365)
        assert r.Days_since_Last_Holiday == min([(w - d).days for d in dates if d < w], default=365)


def test_window_and_impact(spark, calendar):
    regions = weeks_of(spark, [("Karnataka", "2024-01-07"), ("Delhi", "2024-01-07")])
    window = holidays.holidays_in_window(regions, calendar, start=DATE("2024-12-20"), horizon_days=30)
    assert window.where("RegionName = 'Delhi'").count() == 2
    impact = holidays.holiday_impact(window).where("RegionName = 'Karnataka'").first()
    assert (impact.holidays, impact.first_date, impact.first_holiday) == (2, DATE("2024-12-25"), "Christmas")


def side(spark, rows):
    return spark.createDataFrame(
        [(DATE("2024-01-01"), *r) for r in rows], s.SIDE_TABLES["bank_offers"]
    )


def panel(spark, weeks):
    return spark.createDataFrame([("R", "S", "P", 2024, 1, w) for w in weeks], "RegionName string, StoreName string, ProductName string, Year int, Month int, Week int")


def offered(weeks, offers, **options):
    return external.add_side_tables(weeks, {"bank_offers": offers}, **options)


def test_duplicate_keys_of_a_side_table(spark):
    weeks, offers = panel(spark, [1, 2, 3]), side(spark, [(2024, 1, 1.0, 5.0), (2024, 1, 3.0, 5.0), (2024, 3, 7.0, None)])
    assert offered(weeks, offers).count() == 4
    merged = offered(weeks, offers, on_duplicate="mean").orderBy("Week").collect()
    assert [(r.Bank_Offer_Intensity, r.Card_Promotion_Level) for r in merged] == [(2.0, 5.0), (0.0, 0.0), (7.0, 0.0)]
    with pytest.raises(ValueError):
        offered(weeks, offers, on_duplicate="error")


def test_mean_fill_counts_panel_rows(spark):
    weather = spark.createDataFrame(
        [(DATE("2024-01-01"), 2024, 1, 10.0, 1.0, 1.0, None)], s.SIDE_TABLES["weather"]
    )
    months = panel(spark, [1, 2, 3]).unionByName(panel(spark, [5]).withColumn("Month", F.lit(2)))
    filled = external.add_side_tables(months, {"weather": weather}).collect()
    assert {r.Avg_Temperature_C for r in filled} == {10.0} and {r.Weather_Index for r in filled} == {None}


def test_duplicates_weigh_in_later_means(spark):
    offers = side(spark, [(2024, 1, 1.0, 5.0), (2024, 1, 3.0, 5.0)])
    weather = spark.createDataFrame(
        [(DATE("2024-01-01"), 2024, m, v, 1.0, 1.0, 1.0) for m, v in ((1, 10.0), (2, 40.0))], s.SIDE_TABLES["weather"]
    )
    months = panel(spark, [1, 1]).unionByName(panel(spark, [5, 9]).withColumn("Month", F.col("Week") - 3))
    got = external.add_side_tables(months, {"bank_offers": offers, "weather": weather}).collect()
    # Week 1 has two rows, doubled by its two offers; week 5 one; week 9 lies in a month without weather.
    assert len(got) == 6
    assert {r.Week: r.Avg_Temperature_C for r in got} == {1: 10.0, 5: 40.0, 9: pytest.approx((4 * 10 + 40) / 5)}


def test_supply_chain_is_a_mean_of_means(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 10.0)]
    supply = spark.createDataFrame(
        [(DATE("2024-01-01"), 2024, 1, p, v, 1.0, 1.0, 1.0, 2) for p, v in rows], s.SIDE_TABLES["supply_chain"]
    )
    row = external.add_side_tables(panel(spark, [1]), {"supply_chain": supply}).first()
    assert row.Lead_Time_Days == 6.0 and row.Stockout_Events == 3.0


def test_bad_or_disabled_side_tables_are_skipped(spark, calendar):
    weeks = panel(spark, [1, 2]).withColumn("week_end", F.lit("2024-01-07").cast("date"))
    offers = side(spark, [(2024, 1, 1.0, 5.0)])
    tables = {"bank_offers": offers, "weather": offers, "custom_discounts": offers.drop("Date")}
    got = external.add_external_features(weeks, calendar, tables, enabled={"seasonal": False})
    assert got.count() == 2 and "Bank_Offer_Intensity" in got.columns
    assert not {"Weather_Index", "Store_Discount_Level", "Is_Summer_Season"} & set(got.columns)
    none = external.add_external_features(weeks, calendar, tables, enabled={"bank_offers": False, "holidays": False})
    assert "Bank_Offer_Intensity" not in none.columns and "Holiday_Count" not in none.columns


def test_label_order(spark):
    labels = spark.createDataFrame([("k", v) for v in ("10_1", "2_1", "1_1", "2_1", None)], "kind string, label string")
    got = {r.label: r.code for r in encoding.label_codes(labels).collect()}
    assert got == {"10_1": 0, "1_1": 1, "2_1": 2}


def test_label_codes_over_many_ranges(spark):
    rng = random.Random(1)
    labels = {kind: sorted({f"{rng.randint(0, 9999)}_{rng.choice('abcé')}" for _ in range(2000)}) for kind in ("x", "y")}
    rows = [(kind, v) for kind, values in labels.items() for v in values for _ in range(2)]
    rng.shuffle(rows)
    got = encoding.label_codes(spark.createDataFrame(rows, "kind string, label string").repartition(5)).collect()
    assert len(got) == sum(map(len, labels.values()))
    assert all(labels[r.kind][r.code] == r.label for r in got)


def test_split_is_by_position(spark, make_sales):
    rng = random.Random(6)
    rows = [
        (f"R{rng.randint(0, 2)}", f"S{rng.randint(0, 3)}", f"P{rng.randint(0, 2)}", f"2024-{rng.randint(1, 12):02d}-10", 1.0)
        for _ in range(150)
    ]
    panel = weekly_demand(make_sales(rows)).select(*s.SERIES, s.WEEK_END).cache()
    order = sorted(tuple(r) for r in panel.collect())
    for fraction in (0.8, 0.5, 0.013):
        marked = {tuple(r)[:4]: r.is_train for r in split.mark_train(panel, fraction).collect()}
        cut = int(len(order) * fraction)
        assert [marked[k] for k in order] == [i < cut for i in range(len(order))]


def test_lifecycle_codes(spark):
    products = spark.createDataFrame([("P", "Growth"), ("Q", "unknown")], "ProductName string, Product_Lifecycle_Stage string")
    rows = spark.createDataFrame([("P",), ("Q",), ("Z",)], "ProductName string")
    got = {r.ProductName: r.Lifecycle_Code for r in external.add_product_attributes(rows, products).collect()}
    assert got == {"P": 1, "Q": None, "Z": None}
