"""Weekly rollup and series features against plain Python."""

import datetime
import math
import random
import statistics

import pytest

from shelfcast import schema as s
from shelfcast.operators.anchors import daily_volatility, last_known_metrics
from shelfcast.operators.series import series_features
from shelfcast.operators.weekly import monthly_trend, weekly_demand

FIRST = datetime.date(2020, 1, 5)


def panel_of(spark, groups):
    """A gap-free panel from {(region, store, product): [quantities]}."""
    rows = [
        (*key, FIRST + datetime.timedelta(weeks=i), q, 0.0)
        for key, values in groups.items()
        for i, q in enumerate(values)
    ]
    ddl = "RegionName string, StoreName string, ProductName string, week_end date, Quantity long, True_Demand double"
    return spark.createDataFrame(rows, ddl)


def ordered(df, column):
    rows = df.orderBy(s.PRODUCT, s.STORE, s.REGION, s.WEEK_END).select(column).collect()
    return [r[0] for r in rows]


def expected(values, shift=0):
    """Feature rows of one series, by definition."""
    out = []
    for i in range(len(values)):
        upto = values[: i + 1 - shift]
        row = {f"Lag_{k}_Week": values[i - k] if i >= k else 0 for k in s.LAGS}
        for n in s.WINDOWS:
            whole = len(upto) >= n
            row[f"Rolling_Mean_{n}"] = statistics.fmean(upto[-n:]) if whole else 0.0
            row[f"Rolling_Std_{n}"] = statistics.stdev(upto[-n:]) if whole else 0.0
        weights = [0.6 ** (len(upto) - 1 - j) for j in range(len(upto))]
        row["EWMA_4"] = sum(w * v for w, v in zip(weights, upto)) / sum(weights) if upto else 0.0
        if len(upto) > 4:
            now, base = upto[-1], upto[-5]
            row["MoM_Change"] = (now - base) / base if base else (math.inf if now > 0 else 0.0)
        else:
            row["MoM_Change"] = 0.0
        row["Trend_4Week"] = row["Rolling_Mean_4"] - out[-1]["Rolling_Mean_4"] if out else 0.0
        spread = row["Rolling_Std_12"]
        row["Quantity_ZScore"] = (upto[-1] - row["Rolling_Mean_12"]) / spread if spread else 0.0
        out.append(row)
    return out


@pytest.mark.parametrize("shift", [0, 1])
def test_series_features_match_the_definitions(spark, shift):
    rng = random.Random(7)
    groups = {
        ("East", "A", "p"): [rng.randint(0, 9) for _ in range(40)],
        ("West", "A", "p"): [rng.randint(0, 9) for _ in range(3)],
        ("East", "B", "p"): [5] * 20,
        ("East", "B", "q"): [rng.randint(0, 3) for _ in range(1)],
    }
    got = series_features(panel_of(spark, groups), shift=shift)
    # A store in two regions is one series, in region order.
    series = [
        groups[("East", "A", "p")] + groups[("West", "A", "p")],
        groups[("East", "B", "p")],
        groups[("East", "B", "q")],
    ]
    want = [row for values in series for row in expected(values, shift)]
    for name in want[0]:
        assert ordered(got, name) == pytest.approx([row[name] for row in want], abs=1e-9), name


def test_ewma_over_many_blocks(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 1000) for _ in range(2600)]
    got = ordered(series_features(panel_of(spark, {("R", "S", "P"): values})), "EWMA_4")
    num = den = 0.0
    for i, v in enumerate(values):
        num, den = num * 0.6 + v, den * 0.6 + 1.0
        assert got[i] == pytest.approx(num / den, rel=1e-10), i


def test_change_from_zero(spark):
    panel = panel_of(spark, {("R", "S", "P"): [0, 0, 0, 0, 0, 5, 2, 3, 4, 10]})
    inf = math.inf
    assert ordered(series_features(panel), "MoM_Change") == [0, 0, 0, 0, 0, inf, inf, inf, inf, 1.0]
    assert ordered(series_features(panel, on_zero="null"), "MoM_Change")[5:] == [None] * 4 + [1.0]
    assert ordered(series_features(panel, on_zero="zero"), "MoM_Change")[5:] == [0.0] * 4 + [1.0]


def test_short_ewma(spark):
    got = ordered(series_features(panel_of(spark, {("R", "S", "P"): [1, 2]})), "EWMA_4")
    assert got == pytest.approx([1.0, 1.625])


def test_week_edges_and_gaps(make_sales):
    sales = make_sales(
        [
            ("R", "S", "P", "2024-01-06 10:00", 1.0),
            ("R", "S", "P", "2024-01-07 10:00", 2.0),
            ("R", "S", "P", "2024-01-08", 3.0),
            ("R", "S", "P", "2024-01-29", 4.0),
            (None, "S", "P", "2024-01-29", 9.0),
            ("R", "S", "Q", "2024-01-29", -4.0),
        ]
    )
    rows = weekly_demand(sales).orderBy(s.PRODUCT, s.WEEK_END).collect()
    assert [(r.week_end.isoformat(), r.Quantity) for r in rows if r.ProductName == "P"] == [
        ("2024-01-07", 3),
        ("2024-01-14", 3),
        ("2024-01-21", 0),
        ("2024-01-28", 0),
        ("2024-02-04", 4),
    ]
    assert [r.MRP for r in rows if r.ProductName == "P"] == [100.0, 100.0, None, None, 100.0]
    assert [r.Quantity for r in rows if r.ProductName == "Q"] == [0]


def test_monthly_trend_fills_empty_months(make_sales):
    sales = make_sales([("R", "S", "P", "2024-01-31", 1.0), ("R", "S", "P", "2024-04-01", 2.0)])
    rows = monthly_trend(sales).orderBy("month_end").collect()
    assert [(r.month_end.isoformat(), r.Quantity) for r in rows] == [
        ("2024-01-31", 1.0),
        ("2024-02-29", 0.0),
        ("2024-03-31", 0.0),
        ("2024-04-30", 2.0),
    ]


def random_sales(rng, n, hot=0.0):
    """Rows of a few pairs; a share of them belongs to one pair."""
    rows = []
    for _ in range(n):
        store, product = ("S0", "P0") if rng.random() < hot else (f"S{rng.randint(0, 3)}", f"P{rng.randint(0, 3)}")
        when = datetime.datetime(2023, 1, 1) + datetime.timedelta(days=rng.randint(0, 400), hours=rng.randint(0, 23))
        rows.append(("R", store, product, when.isoformat(sep=" "), float(rng.randint(-2, 9))))
    return rows


def test_last_known_metrics_by_hand(spark, make_sales):
    rows = random_sales(random.Random(5), 400)
    cutoff = datetime.datetime(2023, 11, 15)
    pairs = spark.createDataFrame([(f"S{i}", f"P{j}") for i in range(5) for j in range(4)], "StoreName string, ProductName string")
    got = {
        (r.StoreName, r.ProductName): (r.last_week_qty, r.rolling_4_avg)
        for r in last_known_metrics(make_sales(rows), cutoff=cutoff, pairs=pairs).collect()
    }
    assert len(got) == 20 and got[("S4", "P0")] == (0.0, 0.0)
    for store, product in {(r[1], r[2]) for r in rows}:
        weeks = {}
        for _, st, pr, when, quantity in rows:
            stamp = datetime.datetime.fromisoformat(when)
            if (st, pr) == (store, product) and stamp <= cutoff:
                sunday = stamp.date() + datetime.timedelta(days=6 - stamp.weekday())
                weeks[sunday] = weeks.get(sunday, 0.0) + quantity
        if not weeks:
            continue
        last = max(weeks)
        span = [last - datetime.timedelta(weeks=k) for k in range(4)]
        recent = [weeks.get(w, 0.0) for w in span if w >= min(weeks)]
        assert got[(store, product)] == pytest.approx((weeks[last], sum(recent) / len(recent)))


def volatility_by_hand(rows, store, product):
    mine = [(datetime.datetime.fromisoformat(w), q) for _, st, pr, w, q in rows if (st, pr) == (store, product)]
    newest = max(w for w, _ in mine)
    recent = [(w.date(), q) for w, q in mine if w >= newest - datetime.timedelta(days=180)]
    first = min(d for d, _ in recent)
    days = [0.0] * ((newest.date() - first).days + 1)
    for d, q in recent:
        days[(d - first).days] += q
    return statistics.pstdev(days) if len(days) > 1 else 0.0


def test_volatility_by_hand_with_a_hot_pair(make_sales):
    rows = random_sales(random.Random(11), 900, hot=0.4) + [("R", "S9", "P9", "2023-05-05 09:00", 4.0)]
    got = {(r.StoreName, r.ProductName): r.daily_sigma for r in daily_volatility(make_sales(rows)).collect()}
    assert got[("S9", "P9")] == 0.0
    for (store, product), sigma in got.items():
        assert sigma == pytest.approx(volatility_by_hand(rows, store, product), abs=1e-9)


def test_weekly_sums_equal_raw_sums(make_sales):
    rows = [r[:4] + (abs(r[4]),) for r in random_sales(random.Random(2), 500, hot=0.5)]
    weekly = weekly_demand(make_sales(rows)).collect()
    assert sum(r.Quantity for r in weekly) == sum(r[4] for r in rows)
    by_series = {}
    for r in weekly:
        by_series.setdefault((r.StoreName, r.ProductName), []).append(r.week_end)
    for weeks in by_series.values():
        weeks.sort()
        assert all((b - a).days == 7 for a, b in zip(weeks, weeks[1:]))
