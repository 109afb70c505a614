"""Weekly rollups, anchors and series features (A, W)."""

import datetime
import uuid

from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import anchors, options, weekly
from shelfcast.operators.series import last_rows, series_features
from shelfcast.plans.panel import grow
from shelfcast.queries.oracle import START, rounded, sql
from shelfcast.queries.registry import query
from shelfcast.session import shared_dir
from shelfcast.sources.star_schema import canonical_sales

KEYS = "RegionName, StoreName, ProductName, week_end"
HISTORY = (*s.SERIES, s.BILL_DATE, s.QUANTITY)


def _weekly(spark, sf):
    return weekly.weekly_demand(canonical_sales(spark, sf))


@query(
    "A1_weekly_demand",
    rounded(
        "weekly",
        "SELECT * FROM weekly",
        "True_Demand MRP DiscountPct Bank_Emi_Flag Bank_Cashback_Pct Additional_Funded_Scheme_Pct",
    ),
)
def weekly_demand(spark, sf):
    return _weekly(spark, sf)


@query(
    "A2_selection_weekly",
    rounded(
        "spine observed",
        """
SELECT s.RegionName, s.StoreName, s.ProductName, s.week_end, coalesce(o.Quantity, 0) AS Quantity,
       coalesce(o.True_Demand, 0) AS True_Demand, o.MRP, o.ProductLevelDiscAmount, o.Bank_Emi_Flag,
       o.Bank_Cashback_Pct, o.Additional_Funded_Scheme_Pct
FROM spine s LEFT JOIN observed o ON s.RegionName = o.RegionName AND s.StoreName = o.StoreName
 AND s.ProductName = o.ProductName AND s.week_end = o.week_end
""",
        "Quantity True_Demand MRP ProductLevelDiscAmount Bank_Emi_Flag Bank_Cashback_Pct Additional_Funded_Scheme_Pct",
    ),
)
def selection_weekly(spark, sf):
    return weekly.selection_weekly(canonical_sales(spark, sf))


@query(
    "A3_last_known_metrics",
    rounded(
        "anchor",
        "SELECT * FROM anchor",
        "last_week_qty rolling_4_avg last_true_demand last_emi_ratio last_cashback_pct last_additional_pct",
    ),
)
def last_known_metrics(spark, sf):
    columns = (s.STORE, s.PRODUCT, s.BILL_DATE, s.QUANTITY, *s.OPTIONAL)
    return anchors.last_known_metrics(canonical_sales(spark, sf, columns), cutoff=START)


@query("A5_daily_volatility", rounded("volatility", "SELECT * FROM volatility", "daily_sigma"))
def daily_volatility(spark, sf):
    return anchors.daily_volatility(canonical_sales(spark, sf, (*s.PAIR, s.BILL_DATE, s.QUANTITY)))


@query(
    "A6_monthly_trend",
    sql(
        "sales",
        """
SELECT f.StoreName, f.ProductName, f.month_end, coalesce(o.Quantity, 0) AS Quantity
FROM (SELECT StoreName, ProductName, last_day(CAST(unnest(generate_series(date_trunc('month', min(BillDate)),
        date_trunc('month', max(BillDate)), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM sales GROUP BY 1, 2) f
LEFT JOIN (SELECT StoreName, ProductName, last_day(CAST(BillDate AS DATE)) AS month_end, sum(Quantity) AS Quantity
           FROM sales GROUP BY 1, 2, 3) o
  ON f.StoreName = o.StoreName AND f.ProductName = o.ProductName AND f.month_end = o.month_end
""",
    ),
)
def monthly_trend(spark, sf):
    return weekly.monthly_trend(canonical_sales(spark, sf, (*s.PAIR, s.BILL_DATE, s.QUANTITY)))


@query(
    "A7_options",
    sql(
        "sales",
        """
SELECT 'RegionName' AS kind, RegionName AS value FROM sales UNION SELECT 'StoreName', StoreName FROM sales
UNION SELECT 'ProductName', ProductName FROM sales
""",
    ),
)
def all_options(spark, sf):
    return options.options(canonical_sales(spark, sf, s.SERIES))


@query("A8_cascading_options", sql("choices", "SELECT * FROM choices"))
def cascading_options(spark, sf):
    return options.cascade(canonical_sales(spark, sf, s.SERIES))


@query("A8_stores_of_regions", sql("sales", "SELECT DISTINCT RegionName, StoreName FROM sales"))
def stores_of_regions(spark, sf):
    return options.stores_of_regions(canonical_sales(spark, sf, (s.REGION, s.STORE)))


@query("A8_products_of_stores", sql("sales", "SELECT DISTINCT StoreName, ProductName FROM sales"))
def products_of_stores(spark, sf):
    return options.products_of_stores(canonical_sales(spark, sf, s.PAIR))


@query(
    "A14_mean_sale",
    rounded(
        "sales",
        "SELECT StoreName, ProductName, coalesce(avg(Quantity), 0) AS mean_quantity FROM sales GROUP BY 1, 2",
        "mean_quantity",
    ),
)
def mean_sale(spark, sf):
    return anchors.mean_sale(canonical_sales(spark, sf, (*s.PAIR, s.QUANTITY)))


def _series(name: str, columns: str, doubles: str, **options):
    """Register a query that returns the given feature columns of the whole panel."""

    def build(spark, sf):
        sales = canonical_sales(spark, sf, (*s.REQUIRED, s.TRUE_DEMAND_RAW))
        panel = series_features(weekly.weekly_demand(sales), **options)
        return panel.select(*s.SERIES, s.WEEK_END, *columns.split())

    body = f"SELECT {KEYS}, {', '.join(columns.split())} FROM features"
    query(name, rounded("features", body, doubles) if doubles else sql("features", body))(build)


_series("W1_lags", " ".join(f"Lag_{k}_Week" for k in s.LAGS), "")
_series("W2_rolling_mean", *2 * [" ".join(f"Rolling_Mean_{n}" for n in s.WINDOWS)])
_series("W3_rolling_std", *2 * [" ".join(f"Rolling_Std_{n}" for n in s.WINDOWS)])


def _features(spark, sf, **options):
    return series_features(
        weekly.weekly_demand(canonical_sales(spark, sf, (*s.REQUIRED, s.TRUE_DEMAND_RAW))), **options
    )


@query(
    "W4_ewma",
    rounded(
        "features",
        f"""
SELECT {KEYS}, list_sum(list_transform(history, lambda x, i: x * pow(0.6::DOUBLE, len(history) - i)))
         / list_sum(list_transform(history, lambda x, i: pow(0.6::DOUBLE, len(history) - i))) AS EWMA_4
FROM features
""",
        "EWMA_4",
    ),
)
def ewma(spark, sf):
    return _features(spark, sf).select(*s.SERIES, s.WEEK_END, "EWMA_4")


@query(
    "W5_four_week_change",
    rounded(
        "features",
        f"""
SELECT {KEYS}, coalesce((Quantity - q4) / CAST(nullif(q4, 0) AS DOUBLE), 0) AS "MoM_Change" FROM features
""",
        "MoM_Change",
    ),
)
def four_week_change(spark, sf):
    return _features(spark, sf, on_zero="zero").select(*s.SERIES, s.WEEK_END, "MoM_Change")


@query(
    "W6_trend",
    rounded(
        "features",
        f"""
SELECT {KEYS}, coalesce(Rolling_Mean_4 - lag(Rolling_Mean_4) OVER
         (PARTITION BY ProductName, StoreName ORDER BY RegionName, week_end), 0) AS "Trend_4Week"
FROM features
""",
        "Trend_4Week",
    ),
)
def trend(spark, sf):
    return _features(spark, sf).select(*s.SERIES, s.WEEK_END, "Trend_4Week")


@query(
    "W7_z_score",
    rounded(
        "features",
        f"""
SELECT {KEYS}, CASE WHEN rn >= 12 AND Rolling_Std_12 > 0 THEN (Quantity - Rolling_Mean_12) / Rolling_Std_12 ELSE 0 END
         AS "Quantity_ZScore"
FROM features
""",
        "Quantity_ZScore",
    ),
)
def z_score(spark, sf):
    return _features(spark, sf).select(*s.SERIES, s.WEEK_END, "Quantity_ZScore")


@query(
    "W2_rolling_mean_past_only",
    rounded(
        "past",
        f"SELECT {KEYS}, past_mean_2 AS Rolling_Mean_2, past_mean_4 AS Rolling_Mean_4, past_mean_12 AS Rolling_Mean_12 FROM past",
        "Rolling_Mean_2 Rolling_Mean_4 Rolling_Mean_12",
    ),
)
def rolling_mean_past_only(spark, sf):
    names = ("Rolling_Mean_2", "Rolling_Mean_4", "Rolling_Mean_12")
    return _features(spark, sf, shift=1).select(*s.SERIES, s.WEEK_END, *names)


@query(
    "W10_last_weeks",
    rounded(
        "weekly",
        f"""
SELECT {KEYS}, Quantity, True_Demand FROM (
  SELECT *, row_number() OVER (PARTITION BY ProductName, StoreName ORDER BY RegionName DESC, week_end DESC) AS place
  FROM weekly) AS ranked
WHERE place <= 4
""",
        "True_Demand",
    ),
)
def last_weeks(spark, sf):
    sales = canonical_sales(spark, sf, (*s.REQUIRED, s.TRUE_DEMAND_RAW))
    newest = last_rows(weekly.weekly_demand(sales), 4)
    return newest.select(*s.SERIES, s.WEEK_END, s.QUANTITY, F.col("True_Demand"))


_GROWN = (
    [f"Lag_{k}_Week" for k in s.LAGS] + [f"Rolling_Mean_{n}" for n in s.WINDOWS] + [f"Rolling_Std_{n}" for n in s.WINDOWS]
    + ["EWMA_4", "MoM_Change", "Trend_4Week", "Quantity_ZScore"]
)


@query(
    "W_grown_panel",
    rounded(
        "features",
        f"""
SELECT {KEYS}, Quantity, {', '.join(_GROWN[:14])},
       list_sum(list_transform(history, lambda x, i: x * pow(0.6::DOUBLE, len(history) - i)))
         / list_sum(list_transform(history, lambda x, i: pow(0.6::DOUBLE, len(history) - i))) AS EWMA_4,
       coalesce((Quantity - q4) / CAST(nullif(q4, 0) AS DOUBLE), 0) AS "MoM_Change",
       coalesce(Rolling_Mean_4 - lag(Rolling_Mean_4) OVER (PARTITION BY ProductName, StoreName ORDER BY RegionName, week_end), 0) AS "Trend_4Week",
       CASE WHEN rn >= 12 AND Rolling_Std_12 > 0 THEN (Quantity - Rolling_Mean_12) / Rolling_Std_12 ELSE 0 END AS "Quantity_ZScore"
FROM features
""",
        " ".join(_GROWN[6:]),
    ),
)
def grown_panel(spark, sf):
    """All series features of a panel to which three parts of the sales were appended, each computed from the state before it."""
    sales = canonical_sales(spark, sf, (*s.REQUIRED, s.TRUE_DEMAND_RAW))
    closings = [datetime.date(1997, 6, 29), datetime.date(2001, 1, 7), datetime.date(2002, 1, 6)]
    store = grow(spark, f"{shared_dir(spark)}/shelfcast/grown-{uuid.uuid4().hex}", sales, closings)
    return store.read().select(*s.SERIES, s.WEEK_END, s.QUANTITY, *_GROWN)
