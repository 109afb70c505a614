"""Codes, split, forecast, reports and stock (M, O, F, R, I, A)."""

import datetime

from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import weeks_in_horizon
from shelfcast.functions.calendar import week_end
from shelfcast.operators import encoding, forecasting, metrics, split
from shelfcast.operators.cleaning import up_to
from shelfcast.operators.history import as_history
from shelfcast.operators.inventory import forecast_totals
from shelfcast.operators.series import series_features
from shelfcast.operators.weekly import weekly_demand
from shelfcast.plans.planning import bulk_forecast, forecast, stock_plan
from shelfcast.queries.oracle import START, rounded, sql
from shelfcast.queries.registry import query
from shelfcast.session import materialize
from shelfcast.sources.star_schema import canonical_sales

BEGIN = datetime.date.fromisoformat(START)
HISTORY = (*s.SERIES, s.BILL_DATE, s.QUANTITY, *s.OPTIONAL)


def _weekly(spark, sf):
    return weekly_demand(canonical_sales(spark, sf, (*s.REQUIRED, s.TRUE_DEMAND_RAW)))


def _months(spark, sf):
    panel = _weekly(spark, sf)
    return panel.select(*s.SERIES, F.month(s.WEEK_END).alias("Month"))


@query("M1_label_codes", sql("base_codes", "SELECT kind, label, CAST(code AS BIGINT) AS code FROM base_codes"))
def label_codes(spark, sf):
    series = canonical_sales(spark, sf, s.SERIES)
    return encoding.label_codes(encoding.as_labels(series, {c: F.col(c) for c in s.SERIES}))


_COMBOS = """
SELECT kind, label, CAST(dense_rank() OVER (PARTITION BY kind ORDER BY label) - 1 AS BIGINT) AS code FROM (
  SELECT DISTINCT 'product_store' AS kind, p.code || '_' || t.code AS label
  FROM sales s JOIN base_codes p ON p.kind = 'ProductName' AND p.label = s.ProductName
  JOIN base_codes t ON t.kind = 'StoreName' AND t.label = s.StoreName
  UNION
  SELECT DISTINCT 'month_product', month(w.week_end) || '_' || p.code
  FROM weekly w JOIN base_codes p ON p.kind = 'ProductName' AND p.label = w.ProductName) AS labels
"""


@query("M2_combination_codes", sql("base_codes weekly", _COMBOS))
def combination_codes(spark, sf):
    enc = encoding.fit_encoders(_months(spark, sf))
    pairs = enc.product_store.toDF("label", "code").withColumn("kind", F.lit("product_store"))
    months = enc.month_product.toDF("label", "code").withColumn("kind", F.lit("month_product"))
    return pairs.unionByName(months).select("kind", "label", "code")


TRAIN_UNTIL = "1995-03-01"


@query(
    "J14_code_lookup",
    sql(
        "sales",
        f"""
, train AS (SELECT * FROM sales WHERE BillDate <= TIMESTAMP '{TRAIN_UNTIL}'),
r AS (SELECT RegionName, dense_rank() OVER (ORDER BY RegionName) - 1 AS id FROM (SELECT DISTINCT RegionName FROM train) AS x),
t AS (SELECT StoreName, dense_rank() OVER (ORDER BY StoreName) - 1 AS id FROM (SELECT DISTINCT StoreName FROM train) AS x),
p AS (SELECT ProductName, dense_rank() OVER (ORDER BY ProductName) - 1 AS id
      FROM (SELECT DISTINCT ProductName FROM train) AS x),
combos AS (SELECT DISTINCT StoreName, ProductName, p.id || '_' || t.id AS label FROM train JOIN t USING (StoreName)
           JOIN p USING (ProductName)),
ps AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM combos) AS x),
mp AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS id FROM (
  SELECT DISTINCT month(CAST(date_trunc('week', BillDate) AS DATE) + 6) || '_' || p.id AS label FROM train JOIN p USING (ProductName)) AS x)
SELECT s.RegionName, s.StoreName, s.ProductName, CAST(s."Month" AS INTEGER) AS "Month", CAST(r.id AS BIGINT) AS "RegionID",
       CAST(t.id AS BIGINT) AS "StoreID", CAST(p.id AS BIGINT) AS "ProductID", CAST(coalesce(ps.id, 0) AS BIGINT) AS "Product_Store_ID",
       CAST(coalesce(mp.id, 0) AS BIGINT) AS "Month_Product_ID"
FROM (SELECT DISTINCT RegionName, StoreName, ProductName, month(CAST(date_trunc('week', BillDate) AS DATE) + 6) AS "Month" FROM sales) s
LEFT JOIN r ON s.RegionName = r.RegionName LEFT JOIN t ON s.StoreName = t.StoreName
LEFT JOIN p ON s.ProductName = p.ProductName LEFT JOIN ps ON ps.label = p.id || '_' || t.id
LEFT JOIN mp ON mp.label = s."Month" || '_' || p.id
""",
    ).replace("\n)\n,", "\n),", 1),
)
def code_lookup(spark, sf):
    sales = canonical_sales(spark, sf, (*s.SERIES, s.BILL_DATE))
    month = F.month(week_end(F.col(s.BILL_DATE))).alias("Month")
    enc = encoding.fit_encoders(up_to(sales, TRAIN_UNTIL).select(*s.SERIES, month))
    codes = ("RegionID", "StoreID", "ProductID", "Product_Store_ID", "Month_Product_ID")
    return encoding.encode(sales.select(*s.SERIES, month).distinct(), enc).select(*s.SERIES, "Month", *codes)


@query(
    "O2_positional_split",
    sql(
        "weekly",
        """
SELECT RegionName, StoreName, ProductName, count(*) FILTER (WHERE place <= cut) AS train_weeks,
       count(*) FILTER (WHERE place > cut) AS test_weeks
FROM (SELECT *, row_number() OVER (ORDER BY RegionName, StoreName, ProductName, week_end) AS place,
             floor(count(*) OVER () * 0.8::DOUBLE) AS cut FROM weekly) AS placed
GROUP BY 1, 2, 3
""",
    ),
)
def positional_split(spark, sf):
    panel = materialize(_weekly(spark, sf).select(*s.SERIES, s.WEEK_END), "panel")
    return split.mark_train(panel).groupBy(*s.SERIES).agg(
        F.count(F.when(F.col("is_train"), 1)).alias("train_weeks"),
        F.count(F.when(~F.col("is_train"), 1)).alias("test_weeks"),
    )


@query(
    "A16_row_counts",
    sql(
        "weekly",
        """
SELECT (SELECT count(*) FROM sales) AS sales_rows, n AS weekly_rows, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS train_rows,
       n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS test_rows
FROM (SELECT count(*) AS n FROM weekly) AS counted
""",
    ),
)
def row_counts(spark, sf):
    sales = canonical_sales(spark, sf, (*s.REQUIRED, s.TRUE_DEMAND_RAW))
    panel = materialize(weekly_demand(sales).select(*s.SERIES, s.WEEK_END), "panel")
    rows = sales.agg(F.count("*").alias("n")).scalar()
    return (
        split.mark_train(panel)
        .agg(
            F.count("*").alias("weekly_rows"),
            F.count(F.when(F.col("is_train"), 1)).alias("train_rows"),
            F.count(F.when(~F.col("is_train"), 1)).alias("test_rows"),
        )
        .select(rows.alias("sales_rows"), "*")
    )


@query(
    "O2_date_split",
    sql(
        "weekly",
        """
SELECT StoreName, count(*) FILTER (WHERE week_end < DATE '2000-07-01') AS train_weeks,
       count(*) FILTER (WHERE week_end >= DATE '2000-07-01') AS test_weeks FROM weekly GROUP BY 1
""",
    ),
)
def date_split(spark, sf):
    marked = split.mark_train_by_date(_weekly(spark, sf), datetime.date(2000, 7, 1))
    return marked.groupBy(s.STORE).agg(
        F.count(F.when(F.col("is_train"), 1)).alias("train_weeks"),
        F.count(F.when(~F.col("is_train"), 1)).alias("test_weeks"),
    )


_SCORES = """
count(*) AS "rows", avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
sum(abs(y - p)) / (sum(y) + 1e-5::DOUBLE) * 100 AS wape,
greatest(0, 100 - sum(abs(y - p)) / (sum(y) + 1e-5::DOUBLE) * 100) AS accuracy,
avg(abs((y - p) / (y + 1e-5::DOUBLE))) * 100 AS mape,
avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-5::DOUBLE)) * 100 AS smape
"""


def _past(spark, sf):
    return series_features(_weekly(spark, sf), shift=1)


@query(
    "A12_regression_metrics",
    rounded(
        "past",
        f"SELECT RegionName, {_SCORES} FROM (SELECT RegionName, CAST(Quantity AS DOUBLE) AS y, past_mean_4 AS p FROM past) AS x GROUP BY 1",
        "mae rmse wape accuracy mape smape",
        4,
    ),
    digits=4,
)
def regression_metrics(spark, sf):
    return metrics.regression_metrics(_past(spark, sf), prediction="Rolling_Mean_4", keys=(s.REGION,))


_NAIVE = ("Lag_1_Week", "Rolling_Mean_2", "Rolling_Mean_4", "Rolling_Mean_12")
_CANDIDATE_SQL = f"""
SELECT model, {_SCORES} FROM (
  SELECT unnest(['Lag_1_Week', 'Rolling_Mean_2', 'Rolling_Mean_4', 'Rolling_Mean_12']) AS model,
         unnest([CAST(coalesce(lag1, 0) AS DOUBLE), past_mean_2, past_mean_4, past_mean_12]) AS p,
         CAST(Quantity AS DOUBLE) AS y FROM past) AS x
GROUP BY model
"""


def _candidate_scores(spark, sf):
    """Scores of four simple forecasts that use only earlier weeks."""
    guesses = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("model"), F.col(c).cast("double").alias("prediction"))
            for i, c in enumerate(_NAIVE)
        ]
    )
    scored = _past(spark, sf).select(s.QUANTITY, F.inline(guesses))
    return metrics.regression_metrics(scored, keys=("position", "model"))


@query(
    "O3_best_candidate",
    rounded("past", f"SELECT model, mae FROM ({_CANDIDATE_SQL}) AS scored ORDER BY mae LIMIT 1", "mae"),
)
def best_candidate(spark, sf):
    return metrics.best_model(_candidate_scores(spark, sf)).select("model", "mae")


@query(
    "R5_scorecard",
    sql(
        "past",
        f"""
, best AS (SELECT * FROM ({_CANDIDATE_SQL}) AS scored ORDER BY mae LIMIT 1)
SELECT 'Algorithm' AS "Parameter", model AS "Value" FROM best
UNION ALL SELECT 'Forecast Accuracy (%)', CAST(round_even(accuracy, 2) AS VARCHAR) || '%' FROM best
UNION ALL SELECT 'MAE (Absolute Error)', CAST(round_even(mae, 4) AS VARCHAR) FROM best
UNION ALL SELECT 'RMSE (Safety Deviation)', CAST(round_even(rmse, 4) AS VARCHAR) FROM best
UNION ALL SELECT 'MAPE (%)', CAST(round_even(mape, 2) AS VARCHAR) FROM best
UNION ALL SELECT 'sMAPE (%)', CAST(round_even(smape, 2) AS VARCHAR) FROM best
UNION ALL SELECT 'Features_Used', '4' FROM best
""",
    ).replace("\n)\n,", "\n),", 1),
)
def scorecard(spark, sf):
    best = metrics.best_model(_candidate_scores(spark, sf))
    return metrics.scorecard(best, algorithm=F.col("model"), features=len(_NAIVE))


def _history(spark, sf):
    return canonical_sales(spark, sf, HISTORY)


@query(
    "F1_weeks_in_horizon",
    sql(
        "future",
        """
SELECT h.horizon_days, CAST(count(*) AS BIGINT) AS week_rows, count(DISTINCT week_index) AS weeks
FROM future JOIN (VALUES (7, 1), (30, 5), (60, 9)) h(horizon_days, n) ON week_index < n GROUP BY 1
""",
    ),
)
def weeks_in_horizons(spark, sf):
    history = as_history(_history(spark, sf))
    rows = None
    for days in (7, 30, 60):
        weekly = forecast(history, start=BEGIN, weeks=weeks_in_horizon(days))
        counted = weekly.agg(
            F.lit(days).alias("horizon_days"),
            F.count("*").alias("week_rows"),
            F.count_distinct("week_index").alias("weeks"),
        )
        rows = counted if rows is None else rows.unionByName(counted)
    return rows


_OFFER_BANDS = {"Bank_Cashback": "last_cashback_pct", "Additional_Funded_Scheme": "last_additional_pct"}
_SAME = {
    **{f"Lag_{k}_Week": "last_week_qty" for k in s.LAGS},
    **{f"Rolling_Mean_{n}": "rolling_4_avg" for n in s.WINDOWS},
    **{f"Rolling_Std_{n}": "rolling_4_avg * 0.15::DOUBLE" for n in s.WINDOWS},
    **{c: "0.0::DOUBLE" for c in ("MoM_Change", "Trend_4Week", "Quantity_ZScore")},
    "EWMA_4": "rolling_4_avg", "True_Demand": "last_true_demand", "Bank_Emi_Flag": "last_emi_ratio",
    "TrueDemand_Ratio": "last_true_demand / (last_week_qty + 1e-5::DOUBLE)", "DiscountPct": "0.05::DOUBLE", "Effective_Price": "100.0::DOUBLE",
    **{f"{c}_Pct": source for c, source in _OFFER_BANDS.items()},
    **{f"{p}_{n}": f"{f}(2 * pi() * {part}(week_start) / {period}.0::DOUBLE)"
       for p, part, period in (("Week", "week", 52), ("Month", "month", 12)) for n, f in (("Sin", "sin"), ("Cos", "cos"))},
}
_FUTURE = " ".join(["last_week_qty", "prediction", *_SAME])


@query(
    "F2_future_frame",
    rounded(
        "future",
        f"""
SELECT RegionName, StoreName, ProductName, week_index, week_start, last_week_qty, greatest(rolling_4_avg, 0.0::DOUBLE) AS prediction,
       {', '.join(f'{v} AS "{c}"' for c, v in _SAME.items())},
       {', '.join(f'CAST({part}(week_start) AS INTEGER) AS "{part.title()}"' for part in ('week', 'month', 'year', 'quarter'))},
       CASE WHEN day(week_start) <= 7 THEN 1 ELSE 0 END AS "Is_Month_Start", CASE WHEN day(week_start) >= 25 THEN 1 ELSE 0 END AS "Is_Month_End",
       0 AS "Discount_Intensity", {', '.join(
           f'CASE WHEN {v} <= 0 OR {v} > 100 THEN 0 WHEN {v} <= 2 THEN 1 WHEN {v} <= 5 THEN 2 WHEN {v} <= 10 THEN 3 ELSE 4 END AS "{c}_Intensity"'
           for c, v in _OFFER_BANDS.items())}
FROM future
""",
        _FUTURE,
    ),
)
def future_frame(spark, sf):
    """Every column of the future features, and the prediction without a model."""
    return forecast(_history(spark, sf), start=BEGIN, weeks=9)


_BULK = f"""
SELECT RegionName AS "Region", StoreName AS "Store", ProductName AS "Product", '{START}' AS "Forecast_Start_Date",
       CAST(round_even(sum(CASE WHEN week_index < 4 THEN rolling_4_avg ELSE 0 END), 0) AS BIGINT) AS "30_Day_Forecast",
       CAST(round_even(sum(rolling_4_avg), 0) AS BIGINT) AS "60_Day_Forecast",
       round_even(max(last_week_qty), 2) AS "Current_Weekly_Velocity", CAST(NULL AS VARCHAR) AS "Status"
FROM future GROUP BY 1, 2, 3
"""


def _bulk(spark, sf):
    return bulk_forecast(_history(spark, sf), start=BEGIN)


@query("F3_bulk_report", sql("future", _BULK))
def bulk_report(spark, sf):
    return _bulk(spark, sf)


@query(
    "A13_horizon_sums",
    sql("future", f'SELECT "Region", "Store", "Product", "30_Day_Forecast", "60_Day_Forecast" FROM ({_BULK}) AS b'),
)
def horizon_sums(spark, sf):
    return _bulk(spark, sf).select("Region", "Store", "Product", "30_Day_Forecast", "60_Day_Forecast")


@query(
    "R1_product_report",
    sql(
        "future",
        f"""
SELECT RegionName AS "Region", StoreName AS "Store", ProductName AS "Product", '{START}' AS "Forecast_Start_Date",
       strftime(week_start, '%Y-%m-%d') AS "Week_Starting", strftime(week_start + 6, '%Y-%m-%d') AS "Week_Ending",
       CAST(round_even(rolling_4_avg, 0) AS BIGINT) AS "Forecasted_Units"
FROM future
""",
    ),
)
def product_report(spark, sf):
    return forecasting.product_report(forecast(_history(spark, sf), start=BEGIN, weeks=9), start=BEGIN)


@query(
    "R4_summary_input",
    sql(
        "future",
        f"""
SELECT "Region", "Store", "Product" AS product_name, "30_Day_Forecast" / 4.0::DOUBLE AS weekly_forecast,
       4 AS weeks, "Current_Weekly_Velocity" AS historical_avg FROM ({_BULK}) AS b
""",
    ),
)
def summary_input(spark, sf):
    listed = forecasting.summary_input(_bulk(spark, sf))
    return listed.select(
        "Region",
        "Store",
        "product_name",
        F.col("predictions")[0].alias("weekly_forecast"),
        F.size("predictions").alias("weeks"),
        "historical_avg",
    )


def _plan(spark, sf):
    return stock_plan(_history(spark, sf), start=BEGIN)


KEYS = "RegionName, StoreName, ProductName"


def _stock(name: str, columns: dict[str, str], doubles: str = ""):
    picks = ", ".join(f"{v} AS {c}" for c, v in columns.items())
    body = f"SELECT {KEYS}, {picks} FROM stock"
    statement = rounded("stock", body, doubles) if doubles else sql("stock", body)
    query(name, statement)(lambda spark, sf: _plan(spark, sf).select(*s.SERIES, *columns))


@query(
    "I1_total_demand",
    sql(
        "future",
        f"SELECT {KEYS}, CAST(round_even(sum(rolling_4_avg), 0) AS BIGINT) AS total_demand FROM future WHERE week_index < 5 GROUP BY 1, 2, 3",
    ),
)
def total_demand(spark, sf):
    weekly = forecast(_history(spark, sf), start=BEGIN, weeks=weeks_in_horizon(30))
    return forecast_totals(weekly, horizon_days=30).select(*s.SERIES, "total_demand")


_stock(
    "I2_velocity",
    {"daily_velocity": "daily_velocity", "weekly_velocity": "weekly_velocity"},
    "daily_velocity weekly_velocity",
)
_stock("I3_safety_stock", {"sigma": "sigma", "safety_stock": "safety_stock"}, "sigma")
_stock("I4_reorder_point", {"reorder_point": "reorder_point"})
_stock("I5_procurement_quantity", {"procurement_quantity": "procurement_quantity"})
_stock("I6_estimated_stock", {"estimated_stock": "CAST(floor(reorder_point * 0.8::DOUBLE) AS BIGINT)"})
_stock(
    "I_stock_plan",
    {
        "total_demand": "total_demand",
        "daily_velocity": "daily_velocity",
        "weekly_velocity": "weekly_velocity",
        "sigma": "sigma",
        "safety_stock": "safety_stock",
        "reorder_point": "reorder_point",
        "procurement_quantity": "procurement_quantity",
        "estimated_stock": "CAST(floor(reorder_point * 0.8::DOUBLE) AS BIGINT)",
    },
    "daily_velocity weekly_velocity sigma",
)
