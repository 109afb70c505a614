"""Side tables, holidays and attributes (J, E, S, R)."""

import datetime

from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import week_end
from shelfcast.operators import external, holidays
from shelfcast.operators.weekly import weekly_demand
from shelfcast.plans.features import add_calendar_features
from shelfcast.queries.oracle import rounded, sql
from shelfcast.queries.registry import query
from shelfcast.session import materialize
from shelfcast.sources.star_schema import (
    canonical_sales,
    holiday_calendar,
    product_attributes,
    side_table,
    side_tables,
    store_attributes,
)


def _panel(spark, sf):
    """Keys and calendar columns of the gap-free panel."""
    sales = canonical_sales(spark, sf, s.REQUIRED)
    return add_calendar_features(weekly_demand(sales)).select(
        *s.SERIES, s.WEEK_END, s.QUANTITY, "Year", "Month", "Week"
    )


def _side_join(name: str, table: str, cte: str, keys: str, doubles: str, integers: str = "", *, fill: str, digits: int = 6):
    """Register the join of one side table: per key, the panel rows and the joined values."""
    k1, k2 = keys.split()
    filled = "0" if fill == "zero" else "avg({c}) OVER ()"
    picks = ", ".join(f'coalesce(t.{c}, {filled.format(c="t." + c)}) AS {c}' for c in (doubles + " " + integers).split())
    values = ", ".join(
        [f"max({c}) AS {c}" for c in doubles.split()] + [f"CAST(max({c}) AS BIGINT) AS {c}" for c in integers.split()]
    )
    body = f"""
SELECT CAST("{k1}" AS INTEGER) AS "{k1}", CAST("{k2}" AS INTEGER) AS "{k2}", count(*) AS "rows", {values} FROM (
  SELECT p."{k1}", p."{k2}", {picks} FROM panel p LEFT JOIN {cte} t ON p."{k1}" = t."{k1}" AND p."{k2}" = t."{k2}") AS j
GROUP BY 1, 2
"""

    def build(spark, sf):
        panel = materialize(_panel(spark, sf), "panel")
        joined = external.add_side_tables(panel, {table: side_table(spark, sf, table)})
        return joined.groupBy(k1, k2).agg(
            F.count("*").alias("rows"),
            *[F.max(c).alias(c) for c in doubles.split()],
            *[F.max(c).cast("long").alias(c) for c in integers.split()],
        )

    query(name, rounded(f"panel {cte}", body, doubles, digits), digits=digits)(build)


_side_join(
    "J1_economic",
    "economic",
    "economic",
    "Year Month",
    "GDP_Growth_Rate Consumer_Confidence_Index Inflation_Rate Unemployment_Rate Interest_Rate",
    fill="mean",
)
_side_join(
    "J2_weather",
    "weather",
    "weather",
    "Year Month",
    "Avg_Temperature_C Total_Rainfall_mm Humidity_Percent Weather_Index",
    fill="mean",
)
_side_join(
    "J3_competitor",
    "competitor",
    "competitor",
    "Year Week",
    "Competitor_Promotion_Intensity Competitor_Price_Undercut",
    "Competitor_New_Store_Opening",
    fill="zero",
)
_side_join(
    "J4_marketing",
    "marketing",
    "marketing",
    "Year Week",
    "Ad_Spend_INR Campaign_Intensity",
    "Impressions Clicks Conversions",
    fill="zero",
    digits=2,
)
_side_join(
    "J5_supply_chain",
    "supply_chain",
    "supply",
    "Year Week",
    "Lead_Time_Days On_Time_Delivery_Rate Quality_Score Supplier_Reliability_Index Stockout_Events",
    fill="mean",
)
_side_join(
    "J6_bank_offers",
    "bank_offers",
    "bank_offers",
    "Year Week",
    "Bank_Offer_Intensity Card_Promotion_Level",
    fill="zero",
)
_side_join(
    "J7_custom_discounts",
    "custom_discounts",
    "custom_discounts",
    "Year Week",
    "Store_Discount_Level",
    "Loyalty_Discount_Available",
    fill="zero",
)
_side_join(
    "J8_custom_promotions",
    "custom_promotions",
    "custom_promotions",
    "Year Week",
    "Promotion_Discount_Pct",
    "Promotion_Type_Code",
    fill="zero",
)


def _region_weeks(spark, sf):
    sales = canonical_sales(spark, sf, (s.REGION, s.BILL_DATE))
    weeks = sales.select(s.REGION, week_end(F.col(s.BILL_DATE)).alias(s.WEEK_END)).distinct()
    return materialize(weeks, "region-weeks")


def _holiday_columns(name: str, *columns: str, **options):
    listed = ", ".join(f'"{c}"' for c in columns)
    statement = sql("holiday_features", f"SELECT RegionName, week_end, {listed} FROM holiday_features")

    def build(spark, sf):
        weeks = _region_weeks(spark, sf)
        return holidays.add_holiday_features(weeks, holiday_calendar(spark, sf), **options).select(
            s.REGION, s.WEEK_END, *columns
        )

    query(name, statement)(build)


_holiday_columns("J11_holidays_in_week", "Holiday_Count", "Is_Holiday_Week")
_holiday_columns("J12_nearest_holidays", "Days_to_Next_Holiday", "Days_since_Last_Holiday")
_holiday_columns("J13_week_end_is_holiday", "Holiday_State_Code", "Is_Holiday")


@query(
    "J11_holidays_in_panel",
    sql(
        "weekly holiday_features",
        """
SELECT w.StoreName, w.ProductName, count(*) AS "rows", CAST(sum(h.Holiday_Count) AS BIGINT) AS Holiday_Count,
       CAST(sum(h.Days_to_Next_Holiday) AS BIGINT) AS Days_to_Next_Holiday
FROM weekly w JOIN holiday_features h ON w.RegionName = h.RegionName AND w.week_end = h.week_end GROUP BY 1, 2
""",
    ).replace(
        "SELECT DISTINCT RegionName, state_code, week_end FROM clean",
        "SELECT DISTINCT w.RegionName, c.state_code, w.week_end FROM weekly w "
        "JOIN (SELECT DISTINCT RegionName, state_code FROM clean) c ON w.RegionName = c.RegionName",
    ),
)
def holidays_in_panel(spark, sf):
    panel = materialize(_panel(spark, sf), "panel")
    joined = holidays.add_holiday_features(panel, holiday_calendar(spark, sf))
    return joined.groupBy(*s.PAIR).agg(
        F.count("*").alias("rows"),
        F.sum("Holiday_Count").alias("Holiday_Count"),
        F.sum("Days_to_Next_Holiday").alias("Days_to_Next_Holiday"),
    )


@query(
    "J15_state_lookup",
    sql("clean", 'SELECT RegionName, state_code, count(*) AS "rows" FROM clean GROUP BY 1, 2'),
)
def state_lookup(spark, sf):
    counted = canonical_sales(spark, sf, (s.REGION,)).groupBy(s.REGION).agg(F.count("*").alias("rows"))
    return counted.withColumn("state_code", holidays.state_code(F.col(s.REGION)))


@query(
    "S5_state_calendars",
    sql(
        "calendar",
        """
SELECT c.code AS calendar, h.holiday_date, h.name AS holiday_name
FROM (SELECT DISTINCT code FROM calendar WHERE code IS NOT NULL) c JOIN calendar h ON h.code IS NULL OR h.code = c.code
UNION ALL SELECT '*', holiday_date, name FROM calendar WHERE code IS NULL
""",
    ),
)
def state_calendars(spark, sf):
    return holidays.calendars(holiday_calendar(spark, sf))


_LISTED = """
SELECT r.RegionName, h.holiday_date AS "Date", h.name AS "Holiday"
FROM (SELECT DISTINCT RegionName, state_code FROM clean) r JOIN calendar h ON h.code IS NULL OR h.code = r.state_code
"""


@query("S6_holiday_list", sql("clean calendar", _LISTED))
def holiday_list(spark, sf):
    sales = canonical_sales(spark, sf, (s.REGION, s.BILL_DATE))
    years = sales.select(F.year(week_end(F.col(s.BILL_DATE))).alias("Year")).distinct()
    return holidays.holiday_lists(sales, holiday_calendar(spark, sf), years)


WINDOW_START, WINDOW_DAYS = datetime.date(2000, 12, 20), 60
_INSIDE = _LISTED + "WHERE h.holiday_date BETWEEN DATE '2000-12-20' AND DATE '2000-12-20' + 59"


def _window(spark, sf):
    return holidays.holidays_in_window(
        canonical_sales(spark, sf, (s.REGION,)),
        holiday_calendar(spark, sf),
        start=WINDOW_START,
        horizon_days=WINDOW_DAYS,
    )


@query("R3_holidays_in_window", sql("clean calendar", _INSIDE))
def holidays_in_window(spark, sf):
    return _window(spark, sf)


@query(
    "A15_holiday_impact",
    sql(
        "clean calendar",
        f"""
SELECT RegionName, count(*) AS holidays, min("Date") AS first_date, arg_min("Holiday", "Date") AS first_holiday
FROM ({_INSIDE}) AS inside GROUP BY 1
""",
    ),
)
def holiday_impact(spark, sf):
    return holidays.holiday_impact(_window(spark, sf))


@query(
    "O4_earliest_holiday",
    sql(
        "clean calendar",
        f'SELECT RegionName, arg_min("Holiday", "Date") AS first_holiday FROM ({_INSIDE}) AS inside GROUP BY 1',
    ),
)
def earliest_holiday(spark, sf):
    return holidays.holiday_impact(_window(spark, sf)).select(s.REGION, "first_holiday")


_JOINED = {
    "economic": ("Month", "GDP_Growth_Rate Consumer_Confidence_Index Inflation_Rate Unemployment_Rate Interest_Rate", "mean"),
    "weather": ("Month", "Avg_Temperature_C Total_Rainfall_mm Humidity_Percent Weather_Index", "mean"),
    "competitor": ("Week", "Competitor_Promotion_Intensity Competitor_Price_Undercut Competitor_New_Store_Opening", "zero"),
    "marketing": ("Week", "Ad_Spend_INR Impressions Clicks Conversions Campaign_Intensity", "zero"),
    "supply": ("Week", "Lead_Time_Days On_Time_Delivery_Rate Quality_Score Supplier_Reliability_Index Stockout_Events", "mean"),
    "bank_offers": ("Week", "Bank_Offer_Intensity Card_Promotion_Level", "zero"),
    "custom_discounts": ("Week", "Store_Discount_Level Loyalty_Discount_Available", "zero"),
    "custom_promotions": ("Week", "Promotion_Type_Code Promotion_Discount_Pct", "zero"),
}
_WHOLE = "Competitor_New_Store_Opening Impressions Clicks Conversions Loyalty_Discount_Available Promotion_Type_Code".split()
_VALUES = " ".join(c for _, v, _ in _JOINED.values() for c in v.split() if c not in _WHOLE)
_SEASONS = {"Is_Festival_Season": "(10, 11, 12)", "Is_Summer_Season": "(3, 4, 5)", "Is_Monsoon_Season": "(6, 7, 8, 9)"}
_HOLIDAYS = "Holiday_Count Is_Holiday_Week Is_Holiday Days_to_Next_Holiday Days_since_Last_Holiday".split()


def _all_features() -> str:
    """Per region and period, the rows and the greatest and least value of everything that is joined."""
    picks = [
        f"coalesce({t}.{c}, {'0' if fill == 'zero' else f'avg({t}.{c}) OVER ()'}) AS {c}"
        for t, (_, columns, fill) in _JOINED.items()
        for c in columns.split()
    ]
    joins = "\n".join(f'LEFT JOIN {t} ON p."Year" = {t}."Year" AND p."{k}" = {t}."{k}"' for t, (k, _, _) in _JOINED.items())
    flags = [f'CAST(max(CASE WHEN "Month" IN {months} THEN 1 ELSE 0 END) AS INTEGER) AS {c}' for c, months in _SEASONS.items()]
    days = [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _HOLIDAYS]
    whole = [f"CAST(max({c}) AS BIGINT) AS {c}" for c in _WHOLE]
    return f"""
SELECT RegionName, CAST("Year" AS INTEGER) AS "Year", CAST("Month" AS INTEGER) AS "Month",
       CAST("Week" AS INTEGER) AS "Week", max(Holiday_State_Code) AS "Holiday_State_Code", count(*) AS "rows", {', '.join(days + flags + whole)},
       {', '.join(f'max({c}) AS {c}' for c in _VALUES.split())}
FROM (SELECT p.RegionName, p."Year", p."Month", p."Week", h.* EXCLUDE (RegionName, week_end), {', '.join(picks)}
      FROM panel p JOIN holiday_features h ON p.RegionName = h.RegionName AND p.week_end = h.week_end
      {joins}) AS enriched
GROUP BY RegionName, "Year", "Month", "Week"
"""


@query(
    "E1_external_features",
    rounded("panel holiday_features " + " ".join(_JOINED), _all_features(), _VALUES).replace(
        "SELECT DISTINCT RegionName, state_code, week_end FROM clean",
        "SELECT DISTINCT w.RegionName, c.state_code, w.week_end FROM weekly w "
        "JOIN (SELECT DISTINCT RegionName, state_code FROM clean) c ON w.RegionName = c.RegionName",
    ),
)
def external_features(spark, sf):
    panel = materialize(_panel(spark, sf), "panel")
    enriched = external.add_external_features(panel, holiday_calendar(spark, sf), side_tables(spark, sf))
    return enriched.groupBy(s.REGION, "Year", "Month", "Week").agg(
        F.max("Holiday_State_Code").alias("Holiday_State_Code"),
        F.count("*").alias("rows"),
        *[F.sum(c).alias(c) for c in _HOLIDAYS],
        *[F.max(c).alias(c) for c in _SEASONS],
        *[F.max(c).cast("long").alias(c) for c in _WHOLE],
        *[F.max(c).alias(c) for c in _VALUES.split()],
    )


@query(
    "E2_attributes",
    rounded(
        "observed",
        """
SELECT o.StoreName, o.ProductName, count(*) AS weeks, CASE WHEN suppliers >= 5 THEN 'Large' WHEN suppliers >= 3 THEN 'Medium'
         ELSE 'Small' END AS Store_Size_Category, rating AS Store_Performance_Rating,
       CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'MEDIUM' THEN 2 ELSE 3 END
         AS Lifecycle_Code
FROM observed o
LEFT JOIN (SELECT n_name, count(*) AS suppliers, avg(s_acctbal) / 10000 AS rating
           FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) n ON o.StoreName = n.n_name
LEFT JOIN (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS place
           FROM part GROUP BY 1, 2) t ON o.ProductName = t.p_brand AND t.place = 1
GROUP BY 1, 2, 4, 5, 6
""",
        "Store_Performance_Rating",
    ),
)
def attributes(spark, sf):
    sales = canonical_sales(spark, sf, (*s.SERIES, s.BILL_DATE))
    weeks = sales.select(*s.SERIES, week_end(F.col(s.BILL_DATE)).alias(s.WEEK_END)).distinct()
    counted = weeks.groupBy(*s.PAIR).agg(F.count("*").alias("weeks"))
    joined = external.add_store_attributes(
        external.add_product_attributes(counted, product_attributes(spark, sf)), store_attributes(spark, sf)
    )
    return joined.select(
        *s.PAIR, "weeks", "Store_Size_Category", "Store_Performance_Rating", "Lifecycle_Code"
    )
