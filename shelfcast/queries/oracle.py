"""Shared DuckDB statements behind the checked queries."""

# Each entry: names it builds on, and its body.
CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (needs, body)


def sql(needs: str, body: str) -> str:
    """The body after the named common table expressions and all that they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0].split():
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    parts = ",\n".join(f"{n} AS (\n{CTES[n][1].strip()}\n)" for n in ordered)
    return f"WITH {parts}\n{body.strip()}" if parts else body.strip()


def rounded(needs: str, body: str, columns: str, digits: int = 6) -> str:
    """As ``sql``, with the given result columns rounded.

    The rounding is written out, since engines differ in how they round values that end in 5.
    """
    scale = f"{10 ** digits}.0::DOUBLE"
    replaced = ", ".join(
        f'floor(CAST("{c}" AS DOUBLE) * {scale} + 0.5::DOUBLE) / {scale} AS "{c}"' for c in columns.split()
    )
    return sql(needs, f"SELECT * REPLACE ({replaced}) FROM (\n{body.strip()}\n) AS answer")


cte(
    "sales",
    "",
    r"""
SELECT CASE r_name WHEN 'AFRICA' THEN 'Karnataka' WHEN 'AMERICA' THEN 'Tamil Nadu' WHEN 'ASIA' THEN 'mh'
         WHEN 'EUROPE' THEN 'Delhi' WHEN 'MIDDLE EAST' THEN 'Atlantis' END AS RegionName,
       n_name AS StoreName, p_brand AS ProductName, l_shipdate AS BillDate, l_quantity AS Quantity,
       l_extendedprice / nullif(l_quantity, 0) AS MRP,
       l_extendedprice * (l_discount + 0.0::DOUBLE) * 4.0::DOUBLE AS ProductLevelDiscAmount,
       l_quantity + l_linenumber AS td_raw, l_linenumber,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'HDFC Bank' WHEN '2-HIGH' THEN 'ICICI'
         WHEN '3-MEDIUM' THEN ' No ' WHEN '4-NOT SPECIFIED' THEN 'N/A' END AS emi_raw,
       CASE WHEN l_returnflag = 'R' THEN 'no offer'
         ELSE CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) || '% HDFC' END AS cashback_raw,
       CASE WHEN l_linenumber <> 1 THEN 'Scheme ' || l_linenumber || '.5 pct' END AS scheme_raw
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
""",
)
cte(
    "clean",
    "sales",
    r"""
SELECT *, CAST(BillDate AS DATE) AS bill_day,
       CAST(date_trunc('week', BillDate) AS DATE) + 6 AS week_end,
       CASE RegionName WHEN 'Karnataka' THEN 'KA' WHEN 'Tamil Nadu' THEN 'TN' WHEN 'mh' THEN 'MH'
         WHEN 'Delhi' THEN 'DL' ELSE RegionName END AS state_code,
       coalesce(ProductLevelDiscAmount / nullif(Quantity * MRP + 1e-5::DOUBLE, 0), 0) AS DiscountPct,
       coalesce(td_raw, 0) AS True_Demand,
       CASE WHEN emi_raw IS NULL OR lower(trim(emi_raw)) IN ('', 'nan', 'none', 'no', 'n/a')
         THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS Bank_Emi_Flag,
       coalesce(TRY_CAST(nullif(regexp_extract(cashback_raw, '([+-]?\d+(?:\.\d+)?)', 1), '') AS DOUBLE), 0)
         AS Bank_Cashback_Pct,
       coalesce(TRY_CAST(nullif(regexp_extract(scheme_raw, '([+-]?\d+(?:\.\d+)?)', 1), '') AS DOUBLE), 0)
         AS Additional_Funded_Scheme_Pct
FROM sales
""",
)
cte(
    "observed",
    "clean",
    """
SELECT RegionName, StoreName, ProductName, week_end, sum(Quantity) AS Quantity, sum(True_Demand) AS True_Demand,
       avg(MRP) AS MRP, avg(DiscountPct) AS DiscountPct, avg(ProductLevelDiscAmount) AS ProductLevelDiscAmount,
       avg(Bank_Emi_Flag) AS Bank_Emi_Flag, avg(Bank_Cashback_Pct) AS Bank_Cashback_Pct,
       avg(Additional_Funded_Scheme_Pct) AS Additional_Funded_Scheme_Pct
FROM clean GROUP BY RegionName, StoreName, ProductName, week_end
""",
)
cte(
    "spine",
    "observed",
    """
SELECT RegionName, StoreName, ProductName,
       CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
FROM observed GROUP BY RegionName, StoreName, ProductName
""",
)
cte(
    "weekly",
    "spine observed",
    """
SELECT s.RegionName, s.StoreName, s.ProductName, s.week_end,
       CAST(round_even(greatest(coalesce(o.Quantity, 0), 0), 0) AS BIGINT) AS Quantity,
       coalesce(o.True_Demand, 0) AS True_Demand, o.MRP, o.DiscountPct, o.Bank_Emi_Flag, o.Bank_Cashback_Pct,
       o.Additional_Funded_Scheme_Pct
FROM spine s LEFT JOIN observed o ON s.RegionName = o.RegionName AND s.StoreName = o.StoreName
 AND s.ProductName = o.ProductName AND s.week_end = o.week_end
""",
)
cte(
    "panel",
    "weekly",
    """
SELECT *, year(week_end) AS "Year", month(week_end) AS "Month", week(week_end) AS "Week",
       MRP * (1 - DiscountPct) AS Effective_Price, True_Demand / (Quantity + 1e-5::DOUBLE) AS TrueDemand_Ratio,
       CASE WHEN DiscountPct > 0.05::DOUBLE AND DiscountPct <= 0.15::DOUBLE THEN 1
            WHEN DiscountPct > 0.15::DOUBLE AND DiscountPct <= 0.3::DOUBLE THEN 2
            WHEN DiscountPct > 0.3::DOUBLE AND DiscountPct <= 1 THEN 3 ELSE 0 END AS Discount_Intensity,
       CASE WHEN Bank_Cashback_Pct > 0 AND Bank_Cashback_Pct <= 2 THEN 1
            WHEN Bank_Cashback_Pct > 2 AND Bank_Cashback_Pct <= 5 THEN 2
            WHEN Bank_Cashback_Pct > 5 AND Bank_Cashback_Pct <= 10 THEN 3
            WHEN Bank_Cashback_Pct > 10 AND Bank_Cashback_Pct <= 100 THEN 4 ELSE 0 END AS Bank_Cashback_Intensity,
       CASE WHEN Additional_Funded_Scheme_Pct > 0 AND Additional_Funded_Scheme_Pct <= 2 THEN 1
            WHEN Additional_Funded_Scheme_Pct > 2 AND Additional_Funded_Scheme_Pct <= 5 THEN 2
            WHEN Additional_Funded_Scheme_Pct > 5 AND Additional_Funded_Scheme_Pct <= 10 THEN 3
            WHEN Additional_Funded_Scheme_Pct > 10 AND Additional_Funded_Scheme_Pct <= 100 THEN 4 ELSE 0 END
            AS Additional_Funded_Scheme_Intensity
FROM weekly
""",
)


def _frame(n: int, last: str = "CURRENT ROW") -> str:
    return (
        "(PARTITION BY ProductName, StoreName ORDER BY RegionName, week_end "
        f"ROWS BETWEEN {n} PRECEDING AND {last})"
    )


def _rolling(function: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER w{n} = {n} THEN {function}(Quantity) OVER w{n} ELSE 0 END"


cte(
    "features",
    "weekly",
    f"""
SELECT *, {', '.join(f'coalesce(lag(Quantity, {k}) OVER w, 0) AS Lag_{k}_Week' for k in (1, 2, 3, 4, 8, 12))},
       {', '.join(f'{_rolling("avg", n)} AS Rolling_Mean_{n}' for n in (2, 4, 8, 12))},
       {', '.join(f'{_rolling("stddev_samp", n)} AS Rolling_Std_{n}' for n in (2, 4, 8, 12))},
       lag(Quantity, 4) OVER w AS q4, row_number() OVER w AS rn, list(Quantity) OVER w96 AS history
FROM weekly
WINDOW w AS (PARTITION BY ProductName, StoreName ORDER BY RegionName, week_end),
       {', '.join(f'w{n} AS {_frame(n - 1)}' for n in (2, 4, 8, 12, 96))}
""",
)
cte(
    "past",
    "weekly",
    f"""
SELECT *, lag(Quantity, 1) OVER w AS lag1, row_number() OVER w AS rn,
       {', '.join(f'CASE WHEN count(*) OVER p{n} = {n} THEN avg(Quantity) OVER p{n} ELSE 0 END AS past_mean_{n}' for n in (2, 4, 12))}
FROM weekly
WINDOW w AS (PARTITION BY ProductName, StoreName ORDER BY RegionName, week_end),
       {', '.join(f"p{n} AS {_frame(n, '1 PRECEDING')}" for n in (2, 4, 12))}
""",
)
cte(
    "calendar",
    "",
    """
SELECT v.code, make_date(y.year, v.month, v.day) AS holiday_date, v.name
FROM (SELECT DISTINCT CAST(year(CAST(date_trunc('week', l_shipdate) AS DATE) + 6) AS INTEGER) AS year FROM lineitem) y
CROSS JOIN (VALUES (NULL, 1, 26, 'Republic Day'), (NULL, 8, 15, 'Independence Day'), (NULL, 10, 2, 'Gandhi Jayanti'),
 (NULL, 12, 25, 'Christmas'), ('KA', 11, 1, 'Rajyotsava'), ('TN', 1, 15, 'Pongal'), ('MH', 5, 1, 'Maharashtra Day'),
 ('DL', 2, 12, 'Delhi Day')) v(code, month, day, name)
""",
)
cte("region_weeks", "clean", "SELECT DISTINCT RegionName, state_code, week_end FROM clean")
cte(
    "holiday_features",
    "region_weeks calendar",
    """
SELECT k.RegionName, k.state_code AS Holiday_State_Code, k.week_end,
       CAST(count(DISTINCT CASE WHEN holiday_date BETWEEN k.week_end - 6 AND k.week_end THEN holiday_date END) AS INTEGER)
         AS Holiday_Count,
       CAST(max(CASE WHEN holiday_date BETWEEN k.week_end - 6 AND k.week_end THEN 1 ELSE 0 END) AS INTEGER)
         AS Is_Holiday_Week,
       CAST(max(CASE WHEN holiday_date = k.week_end THEN 1 ELSE 0 END) AS INTEGER) AS Is_Holiday,
       CAST(coalesce(min(CASE WHEN holiday_date > k.week_end THEN holiday_date - k.week_end END), 365) AS INTEGER)
         AS Days_to_Next_Holiday,
       CAST(coalesce(min(CASE WHEN holiday_date < k.week_end THEN k.week_end - holiday_date END), 365) AS INTEGER)
         AS Days_since_Last_Holiday
FROM region_weeks k
LEFT JOIN (SELECT * FROM calendar WHERE year(holiday_date) IN (SELECT DISTINCT year(week_end) FROM region_weeks)) h
  ON h.code IS NULL OR h.code = k.state_code
GROUP BY k.RegionName, k.state_code, k.week_end
""",
)

MONTH_FIGURES = """
SELECT year(o_orderdate) AS "Year", month(o_orderdate) AS "Month", CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mean_price,
       max(o_totalprice) AS max_price, min(o_totalprice) AS min_price, CAST(count(*) AS DOUBLE) AS n
FROM orders GROUP BY 1, 2 HAVING (year(o_orderdate) * 12 + month(o_orderdate)) % 7 <> 0
"""
cte("month_figures", "", MONTH_FIGURES)
cte(
    "economic",
    "month_figures",
    """
SELECT "Year", "Month", mean_price / 100000 AS GDP_Growth_Rate, n AS Consumer_Confidence_Index,
       max_price / 100000 AS Inflation_Rate, min_price / 1000 AS Unemployment_Rate, mean_price / 50000 AS Interest_Rate
FROM month_figures
""",
)
cte(
    "weather",
    "month_figures",
    """
SELECT "Year", "Month", mean_price / 10000 AS Avg_Temperature_C, n AS Total_Rainfall_mm,
       max_price / 10000 AS Humidity_Percent, min_price / 100 AS Weather_Index
FROM month_figures
""",
)
cte(
    "competitor",
    "",
    """
SELECT year(o_orderdate) AS "Year", week(o_orderdate) AS "Week",
       avg(floor(o_totalprice / 1000)) AS Competitor_Promotion_Intensity,
       avg(CAST(o_orderkey % 50 AS DOUBLE)) AS Competitor_Price_Undercut,
       max(CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) AS Competitor_New_Store_Opening
FROM orders GROUP BY 1, 2
""",
)
cte(
    "marketing",
    "",
    """
SELECT year(o_orderdate) AS "Year", week(o_orderdate) AS "Week", sum(floor(o_totalprice)) AS Ad_Spend_INR,
       CAST(sum(o_orderkey % 1000) AS BIGINT) AS Impressions, CAST(sum(o_orderkey % 100) AS BIGINT) AS Clicks,
       CAST(sum(o_orderkey % 10) AS BIGINT) AS Conversions, avg(floor(o_totalprice / 5000)) AS Campaign_Intensity
FROM orders GROUP BY 1, 2
""",
)
cte(
    "supply",
    "",
    """
SELECT "Year", "Week", avg(lead_time) AS Lead_Time_Days, avg(on_time) AS On_Time_Delivery_Rate,
       avg(quality) AS Quality_Score, avg(reliability) AS Supplier_Reliability_Index, avg(stockouts) AS Stockout_Events
FROM (SELECT year(l_shipdate) AS "Year", week(l_shipdate) AS "Week", p_brand, avg(l_linenumber * 3.0::DOUBLE) AS lead_time,
             avg(100.0::DOUBLE - round(l_discount * 100)) AS on_time, avg(l_quantity) AS quality,
             avg(round(l_tax * 100) + 0.0::DOUBLE) AS reliability, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS stockouts
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) AS by_product
GROUP BY 1, 2
""",
)
cte(
    "week_figures",
    "",
    """
SELECT year(o_orderdate) AS "Year", week(o_orderdate) AS "Week", CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mean_price, count(*) AS n
FROM orders GROUP BY 1, 2 HAVING week(o_orderdate) % 2 = 1
""",
)
cte(
    "bank_offers",
    "week_figures",
    """
SELECT "Year", "Week", mean_price / 1000 AS Bank_Offer_Intensity, CAST(n % 5 AS DOUBLE) AS Card_Promotion_Level
FROM week_figures
""",
)
cte(
    "custom_discounts",
    "week_figures",
    """
SELECT "Year", "Week", mean_price / 2000 AS Store_Discount_Level, CAST(n % 2 AS INTEGER) AS Loyalty_Discount_Available
FROM week_figures
""",
)
cte(
    "custom_promotions",
    "week_figures",
    """
SELECT "Year", "Week", CAST(n % 4 AS INTEGER) AS Promotion_Type_Code, CAST(n % 30 AS DOUBLE) AS Promotion_Discount_Pct
FROM week_figures
""",
)
cte("active", "sales", "SELECT * FROM sales WHERE BillDate < TIMESTAMP '2000-01-01'")
cte(
    "upload",
    "sales",
    """
SELECT * FROM sales WHERE BillDate >= TIMESTAMP '1999-07-01'
UNION ALL
SELECT * FROM sales WHERE BillDate >= TIMESTAMP '1999-12-01' AND BillDate < TIMESTAMP '2000-01-01'
""",
)
COMPARED = "RegionName, StoreName, ProductName, BillDate, Quantity, MRP, ProductLevelDiscAmount"
cte("added", "upload active", f"SELECT {COMPARED} FROM upload EXCEPT SELECT {COMPARED} FROM active")
cte("daily", "sales", "SELECT CAST(BillDate AS DATE) AS day, sum(Quantity) AS Quantity FROM sales GROUP BY 1")
cte(
    "changes",
    "daily",
    """
SELECT day, Quantity, lag(Quantity) OVER (ORDER BY day) AS previous,
       Quantity - lag(Quantity) OVER (ORDER BY day) AS change,
       (Quantity - lag(Quantity) OVER (ORDER BY day)) / nullif(lag(Quantity) OVER (ORDER BY day), 0) AS pct_change
FROM daily
""",
)
cte(
    "store_daily",
    "sales",
    "SELECT StoreName, CAST(BillDate AS DATE) AS day, sum(Quantity) AS Quantity FROM sales GROUP BY 1, 2",
)
cte(
    "store_changes",
    "store_daily",
    """
SELECT StoreName, day, Quantity, lag(Quantity) OVER w AS previous, Quantity - lag(Quantity) OVER w AS change,
       (Quantity - lag(Quantity) OVER w) / nullif(lag(Quantity) OVER w, 0) AS pct_change
FROM store_daily WINDOW w AS (PARTITION BY StoreName ORDER BY day)
""",
)


def anchors(cutoff: str) -> str:
    """Body of the last known metrics up to a date, from gap-free weeks."""
    return f"""
SELECT StoreName, ProductName,
       max(CASE WHEN back = 1 THEN Quantity END) AS last_week_qty, avg(Quantity) AS rolling_4_avg,
       max(CASE WHEN back = 1 THEN True_Demand END) AS last_true_demand,
       max(CASE WHEN back = 1 THEN emi END) AS last_emi_ratio,
       max(CASE WHEN back = 1 THEN cashback END) AS last_cashback_pct,
       max(CASE WHEN back = 1 THEN scheme END) AS last_additional_pct
FROM (
  SELECT d.StoreName, d.ProductName, coalesce(w.Quantity, 0) AS Quantity, coalesce(w.True_Demand, 0) AS True_Demand,
         w.emi, w.cashback, w.scheme,
         row_number() OVER (PARTITION BY d.StoreName, d.ProductName ORDER BY d.week_end DESC) AS back
  FROM (SELECT StoreName, ProductName,
               CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
        FROM clean WHERE BillDate <= TIMESTAMP '{cutoff}' GROUP BY 1, 2) d
  LEFT JOIN (SELECT StoreName, ProductName, week_end, sum(Quantity) AS Quantity, sum(True_Demand) AS True_Demand,
                    avg(Bank_Emi_Flag) AS emi, avg(Bank_Cashback_Pct) AS cashback,
                    avg(Additional_Funded_Scheme_Pct) AS scheme
             FROM clean WHERE BillDate <= TIMESTAMP '{cutoff}' GROUP BY 1, 2, 3) w
    ON d.StoreName = w.StoreName AND d.ProductName = w.ProductName AND d.week_end = w.week_end
) AS placed WHERE back <= 4 GROUP BY StoreName, ProductName
"""


START = "2001-06-30"
cte("anchor", "clean", anchors(START))
cte(
    "choices",
    "sales",
    """
SELECT s.RegionName, s.StoreName, p.ProductName
FROM (SELECT DISTINCT RegionName, StoreName FROM sales) s
JOIN (SELECT DISTINCT StoreName, ProductName FROM sales) p ON s.StoreName = p.StoreName
""",
)
cte(
    "future",
    "choices anchor",
    f"""
SELECT c.RegionName, c.StoreName, c.ProductName, CAST(w.week_index AS INTEGER) AS week_index,
       CAST(DATE '{START}' + CAST(7 * w.week_index AS INTEGER) AS DATE) AS week_start,
       coalesce(a.last_week_qty, 0) AS last_week_qty, coalesce(a.rolling_4_avg, 0) AS rolling_4_avg,
       coalesce(a.last_true_demand, 0) AS last_true_demand, coalesce(a.last_emi_ratio, 0) AS last_emi_ratio,
       coalesce(a.last_cashback_pct, 0) AS last_cashback_pct, coalesce(a.last_additional_pct, 0) AS last_additional_pct
FROM choices c LEFT JOIN anchor a ON c.StoreName = a.StoreName AND c.ProductName = a.ProductName
CROSS JOIN (SELECT unnest(generate_series(0, 8)) AS week_index) w
""",
)
cte(
    "volatility",
    "sales",
    """
SELECT StoreName, ProductName,
       CASE WHEN count(*) > 1 THEN stddev_pop(Quantity) ELSE 0 END AS daily_sigma
FROM (
  SELECT f.StoreName, f.ProductName, f.day, coalesce(o.Quantity, 0) AS Quantity
  FROM (SELECT StoreName, ProductName,
               CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT StoreName, ProductName, CAST(BillDate AS DATE) AS day,
                     max(BillDate) OVER (PARTITION BY StoreName, ProductName) AS newest, BillDate FROM sales) AS dated
        WHERE BillDate >= newest - INTERVAL 180 DAY GROUP BY 1, 2) f
  LEFT JOIN (SELECT StoreName, ProductName, CAST(BillDate AS DATE) AS day, sum(Quantity) AS Quantity
             FROM sales GROUP BY 1, 2, 3) o
    ON f.StoreName = o.StoreName AND f.ProductName = o.ProductName AND f.day = o.day
) AS filled GROUP BY StoreName, ProductName
""",
)
cte(
    "stock",
    "future volatility",
    """
SELECT *, CAST(round_even(daily_velocity * 7 + safety_stock, 0) AS BIGINT) AS reorder_point,
       CAST(round_even(total_demand * 1.15::DOUBLE, 0) AS BIGINT) AS procurement_quantity
FROM (
  SELECT *, CAST(round_even(1.65::DOUBLE * sigma * sqrt(7.0::DOUBLE), 0) AS BIGINT) AS safety_stock
  FROM (
    SELECT t.*, total_demand / 30.0::DOUBLE AS daily_velocity,
           greatest(coalesce(v.daily_sigma, 0), forecast_sum / 30.0::DOUBLE * 0.15::DOUBLE) AS sigma
    FROM (SELECT RegionName, StoreName, ProductName, sum(rolling_4_avg) AS forecast_sum,
                 avg(rolling_4_avg) AS weekly_velocity, CAST(round_even(sum(rolling_4_avg), 0) AS BIGINT) AS total_demand
          FROM future WHERE week_index < 5 GROUP BY 1, 2, 3) t
    LEFT JOIN volatility v ON t.StoreName = v.StoreName AND t.ProductName = v.ProductName
  ) AS spread
) AS safe
""",
)
cte(
    "base_codes",
    "sales",
    """
SELECT 'RegionName' AS kind, RegionName AS label, dense_rank() OVER (ORDER BY RegionName) - 1 AS code
FROM (SELECT DISTINCT RegionName FROM sales)
UNION ALL
SELECT 'StoreName', StoreName, dense_rank() OVER (ORDER BY StoreName) - 1 FROM (SELECT DISTINCT StoreName FROM sales)
UNION ALL
SELECT 'ProductName', ProductName, dense_rank() OVER (ORDER BY ProductName) - 1
FROM (SELECT DISTINCT ProductName FROM sales)
""",
)
