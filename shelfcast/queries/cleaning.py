"""Reading, cleaning and row-level expressions (P, D, N, T)."""

from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions import calendar as cal
from shelfcast.functions import pricing, states, text
from shelfcast.operators import cleaning, external
from shelfcast.operators.encoding import composite
from shelfcast.operators.forecasting import align
from shelfcast.operators.weekly import weekly_demand
from shelfcast.plans.features import add_calendar_features, add_price_features
from shelfcast.queries.oracle import rounded, sql
from shelfcast.queries.registry import query
from shelfcast.sources.star_schema import canonical_sales, product_attributes, table


@query(
    "P1_parse_dates",
    """
SELECT StoreDay AS day, count(*) AS "rows" FROM (
  SELECT TRY_CAST(CASE l_linenumber % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
    WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') ELSE '' END AS DATE) AS StoreDay FROM lineitem) AS parsed
WHERE StoreDay IS NOT NULL GROUP BY 1
""",
)
def parse_dates(spark, sf):
    date = F.col("l_shipdate")
    kind = F.col("l_linenumber") % 4
    written = (
        F.when(kind == 0, F.lit("unknown"))
        .when(kind == 1, F.date_format(date, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit(""))
    )
    sales = table(spark, sf, "lineitem").select(written.alias(s.BILL_DATE))
    parsed = cleaning.parse_bill_date(sales)
    return parsed.groupBy(cal.day(F.col(s.BILL_DATE)).alias("day")).agg(F.count("*").alias("rows"))


@query(
    "P2_first_number",
    sql(
        "clean",
        """
SELECT cashback_raw, scheme_raw, max(Bank_Cashback_Pct) AS Bank_Cashback_Pct,
       max(Additional_Funded_Scheme_Pct) AS Additional_Funded_Scheme_Pct, count(*) AS "rows"
FROM clean GROUP BY cashback_raw, scheme_raw
""",
    ),
)
def first_number(spark, sf):
    texts = canonical_sales(spark, sf, (s.CASHBACK_RAW, s.SCHEME_RAW)).toDF("cashback_raw", "scheme_raw")
    return (
        texts.groupBy("cashback_raw", "scheme_raw")
        .agg(F.count("*").alias("rows"))
        .withColumn("Bank_Cashback_Pct", text.first_number(F.col("cashback_raw")))
        .withColumn("Additional_Funded_Scheme_Pct", text.first_number(F.col("scheme_raw")))
    )


@query(
    "P3_offer_flag",
    sql(
        "clean",
        'SELECT emi_raw, max(Bank_Emi_Flag) AS Bank_Emi_Flag, count(*) AS "rows" FROM clean GROUP BY emi_raw',
    ),
)
def offer_flag(spark, sf):
    texts = canonical_sales(spark, sf, (s.EMI_RAW,)).toDF("emi_raw")
    counted = texts.groupBy("emi_raw").agg(F.count("*").alias("rows"))
    return counted.withColumn("Bank_Emi_Flag", text.offer_flag(F.col("emi_raw")))


@query(
    "P4_true_demand_number",
    """
SELECT p_brand AS ProductName, sum(coalesce(TRY_CAST(CASE l_linenumber % 4 WHEN 0 THEN 'n/a'
  WHEN 1 THEN ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' ' WHEN 2 THEN '12 units'
  ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5' END AS DOUBLE), 0)) AS True_Demand
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
""",
)
def true_demand_number(spark, sf):
    lines = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    whole = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber") % 4
    written = (
        F.when(kind == 0, F.lit("n/a"))
        .when(kind == 1, F.concat(F.lit(" "), whole, F.lit(" ")))
        .when(kind == 2, F.lit("12 units"))
        .otherwise(F.concat(whole, F.lit(".5")))
    )
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy(F.col("p_brand").alias(s.PRODUCT))
        .agg(F.sum(text.number_or_zero(written)).alias("True_Demand"))
    )


@query(
    "P5_absent_columns",
    rounded(
        "clean",
        """
SELECT StoreName, count(*) AS "rows", sum(DiscountPct) AS DiscountPct, 0.0::DOUBLE AS True_Demand,
       0.0::DOUBLE AS Bank_Emi_Flag, 0.0::DOUBLE AS Bank_Cashback_Pct, 0.0::DOUBLE AS Additional_Funded_Scheme_Pct
FROM clean GROUP BY StoreName
""",
        "DiscountPct",
    ),
)
def absent_columns(spark, sf):
    sales = cleaning.add_sale_measures(canonical_sales(spark, sf, s.REQUIRED))
    measures = ("DiscountPct", "True_Demand", "Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct")
    return sales.groupBy(s.STORE).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in measures])


@query(
    "P6_discount_pct",
    rounded(
        "clean",
        """
SELECT StoreName, ProductName, sum(DiscountPct) AS total, min(DiscountPct) AS lowest, max(DiscountPct) AS highest
FROM clean GROUP BY StoreName, ProductName
""",
        "total lowest highest",
    ),
)
def discount_pct(spark, sf):
    columns = (s.STORE, s.PRODUCT, s.QUANTITY, s.MRP, s.DISCOUNT_AMOUNT)
    sales = canonical_sales(spark, sf, columns).withColumn(
        "pct", pricing.discount_pct(F.col(s.DISCOUNT_AMOUNT), F.col(s.QUANTITY), F.col(s.MRP))
    )
    return sales.groupBy(*s.PAIR).agg(
        F.sum("pct").alias("total"), F.min("pct").alias("lowest"), F.max("pct").alias("highest")
    )


@query(
    "P7_select_series",
    sql(
        "sales",
        """
SELECT RegionName, StoreName, ProductName, CAST(BillDate AS DATE) AS bill_day, Quantity FROM sales
WHERE RegionName = 'Delhi' AND StoreName = 'NATION_3' AND ProductName = 'Brand#7'
""",
    ),
)
def select_series(spark, sf):
    sales = canonical_sales(spark, sf, (*s.SERIES, s.BILL_DATE, s.QUANTITY))
    chosen = cleaning.select_series(sales, region="Delhi", store="NATION_3", product="Brand#7")
    return chosen.select(*s.SERIES, cal.day(F.col(s.BILL_DATE)).alias("bill_day"), s.QUANTITY)


@query(
    "P8_up_to",
    sql(
        "sales",
        """
SELECT StoreName, ProductName, count(*) AS "rows", CAST(max(BillDate) AS DATE) AS last_day
FROM sales WHERE BillDate <= TIMESTAMP '1998-06-30' GROUP BY 1, 2
""",
    ),
)
def up_to(spark, sf):
    sales = cleaning.up_to(canonical_sales(spark, sf, (s.STORE, s.PRODUCT, s.BILL_DATE)), "1998-06-30")
    return sales.groupBy(*s.PAIR).agg(
        F.count("*").alias("rows"), cal.day(F.max(s.BILL_DATE)).alias("last_day")
    )


@query(
    "P9_retraining_window",
    sql(
        "sales",
        """
SELECT StoreName, count(*) AS "rows", CAST(min(BillDate) AS DATE) AS first_day
FROM sales WHERE BillDate >= (SELECT max(BillDate) - INTERVAL 3 YEAR FROM sales) GROUP BY 1
""",
    ),
)
def retraining_window(spark, sf):
    sales = canonical_sales(spark, sf, (s.STORE, s.BILL_DATE))
    kept = cleaning.retraining_window(sales, strategy="rolling")
    return kept.groupBy(s.STORE).agg(F.count("*").alias("rows"), cal.day(F.min(s.BILL_DATE)).alias("first_day"))


@query(
    "P10_whole_units",
    """
SELECT l_quantity / 2 - 10 AS raw, CAST(round_even(greatest(l_quantity / 2 - 10, 0), 0) AS BIGINT) AS units,
       count(*) AS "rows" FROM lineitem GROUP BY 1, 2
""",
)
def whole_units(spark, sf):
    raw = (F.col("l_quantity") / 2 - 10).alias("raw")
    counted = table(spark, sf, "lineitem").groupBy(raw).agg(F.count("*").alias("rows"))
    return counted.withColumn("units", pricing.whole_units(F.col("raw")))


def _panel(spark, sf, columns=(*s.REQUIRED, *s.OPTIONAL)):
    return add_price_features(weekly_demand(canonical_sales(spark, sf, columns)))


def _priced(name, column, body):
    return query(name, rounded("panel", body, column, 4), digits=4)


@_priced(
    "P11_effective_price",
    "total highest",
    """
SELECT RegionName, StoreName, ProductName, count(Effective_Price) AS priced_weeks, sum(Effective_Price) AS total,
       max(Effective_Price) AS highest
FROM panel GROUP BY 1, 2, 3
""",
)
def effective_price(spark, sf):
    return _panel(spark, sf).groupBy(*s.SERIES).agg(
        F.count("Effective_Price").alias("priced_weeks"),
        F.sum("Effective_Price").alias("total"),
        F.max("Effective_Price").alias("highest"),
    )


@_priced(
    "P12_true_demand_ratio",
    "total highest",
    """
SELECT RegionName, StoreName, ProductName, sum(TrueDemand_Ratio) AS total, max(TrueDemand_Ratio) AS highest
FROM panel GROUP BY 1, 2, 3
""",
)
def true_demand_ratio(spark, sf):
    return _panel(spark, sf).groupBy(*s.SERIES).agg(
        F.sum("TrueDemand_Ratio").alias("total"), F.max("TrueDemand_Ratio").alias("highest")
    )


@_priced(
    "P13_discount_band",
    "lowest highest",
    """
SELECT Discount_Intensity, count(*) AS weeks, min(DiscountPct) AS lowest, max(DiscountPct) AS highest
FROM panel GROUP BY 1
""",
)
def discount_band(spark, sf):
    return _panel(spark, sf).groupBy("Discount_Intensity").agg(
        F.count("*").alias("weeks"), F.min("DiscountPct").alias("lowest"), F.max("DiscountPct").alias("highest")
    )


@_priced(
    "P14_offer_bands",
    "cashback scheme",
    """
SELECT Bank_Cashback_Intensity, Additional_Funded_Scheme_Intensity, count(*) AS weeks,
       max(Bank_Cashback_Pct) AS cashback, max(Additional_Funded_Scheme_Pct) AS scheme
FROM panel GROUP BY 1, 2
""",
)
def offer_bands(spark, sf):
    return _panel(spark, sf).groupBy("Bank_Cashback_Intensity", "Additional_Funded_Scheme_Intensity").agg(
        F.count("*").alias("weeks"),
        F.max("Bank_Cashback_Pct").alias("cashback"),
        F.max("Additional_Funded_Scheme_Pct").alias("scheme"),
    )


_NAMES_SQL = """
SELECT name, count(*) AS "rows", max(CASE
  WHEN lower(name) = 'karnataka' THEN 'KA' WHEN name = 'Delhi' THEN 'DL' WHEN name = 'mh' THEN 'MH' WHEN name = 'R' THEN 'R'
  {tamil}
  WHEN name = 'Atlantis' THEN 'Atlantis'
  ELSE upper(substr(regexp_replace(name, '[^A-Za-z]', '', 'g'), 1, 1))
       || lower(substr(regexp_replace(name, '[^A-Za-z]', '', 'g'), 2)) END) AS code
FROM (SELECT RegionName AS name FROM sales UNION ALL SELECT ProductName FROM sales
      UNION ALL SELECT StoreName FROM sales UNION ALL SELECT c_mktsegment FROM customer) AS names GROUP BY name
"""


def _state_codes(spark, sf, **options):
    sales = canonical_sales(spark, sf, s.SERIES)
    texts = sales.select(F.explode(F.array(*s.SERIES)).alias("name"))
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"))
    counted = texts.unionByName(segments).groupBy("name").agg(F.count("*").alias("rows"))
    return counted.withColumn("code", states.state_code(F.col("name"), **options))


@query("P15_state_code", sql("sales", _NAMES_SQL.format(tamil="WHEN name = 'Tamil Nadu' THEN 'TN'")))
def state_code(spark, sf):
    return _state_codes(spark, sf)


@query("P15_state_code_reference_case", sql("sales", _NAMES_SQL.format(tamil="")))
def state_code_reference_case(spark, sf):
    return _state_codes(spark, sf, reference_case=True)


@query(
    "P16_season_flags",
    """
SELECT month(l_shipdate)::INTEGER AS "Month", count(*) AS "rows",
       max(CASE WHEN month(l_shipdate) IN (10, 11, 12) THEN 1 ELSE 0 END)::INTEGER AS Is_Festival_Season,
       max(CASE WHEN month(l_shipdate) IN (3, 4, 5) THEN 1 ELSE 0 END)::INTEGER AS Is_Summer_Season,
       max(CASE WHEN month(l_shipdate) IN (6, 7, 8, 9) THEN 1 ELSE 0 END)::INTEGER AS Is_Monsoon_Season
FROM lineitem GROUP BY 1
""",
)
def season_flags(spark, sf):
    months = table(spark, sf, "lineitem").groupBy(F.month("l_shipdate").alias("Month")).agg(F.count("*").alias("rows"))
    return external.add_seasons(months)


@query(
    "P17_composite_keys",
    """
SELECT l_linenumber || '_' || l_suppkey AS Product_Store_Combo, month(l_shipdate) || '_' || l_linenumber AS Month_Product,
       count(*) AS "rows" FROM lineitem GROUP BY 1, 2
""",
)
def composite_keys(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            composite(F.col("l_linenumber"), F.col("l_suppkey")).alias("Product_Store_Combo"),
            composite(F.month("l_shipdate"), F.col("l_linenumber")).alias("Month_Product"),
        )
        .agg(F.count("*").alias("rows"))
    )


_PARTS = {c: f'{c.lower()}(week_end)' for c in ("Week", "Month", "Year", "Quarter")} | {
    "Is_Month_Start": "CASE WHEN day(week_end) = 1 THEN 1 ELSE 0 END",
    "Is_Month_End": "CASE WHEN week_end = last_day(week_end) THEN 1 ELSE 0 END",
}
_WAVES = {
    f"{p}_{n}": f"{f}(2 * pi() * {p.lower()}(week_end) / {period}.0::DOUBLE)"
    for p, period in (("Week", 52), ("Month", 12)) for n, f in (("Sin", "sin"), ("Cos", "cos"))
}
_MEANS = ["True_Demand", "TrueDemand_Ratio", "Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct", "DiscountPct", "Effective_Price"]
_BANDS = ["Bank_Cashback_Intensity", "Additional_Funded_Scheme_Intensity", "Discount_Intensity"]
_ALIGNED = (
    [f'CAST(sum({v}) AS BIGINT) AS "{c}"' for c, v in _PARTS.items()]
    + [f'sum({v}) AS "{c}"' for c, v in _WAVES.items()]
    + [f"sum({c}) AS {c}" for c in _MEANS]
    + [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _BANDS]
    + [f'0.0::DOUBLE AS "{c}"' for c in s.FEATURES if c not in {*_PARTS, *_WAVES, *_MEANS, *_BANDS}]
)


@query(
    "P18_align_features",
    rounded(
        "panel",
        f'SELECT StoreName, {", ".join(_ALIGNED)}, count(*) AS "rows" FROM panel GROUP BY StoreName',
        " ".join([*_WAVES, *_MEANS]),
        3,
    ),
    digits=3,
)
def align_features(spark, sf):
    """All the model's columns, summed per store; those that the panel lacks are 0."""
    frame = align(add_calendar_features(_panel(spark, sf)), s.FEATURES, (s.STORE,))
    return frame.groupBy(s.STORE).agg(*[F.sum(c).alias(c) for c in s.FEATURES], F.count("*").alias("rows"))


@query(
    "P19_fill_zero",
    rounded(
        "weekly",
        """
SELECT StoreName, ProductName, avg(coalesce(MRP, 0)) AS MRP, avg(coalesce(DiscountPct, 0)) AS DiscountPct
FROM weekly GROUP BY 1, 2
""",
        "MRP DiscountPct",
    ),
)
def fill_zero(spark, sf):
    filled = external.fill_zero(weekly_demand(canonical_sales(spark, sf)), (s.MRP, "DiscountPct"))
    return filled.groupBy(*s.PAIR).agg(F.avg(s.MRP).alias(s.MRP), F.avg("DiscountPct").alias("DiscountPct"))


@query(
    "P20_fill_mean",
    rounded(
        "weekly",
        """
SELECT StoreName, ProductName, avg(MRP) AS MRP, avg(DiscountPct) AS DiscountPct FROM (
  SELECT StoreName, ProductName, coalesce(MRP, avg(MRP) OVER ()) AS MRP,
         coalesce(DiscountPct, avg(DiscountPct) OVER ()) AS DiscountPct FROM weekly) AS filled
GROUP BY 1, 2
""",
        "MRP DiscountPct",
    ),
)
def fill_mean(spark, sf):
    filled = external.fill_mean(weekly_demand(canonical_sales(spark, sf)), (s.MRP, "DiscountPct"))
    return filled.groupBy(*s.PAIR).agg(F.avg(s.MRP).alias(s.MRP), F.avg("DiscountPct").alias("DiscountPct"))


@query(
    "P21_lifecycle_code",
    """
SELECT ProductName, stage AS Product_Lifecycle_Stage, CASE stage WHEN 'Introduction' THEN 0 WHEN 'Growth' THEN 1
       WHEN 'Maturity' THEN 2 ELSE 3 END AS Lifecycle_Code
FROM (SELECT p_brand AS ProductName, CASE p_type WHEN 'ECONOMY' THEN 'Introduction' WHEN 'PROMO' THEN 'Growth'
        WHEN 'STANDARD' THEN 'Maturity' WHEN 'MEDIUM' THEN 'Maturity' ELSE 'Decline' END AS stage,
        row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS place
      FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) AS counted) AS ranked
WHERE place = 1
""",
)
def lifecycle_code(spark, sf):
    products = product_attributes(spark, sf)
    return products.withColumn("Lifecycle_Code", external.lifecycle_code(F.col("Product_Lifecycle_Stage")))


@query(
    "P22_clip_predictions",
    rounded(
        "features",
        """
SELECT StoreName, ProductName, sum(greatest(Rolling_Mean_4 - 20, 0)) AS clipped FROM features GROUP BY 1, 2
""",
        "clipped",
    ),
)
def clip_predictions(spark, sf):
    from shelfcast.operators.forecasting import naive_predictions
    from shelfcast.operators.series import series_features

    weekly = weekly_demand(canonical_sales(spark, sf, (*s.REQUIRED, s.TRUE_DEMAND_RAW)))
    shifted = series_features(weekly).withColumn("Rolling_Mean_4", F.col("Rolling_Mean_4") - 20)
    return naive_predictions(shifted).groupBy(*s.PAIR).agg(F.sum("prediction").alias("clipped"))


def _days(spark, sf):
    """Distinct days with sales."""
    return table(spark, sf, "lineitem").select(cal.day(F.col("l_shipdate")).alias("day")).distinct()


_DAYS = "(SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) AS days"


@query("D1_quarter", f"SELECT day, CAST(quarter(day) AS INTEGER) AS quarter FROM {_DAYS}")
def quarter(spark, sf):
    return _days(spark, sf).withColumn("quarter", F.quarter("day"))


@query(
    "D2_month_edges",
    f"""
SELECT day, CASE WHEN day(day) = 1 THEN 1 ELSE 0 END AS Is_Month_Start,
       CASE WHEN day = last_day(day) THEN 1 ELSE 0 END AS Is_Month_End FROM {_DAYS}
""",
)
def month_edges(spark, sf):
    date = F.col("day")
    return _days(spark, sf).select(
        "day", cal.is_month_start(date).alias("Is_Month_Start"), cal.is_month_end(date).alias("Is_Month_End")
    )


@query(
    "D3_near_month_edges",
    f"""
SELECT day, CASE WHEN day(day) <= 7 THEN 1 ELSE 0 END AS Is_Month_Start,
       CASE WHEN day(day) >= 25 THEN 1 ELSE 0 END AS Is_Month_End FROM {_DAYS}
""",
)
def near_month_edges(spark, sf):
    date = F.col("day")
    return _days(spark, sf).select(
        "day", cal.is_near_month_start(date).alias("Is_Month_Start"), cal.is_near_month_end(date).alias("Is_Month_End")
    )


@query(
    "D4_week_month_year",
    f"""
SELECT day, CAST(week(day) AS INTEGER) AS "Week", CAST(month(day) AS INTEGER) AS "Month",
       CAST(year(day) AS INTEGER) AS "Year" FROM {_DAYS}
""",
)
def week_month_year(spark, sf):
    parts = cal.week_parts(F.col("day"))
    return _days(spark, sf).select("day", *[parts[c].alias(c) for c in ("Week", "Month", "Year")])


@query(
    "D5_cycles",
    rounded(
        "",
        f"""
SELECT day, sin(2 * pi() * week(day) / 52.0::DOUBLE) AS "Week_Sin", cos(2 * pi() * week(day) / 52.0::DOUBLE) AS "Week_Cos",
       sin(2 * pi() * month(day) / 12.0::DOUBLE) AS "Month_Sin", cos(2 * pi() * month(day) / 12.0::DOUBLE) AS "Month_Cos"
FROM {_DAYS}
""",
        "Week_Sin Week_Cos Month_Sin Month_Cos",
    ),
)
def cycles(spark, sf):
    parts = cal.week_parts(F.col("day"))
    names = ("Week_Sin", "Week_Cos", "Month_Sin", "Month_Cos")
    return _days(spark, sf).select("day", *[parts[c].alias(c) for c in names])


@query(
    "D6_week_windows",
    f"""
SELECT day, CAST(weeks AS INTEGER) AS weeks, CAST(day + CAST(7 * weeks AS INTEGER) AS DATE) AS week_start,
       CAST(day + CAST(7 * weeks + 6 AS INTEGER) AS DATE) AS week_end
FROM {_DAYS} CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS weeks) AS w
""",
)
def week_windows(spark, sf):
    weeks = _days(spark, sf).withColumn("weeks", F.explode(F.sequence(F.lit(0), F.lit(4))))
    start = cal.weeks_after(F.col("day"), F.col("weeks"))
    return weeks.select("day", "weeks", start.alias("week_start"), F.date_add(start, 6).alias("week_end"))


@query("D7_years_before", f"SELECT day, CAST(day - INTERVAL 3 YEAR AS DATE) AS cutoff FROM {_DAYS}")
def years_before(spark, sf):
    return _days(spark, sf).withColumn("cutoff", cal.day(cal.years_before(F.col("day"), 3)))


@query(
    "D8_day_range",
    """
SELECT StoreName, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM (
  SELECT n_name AS StoreName, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) AS spans
""",
)
def day_range(spark, sf):
    sales = canonical_sales(spark, sf, (s.STORE, s.BILL_DATE))
    span = sales.groupBy(s.STORE).agg(F.min(s.BILL_DATE).alias("first"), F.max(s.BILL_DATE).alias("last"))
    return span.select(s.STORE, F.explode(F.sequence(cal.day(F.col("first")), cal.day(F.col("last")))).alias("day"))


@query(
    "D9_date_formats",
    f"""
SELECT day, strftime(day, '%Y-%m-%d') AS iso, strftime(day, '%d %b %Y') AS long_form, strftime(day, '%b %d') AS label
FROM {_DAYS}
""",
)
def date_formats(spark, sf):
    return _days(spark, sf).select(
        "day",
        F.date_format("day", "yyyy-MM-dd").alias("iso"),
        F.date_format("day", "dd MMM yyyy").alias("long_form"),
        F.date_format("day", "MMM dd").alias("label"),
    )


@query(
    "D10_days_between",
    """
SELECT o_orderpriority, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days, count(*) AS "rows"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
""",
)
def days_between(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    days = F.datediff(cal.day(F.col("l_shipdate")), cal.day(F.col("o_orderdate"))).cast("long")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy("o_orderpriority", days.alias("days")).agg(F.count("*").alias("rows"))


@query(
    "N1_abs_sqrt_max",
    """
SELECT p_brand, round(max(sqrt(abs(l_quantity - 25))), 6) AS root, max(abs(l_quantity - 25)) AS distance,
       sum(greatest(l_quantity - 25, 0)) AS clipped
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""",
)
def abs_sqrt_max(spark, sf):
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    off = F.col("l_quantity") - 25
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy("p_brand")
        .agg(
            F.max(F.sqrt(F.abs(off))).alias("root"),
            F.max(F.abs(off)).alias("distance"),
            F.sum(F.greatest(off, F.lit(0.0))).alias("clipped"),
        )
    )


@query(
    "N2_half_even",
    'SELECT l_quantity / 4 AS raw, round_even(l_quantity / 4, 0) AS whole, count(*) AS "rows" FROM lineitem GROUP BY 1, 2',
)
def half_even(spark, sf):
    raw = (F.col("l_quantity") / 4).alias("raw")
    counted = table(spark, sf, "lineitem").groupBy(raw).agg(F.count("*").alias("rows"))
    return counted.withColumn("whole", pricing.half_even(F.col("raw")))


@query(
    "N3_ratio_or_null",
    """
SELECT p_brand, count(l_quantity / nullif(l_linenumber - 1, 0)) AS ratios, count(*) AS "rows",
       round(sum(l_quantity / nullif(l_linenumber - 1, 0)), 6) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""",
)
def ratio_or_null(spark, sf):
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    ratio = F.try_divide(F.col("l_quantity"), F.col("l_linenumber") - 1)
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy("p_brand")
        .agg(F.count(ratio).alias("ratios"), F.count("*").alias("rows"), F.sum(ratio).alias("total"))
    )


@query(
    "T1_case_and_trim",
    """
SELECT c_mktsegment, trim(' ' || c_mktsegment || ' ') AS trimmed, lower(c_mktsegment) AS lower_case,
       upper(c_mktsegment) AS upper_case, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title_case,
       regexp_full_match(c_mktsegment, '[A-Za-z]+') AS letters_only, count(*) AS "rows"
FROM customer GROUP BY c_mktsegment
""",
)
def case_and_trim(spark, sf):
    name = F.col("c_mktsegment")
    counted = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("rows"))
    return counted.select(
        "c_mktsegment",
        text.strip(F.concat(F.lit(" "), name, F.lit(" "))).alias("trimmed"),
        F.lower(name).alias("lower_case"),
        F.upper(name).alias("upper_case"),
        F.initcap(name).alias("title_case"),
        name.rlike("^[A-Za-z]+$").alias("letters_only"),
        "rows",
    )


@query(
    "T2_regex",
    r"""
SELECT s_name, regexp_extract(s_name, '([+-]?\d+(?:\.\d+)?)', 1) AS digits, regexp_replace(s_name, '[^A-Za-z]', '', 'g') AS letters
FROM supplier
""",
)
def regex(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_name",
        F.regexp_extract("s_name", text.NUMBER, 1).alias("digits"),
        F.regexp_replace("s_name", "[^A-Za-z]", "").alias("letters"),
    )


@query(
    "T3_concat",
    "SELECT n_nationkey || '_' || n_regionkey || '_' || n_name AS joined FROM nation",
)
def concat(spark, sf):
    columns = ("n_nationkey", "n_regionkey", "n_name")
    return table(spark, sf, "nation").select(composite(*[F.col(c) for c in columns]).alias("joined"))
