"""The sales tables, derived from the star-schema test tables.

Foreign keys of the test tables are complete, so a table is joined only when one of the wanted
columns needs it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import iso_week, week_end

# Given, so that opening a table starts no job.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}
# Region names of the test tables as the sales data would spell them.
REGION_NAMES = {
    "AFRICA": "Karnataka",
    "AMERICA": "Tamil Nadu",
    "ASIA": "mh",
    "EUROPE": "Delhi",
    "MIDDLE EAST": "Atlantis",
}
PRIORITY_OFFERS = {"1-URGENT": "HDFC Bank", "2-HIGH": "ICICI", "3-MEDIUM": " No ", "4-NOT SPECIFIED": "N/A"}
LIFECYCLES = {
    "ECONOMY": "Introduction",
    "PROMO": "Growth",
    "STANDARD": "Maturity",
    "MEDIUM": "Maturity",
}
# Yearly holidays of the test calendar (state code, month, day, name).
HOLIDAYS = (
    (None, 1, 26, "Republic Day"),
    (None, 8, 15, "Independence Day"),
    (None, 10, 2, "Gandhi Jayanti"),
    (None, 12, 25, "Christmas"),
    ("KA", 11, 1, "Rajyotsava"),
    ("TN", 1, 15, "Pongal"),
    ("MH", 5, 1, "Maharashtra Day"),
    ("DL", 2, 12, "Delhi Day"),
)
# First month or day of the active and the uploaded sales.
ACTIVE_BEFORE = "2000-01-01"
UPLOAD_FROM = "1999-07-01"
REPEATED_MONTH = ("1999-12-01", "2000-01-01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(c: Column, pairs: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(None).cast("string") if default is None else F.lit(default)
    for key, value in reversed(pairs.items()):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


_EXPRESSIONS = {
    s.REGION: lambda: _case(F.col("r_name"), REGION_NAMES),
    s.STORE: lambda: F.col("n_name"),
    s.PRODUCT: lambda: F.col("p_brand"),
    s.BILL_DATE: lambda: F.col("l_shipdate"),
    s.QUANTITY: lambda: F.col("l_quantity"),
    s.MRP: lambda: F.try_divide("l_extendedprice", "l_quantity"),
    s.DISCOUNT_AMOUNT: lambda: F.col("l_extendedprice") * (F.col("l_discount") + F.lit(0.0)) * F.lit(4.0),
    s.TRUE_DEMAND_RAW: lambda: F.col("l_quantity") + F.col("l_linenumber"),
    s.EMI_RAW: lambda: _case(F.col("o_orderpriority"), PRIORITY_OFFERS),
    s.CASHBACK_RAW: lambda: F.when(F.col("l_returnflag") == "R", F.lit("no offer")).otherwise(
        F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("% HDFC"))
    ),
    s.SCHEME_RAW: lambda: F.when(
        F.col("l_linenumber") != 1, F.concat(F.lit("Scheme "), F.col("l_linenumber").cast("string"), F.lit(".5 pct"))
    ),
}


def canonical_sales(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = (*s.REQUIRED, *s.OPTIONAL)
) -> DataFrame:
    """One row per bill line with the wanted sales columns."""
    wanted = set(columns)
    lines = table(spark, sf_dir, "lineitem")
    if s.PRODUCT in wanted:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        lines = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    if wanted & {s.STORE, s.REGION}:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nation = table(spark, sf_dir, "nation")
        lines = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"])
        lines = lines.join(nation, lines["s_nationkey"] == nation["n_nationkey"])
    if s.REGION in wanted:
        region = table(spark, sf_dir, "region")
        lines = lines.join(region, lines["n_regionkey"] == region["r_regionkey"])
    if s.EMI_RAW in wanted:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        lines = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return lines.select(*[_EXPRESSIONS[c]().alias(c) for c in columns])


def active_sales(spark: SparkSession, sf_dir: str, columns: Sequence[str] = s.REQUIRED) -> DataFrame:
    sales = canonical_sales(spark, sf_dir, columns)
    return sales.where(F.col(s.BILL_DATE) < F.lit(ACTIVE_BEFORE).cast("timestamp_ntz"))


def uploaded_sales(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = (*s.REQUIRED, *s.OPTIONAL)
) -> DataFrame:
    """Newer sales with one month present twice."""
    date = F.col(s.BILL_DATE)
    sales = canonical_sales(spark, sf_dir, columns)
    upload = sales.where(date >= F.lit(UPLOAD_FROM).cast("timestamp_ntz"))
    start, stop = (F.lit(d).cast("timestamp_ntz") for d in REPEATED_MONTH)
    copies = F.when((date >= start) & (date < stop), F.array_repeat(F.lit(1), 2)).otherwise(F.array(F.lit(1)))
    return upload.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def holiday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly holidays in every year in which goods were shipped."""
    days = F.array(
        *[
            F.struct(
                F.lit(code).cast("string").alias("state_code"),
                F.lit(month).alias("month"),
                F.lit(day).alias("day"),
                F.lit(name).alias("holiday_name"),
            )
            for code, month, day, name in HOLIDAYS
        ]
    )
    years = table(spark, sf_dir, "lineitem").select(F.year(week_end(F.col("l_shipdate"))).alias("year")).distinct()
    return years.select("year", F.inline(days)).select(
        "state_code", F.make_date("year", "month", "day").alias("holiday_date"), "holiday_name"
    )


MONTHLY_FIGURES = {
    "economic": {
        "GDP_Growth_Rate": ("mean_price", 100000),
        "Consumer_Confidence_Index": ("n", 1),
        "Inflation_Rate": ("max_price", 100000),
        "Unemployment_Rate": ("min_price", 1000),
        "Interest_Rate": ("mean_price", 50000),
    },
    "weather": {
        "Avg_Temperature_C": ("mean_price", 10000),
        "Total_Rainfall_mm": ("n", 1),
        "Humidity_Percent": ("max_price", 10000),
        "Weather_Index": ("min_price", 100),
    },
}
DAILY_FIGURES = {
    "competitor": {
        "Promotion_Intensity": "cast(floor(o_totalprice / 1000) as double)",
        "Price_Undercut_Percent": "cast(o_orderkey % 50 as double)",
        "New_Store_Opening": "cast(o_orderkey % 97 = 0 as int)",
    },
    "marketing": {
        "Ad_Spend_INR": "cast(floor(o_totalprice) as double)",
        "Impressions": "o_orderkey % 1000",
        "Clicks": "o_orderkey % 100",
        "Conversions": "o_orderkey % 10",
        "Campaign_Intensity": "cast(floor(o_totalprice / 5000) as double)",
    },
}
WEEKLY_FIGURES = {
    "bank_offers": {
        "Bank_Offer_Intensity": "mean_price / 1000",
        "Card_Promotion_Level": "cast(n % 5 as double)",
    },
    "custom_discounts": {
        "Store_Discount_Level": "mean_price / 2000",
        "Loyalty_Discount_Available": "cast(n % 2 as int)",
    },
    "custom_promotions": {
        "Promotion_Type_Code": "cast(n % 4 as int)",
        "Promotion_Discount_Pct": "cast(n % 30 as double)",
    },
}


def side_table(spark: SparkSession, sf_dir: str, name: str, orders: DataFrame | None = None) -> DataFrame:
    """One of the optional tables, derived from orders or order lines."""
    if name == "supply_chain":
        return _supply_chain(spark, sf_dir)
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    dated = orders.withColumn("Date", F.col("o_orderdate").cast("date"))
    # Sums of whole cents do not depend on their order.
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double")
    mean_price = (cents / F.count("*") / 100).alias("mean_price")
    if name in DAILY_FIGURES:
        return dated.select(
            "Date",
            F.year("Date").alias("Year"),
            iso_week(F.col("Date")).alias("Week"),
            *[F.expr(v).alias(c) for c, v in DAILY_FIGURES[name].items()],
        )
    if name in MONTHLY_FIGURES:
        monthly = dated.groupBy(F.year("Date").alias("Year"), F.month("Date").alias("Month")).agg(
            mean_price,
            F.max("o_totalprice").alias("max_price"),
            F.min("o_totalprice").alias("min_price"),
            F.count("*").cast("double").alias("n"),
        )
        return monthly.where("(Year * 12 + Month) % 7 != 0").select(
            F.make_date("Year", "Month", F.lit(1)).alias("Date"),
            "Year",
            "Month",
            *[(F.col(source) / scale).alias(c) for c, (source, scale) in MONTHLY_FIGURES[name].items()],
        )
    weekly = dated.groupBy(F.year("Date").alias("Year"), iso_week(F.col("Date")).alias("Week")).agg(
        F.min("Date").alias("Date"), mean_price, F.count("*").alias("n")
    )
    return weekly.where("Week % 2 = 1").select(
        "Date", "Year", "Week", *[F.expr(v).alias(c) for c, v in WEEKLY_FIGURES[name].items()]
    )


def _supply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        F.col("day").alias("Date"),
        F.year("day").alias("Year"),
        iso_week(F.col("day")).alias("Week"),
        F.col("p_brand").alias("Product_ID"),
        (F.col("l_linenumber") * 3.0).alias("Lead_Time_Days"),
        (F.lit(100.0) - F.round(F.col("l_discount") * 100)).alias("On_Time_Delivery_Rate"),
        F.col("l_quantity").alias("Quality_Score"),
        (F.round(F.col("l_tax") * 100) + F.lit(0.0)).alias("Supplier_Reliability_Index"),
        (F.col("l_returnflag") == "R").cast("long").alias("Stockout_Events"),
    )


def side_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return {name: side_table(spark, sf_dir, name, orders) for name in s.SIDE_TABLES}


def product_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle stage per product: the most common part type of the brand, ties by name."""
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return counted.groupBy("p_brand").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("p_type").alias("p_type"))).alias("top")
    ).select(
        F.col("p_brand").alias(s.PRODUCT),
        _case(F.col("top.p_type"), LIFECYCLES, "Decline").alias("Product_Lifecycle_Stage"),
    )


def store_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and rating per store from the suppliers of the nation."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    return (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .groupBy(F.col("n_name").alias(s.STORE))
        .agg(
            F.when(F.count("*") >= 5, F.lit("Large"))
            .when(F.count("*") >= 3, F.lit("Medium"))
            .otherwise(F.lit("Small"))
            .alias("Store_Size_Category"),
            (F.avg("s_acctbal") / 10000).alias("Store_Performance_Rating"),
        )
    )
