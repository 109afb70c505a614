"""Column names, table schemas and the model's feature list."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REGION = "RegionName"
STORE = "StoreName"
PRODUCT = "ProductName"
BILL_DATE = "BillDate"
QUANTITY = "Quantity"
MRP = "MRP"
DISCOUNT_AMOUNT = "ProductLevelDiscAmount"

SERIES = (REGION, STORE, PRODUCT)
PAIR = (STORE, PRODUCT)

# Column names of the input data.
REQUIRED = (REGION, STORE, PRODUCT, BILL_DATE, QUANTITY, MRP, DISCOUNT_AMOUNT)
TRUE_DEMAND_RAW = "True Demand"
EMI_RAW = "Bank Funded NoCost EMI Applied With BankName"
CASHBACK_RAW = "Bank Funded Cashback Coverted To Percentage With BankName"
SCHEME_RAW = "Additional Apple Or Distributor Funded Scheme In Percentage"
OPTIONAL = (TRUE_DEMAND_RAW, EMI_RAW, CASHBACK_RAW, SCHEME_RAW)

WEEK_END = "week_end"

SALES_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in SERIES]
    + [T.StructField(BILL_DATE, T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in (QUANTITY, MRP, DISCOUNT_AMOUNT, TRUE_DEMAND_RAW)]
    + [T.StructField(c, T.StringType()) for c in (EMI_RAW, CASHBACK_RAW, SCHEME_RAW)]
)

HOLIDAY_SCHEMA = "state_code string, holiday_date date, holiday_name string"

SIDE_TABLES = {
    "economic": (
        "Date date, Year int, Month int, GDP_Growth_Rate double, Consumer_Confidence_Index double, "
        "Inflation_Rate double, Unemployment_Rate double, Interest_Rate double"
    ),
    "weather": (
        "Date date, Year int, Month int, Avg_Temperature_C double, Total_Rainfall_mm double, "
        "Humidity_Percent double, Weather_Index double"
    ),
    "competitor": (
        "Date date, Year int, Week int, Promotion_Intensity double, "
        "Price_Undercut_Percent double, New_Store_Opening int"
    ),
    "marketing": (
        "Date date, Year int, Week int, Ad_Spend_INR double, Impressions long, Clicks long, "
        "Conversions long, Campaign_Intensity double"
    ),
    "supply_chain": (
        "Date date, Year int, Week int, Product_ID string, Lead_Time_Days double, "
        "On_Time_Delivery_Rate double, Quality_Score double, Supplier_Reliability_Index double, "
        "Stockout_Events long"
    ),
    "bank_offers": "Date date, Year int, Week int, Bank_Offer_Intensity double, Card_Promotion_Level double",
    "custom_discounts": (
        "Date date, Year int, Week int, Store_Discount_Level double, Loyalty_Discount_Available int"
    ),
    "custom_promotions": (
        "Date date, Year int, Week int, Promotion_Type_Code int, Promotion_Discount_Pct double"
    ),
}

LAGS = (1, 2, 3, 4, 8, 12)
WINDOWS = (2, 4, 8, 12)

# The model's input columns, in the order the model expects them.
FEATURES = (
    ["RegionID", "StoreID", "ProductID", "Product_Store_ID", "Month_Product_ID"]
    + ["Week", "Month", "Year", "Quarter", "Is_Month_Start", "Is_Month_End"]
    + ["Week_Sin", "Week_Cos", "Month_Sin", "Month_Cos"]
    + [f"Lag_{k}_Week" for k in LAGS]
    + [f"Rolling_Mean_{n}" for n in WINDOWS]
    + [f"Rolling_Std_{n}" for n in WINDOWS]
    + ["EWMA_4", "MoM_Change", "Trend_4Week", "Quantity_ZScore"]
    + ["True_Demand", "TrueDemand_Ratio", "Bank_Emi_Flag", "Bank_Cashback_Pct"]
    + ["Bank_Cashback_Intensity", "Additional_Funded_Scheme_Pct", "Additional_Funded_Scheme_Intensity"]
    + ["Is_Holiday", "Is_Holiday_Week", "Holiday_Count"]
    + ["Days_to_Next_Holiday", "Days_since_Last_Holiday"]
    + ["DiscountPct", "Discount_Intensity", "Effective_Price"]
)


def missing_columns(df: DataFrame) -> list[str]:
    """Required sales columns that the table does not have."""
    return [c for c in REQUIRED if c not in df.columns]


def require_columns(df: DataFrame) -> DataFrame:
    """Pass the table through, or fail before any job starts."""
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"sales lack the columns {', '.join(missing)}")
    return df
