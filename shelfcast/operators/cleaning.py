"""Row-level cleaning of sales."""

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schema as s
from shelfcast.functions import pricing, text
from shelfcast.functions.calendar import years_before


# Column of a compact history: how many bill lines a row stands for.
LINES = "lines"


def parse_bill_date(sales: DataFrame) -> DataFrame:
    """Turn ISO texts into timestamps and drop the rows whose date cannot be read."""
    return with_parsed_date(sales).dropna(subset=[s.BILL_DATE])


def with_parsed_date(sales: DataFrame) -> DataFrame:
    """As ``parse_bill_date``, but unreadable dates stay as nulls."""
    if isinstance(sales.schema[s.BILL_DATE].dataType, T.StringType):
        return sales.withColumn(s.BILL_DATE, text.strip(F.col(s.BILL_DATE)).try_cast("timestamp_ntz"))
    return sales.withColumn(s.BILL_DATE, F.col(s.BILL_DATE).cast("timestamp_ntz"))


def require_rows(sales: DataFrame) -> DataFrame:
    if sales.isEmpty():
        raise ValueError("no sale has a readable bill date")
    return sales


def _optional(sales: DataFrame, name: str, parse) -> Column:
    """The parsed optional column, 0 if the table does not have it."""
    if name not in sales.columns:
        return F.lit(0.0)
    if isinstance(sales.schema[name].dataType, T.StringType) or parse is text.offer_flag:
        return parse(F.col(name))
    return F.coalesce(text.clean_double(F.col(name)), F.lit(0.0))


def sale_measures(sales: DataFrame) -> dict[str, Column]:
    """Numeric measures of one bill line; their sums, if the table is a compact history."""
    if LINES in sales.columns:
        return {c: F.col(c) for c in ("True_Demand", "Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct")}
    measures = {
        "True_Demand": _optional(sales, s.TRUE_DEMAND_RAW, text.number_or_zero),
        "Bank_Emi_Flag": _optional(sales, s.EMI_RAW, text.offer_flag),
        "Bank_Cashback_Pct": _optional(sales, s.CASHBACK_RAW, text.first_number),
        "Additional_Funded_Scheme_Pct": _optional(sales, s.SCHEME_RAW, text.first_number),
    }
    if s.DISCOUNT_AMOUNT in sales.columns and s.MRP in sales.columns:
        measures["DiscountPct"] = pricing.discount_pct(
            text.clean_double(F.col(s.DISCOUNT_AMOUNT)),
            text.clean_double(F.col(s.QUANTITY)),
            text.clean_double(F.col(s.MRP)),
        )
    return measures


def add_sale_measures(sales: DataFrame) -> DataFrame:
    return sales.withColumns(sale_measures(sales))


def select_series(
    sales: DataFrame, *, region: str | None = None, store: str | None = None, product: str | None = None
) -> DataFrame:
    """Keep one region, store and/or product; the equalities reach the scan."""
    for name, wanted in ((s.REGION, region), (s.STORE, store), (s.PRODUCT, product)):
        if wanted is not None:
            sales = sales.where(F.col(name) == F.lit(wanted))
    return sales


def up_to(sales: DataFrame, cutoff: datetime.date | datetime.datetime | str | None) -> DataFrame:
    """Rows billed at or before the cutoff; a plain date means its midnight."""
    if cutoff is None:
        return sales
    return sales.where(F.col(s.BILL_DATE) <= F.lit(str(cutoff)).cast("timestamp_ntz"))


def retraining_window(sales: DataFrame, *, strategy: str = "full", years: int = 3) -> DataFrame:
    """All rows, or with ``rolling`` those of the last calendar years before the newest bill."""
    if strategy == "full":
        return sales
    if strategy != "rolling":
        raise ValueError(f"unknown strategy: {strategy}")
    newest = sales.agg(F.max(s.BILL_DATE).alias("newest"))
    cutoff = newest.select(years_before(F.col("newest"), years)).scalar()
    return sales.where(F.col(s.BILL_DATE) >= cutoff)


def dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
