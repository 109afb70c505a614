"""A compact form of the sales history, from which forecasts and stock figures are computed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.text import clean_double
from shelfcast.operators.cleaning import LINES, sale_measures
from shelfcast.session import materialize

MEASURES = ("True_Demand", "Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct")


def compact_history(sales: DataFrame) -> DataFrame:
    """One row per series and bill time: sums of the measures and the number of bill lines.

    The only pass over the sales that a forecast needs; rows combine before the shuffle, so a series with
    very many lines on a day sends one row per task.
    """
    measures = sale_measures(sales)
    quantity = F.coalesce(clean_double(F.col(s.QUANTITY)), F.lit(0.0))
    return (
        sales.dropna(subset=[*s.PAIR, s.BILL_DATE])
        .groupBy(*s.SERIES, s.BILL_DATE)
        .agg(
            F.sum(quantity).alias(s.QUANTITY),
            *[F.sum(measures[c]).alias(c) for c in MEASURES],
            F.count("*").alias(LINES),
        )
    )


def as_history(sales: DataFrame) -> DataFrame:
    """The compact history, written once; a table that is compact already passes through."""
    return sales if LINES in sales.columns else materialize(compact_history(sales), "history")
