"""Weekly and monthly demand."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import month_end, week_end
from shelfcast.functions.pricing import whole_units
from shelfcast.functions.text import clean_double
from shelfcast.operators.cleaning import LINES, sale_measures
from shelfcast.operators.densify import fill_gaps

SUMS = (s.QUANTITY, "True_Demand")
MEANS = (s.MRP, "DiscountPct", "Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct")


def observed_weeks(
    sales: DataFrame, keys: Sequence[str] = s.SERIES, means: Sequence[str] = MEANS
) -> DataFrame:
    """Sums and means per key and week, only for weeks with sales.

    All measures combine on the map side, so a key with a large share of the sales sends one row per
    week and task, not its sales rows.
    """
    measures = sale_measures(sales)
    raw = {c: clean_double(F.col(c)) for c in (s.QUANTITY, s.MRP, s.DISCOUNT_AMOUNT) if c in sales.columns}
    measures = {**raw, **measures}

    def mean(c: str) -> Column:
        return F.sum(measures[c]) / F.sum(LINES) if LINES in sales.columns else F.avg(measures[c])

    return (
        sales.dropna(subset=[*keys, s.BILL_DATE])
        .groupBy(*keys, week_end(F.col(s.BILL_DATE)).alias(s.WEEK_END))
        .agg(
            *[F.coalesce(F.sum(measures[c]), F.lit(0.0)).alias(c) for c in SUMS],
            *[mean(c).alias(c) for c in means],
        )
    )


def weekly_demand(
    sales: DataFrame,
    *,
    keys: Sequence[str] = s.SERIES,
    means: Sequence[str] = MEANS,
    whole: bool = True,
) -> DataFrame:
    """Gap-free weekly demand per key, from the key's first to its last week.

    Weeks without sales have zero sums and null means. The rows are shuffled once more by store and
    product before the gaps are filled, so that the series features need no further shuffle. As the rows
    multiply after that shuffle, its partitions are not merged by their small size before it.
    """
    observed = observed_weeks(sales, keys, means)
    cluster = [c for c in s.PAIR if c in keys]
    if cluster:
        partitions = int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        observed = observed.repartition(partitions, *cluster)
    ordered = [*cluster, *[c for c in keys if c not in cluster]]
    dense = fill_gaps(observed, ordered, s.WEEK_END, step="weeks", zero=SUMS)
    quantity = whole_units(F.col(s.QUANTITY)) if whole else F.col(s.QUANTITY)
    return dense.select(*keys, s.WEEK_END, quantity.alias(s.QUANTITY), "True_Demand", *means)


def selection_weekly(sales: DataFrame) -> DataFrame:
    """Weekly view of selected sales: raw quantity and also the mean discount amount."""
    means = (s.MRP, s.DISCOUNT_AMOUNT, "Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct")
    return weekly_demand(sales, means=means, whole=False)


def monthly_trend(sales: DataFrame, keys: Sequence[str] = s.PAIR) -> DataFrame:
    """Quantity per key and month end; months without sales between the first and the last are 0."""
    monthly = (
        sales.dropna(subset=[*keys, s.BILL_DATE])
        .groupBy(*keys, month_end(F.col(s.BILL_DATE)).alias("month_end"))
        .agg(F.coalesce(F.sum(clean_double(F.col(s.QUANTITY))), F.lit(0.0)).alias(s.QUANTITY))
    )
    return fill_gaps(monthly, list(keys), "month_end", step="months", zero=[s.QUANTITY])
