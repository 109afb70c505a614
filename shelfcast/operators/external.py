"""Joins of the optional side tables to the weekly panel."""

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import season_flags
from shelfcast.operators.holidays import add_holiday_features
from shelfcast.session import materialize

# Codes of the lifecycle stages.
LIFECYCLE_CODES = {"Introduction": 0, "Growth": 1, "Maturity": 2, "Decline": 3}

MONTHLY, WEEKLY = ("Year", "Month"), ("Year", "Week")
PERIOD = ("Year", "Month", "Week")


@dataclass(frozen=True)
class SideTable:
    """How a side table is brought to one set of values per period, and what fills periods it lacks."""

    keys: tuple[str, str]
    columns: tuple[str, ...]
    fill: str
    prepare: Callable[[DataFrame], DataFrame] | None = None


def _competitor(table: DataFrame) -> DataFrame:
    return table.groupBy(*WEEKLY).agg(
        F.avg("Promotion_Intensity").alias("Competitor_Promotion_Intensity"),
        F.avg("Price_Undercut_Percent").alias("Competitor_Price_Undercut"),
        F.max("New_Store_Opening").alias("Competitor_New_Store_Opening"),
    )


def _marketing(table: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("Ad_Spend_INR", "Impressions", "Clicks", "Conversions")]
    return table.groupBy(*WEEKLY).agg(*sums, F.avg("Campaign_Intensity").alias("Campaign_Intensity"))


LEVELS = ("Lead_Time_Days", "On_Time_Delivery_Rate", "Quality_Score", "Supplier_Reliability_Index")


def _supply_chain(table: DataFrame) -> DataFrame:
    """Per week, the mean over products of each product's weekly figures."""
    by_product = table.where(F.col("Product_ID").isNotNull()).groupBy(*WEEKLY, "Product_ID").agg(
        *[F.avg(c).alias(c) for c in LEVELS],
        F.coalesce(F.sum("Stockout_Events"), F.lit(0)).alias("Stockout_Events"),
    )
    return by_product.groupBy(*WEEKLY).agg(*[F.avg(c).alias(c) for c in (*LEVELS, "Stockout_Events")])


SIDE_TABLES: dict[str, SideTable] = {
    "economic": SideTable(
        MONTHLY,
        (
            "GDP_Growth_Rate",
            "Consumer_Confidence_Index",
            "Inflation_Rate",
            "Unemployment_Rate",
            "Interest_Rate",
        ),
        "mean",
    ),
    "weather": SideTable(
        MONTHLY, ("Avg_Temperature_C", "Total_Rainfall_mm", "Humidity_Percent", "Weather_Index"), "mean"
    ),
    "competitor": SideTable(
        WEEKLY,
        ("Competitor_Promotion_Intensity", "Competitor_Price_Undercut", "Competitor_New_Store_Opening"),
        "zero",
        _competitor,
    ),
    "marketing": SideTable(
        WEEKLY,
        ("Ad_Spend_INR", "Impressions", "Clicks", "Conversions", "Campaign_Intensity"),
        "zero",
        _marketing,
    ),
    "supply_chain": SideTable(WEEKLY, (*LEVELS, "Stockout_Events"), "mean", _supply_chain),
    "bank_offers": SideTable(WEEKLY, ("Bank_Offer_Intensity", "Card_Promotion_Level"), "zero"),
    "custom_discounts": SideTable(WEEKLY, ("Store_Discount_Level", "Loyalty_Discount_Available"), "zero"),
    "custom_promotions": SideTable(WEEKLY, ("Promotion_Type_Code", "Promotion_Discount_Pct"), "zero"),
}


def _resolve_duplicates(table: DataFrame, keys: Sequence[str], on_duplicate: str) -> DataFrame:
    """Duplicate keys multiply panel rows; keep them, average them or fail."""
    if on_duplicate == "keep":
        return table
    values = [c for c in table.columns if c not in keys]
    if on_duplicate == "mean":
        return table.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values])
    if on_duplicate == "error":
        if not table.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"duplicate keys {tuple(keys)} in side table")
        return table
    raise ValueError("on_duplicate must be keep, mean or error")


def fill_zero(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    return panel.fillna(0, subset=list(columns))


def fill_mean(panel: DataFrame, columns: Sequence[str], *, weight: str | None = None) -> DataFrame:
    """Replace nulls by the column's mean over all rows; a row may stand for ``weight`` rows.

    The means are one aggregate with partial results per task; only one row moves on.
    """

    def mean(c: str) -> Column:
        if weight is None:
            return F.avg(c)
        known = F.when(F.col(c).isNotNull(), F.col(weight))
        return F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(known))

    means = panel.agg(F.struct(*[mean(c).alias(c) for c in columns]).alias("means")).scalar()
    return (
        panel.withColumn("_means", means)
        .withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_means")[c]) for c in columns})
        .drop("_means")
    )


def add_side_tables(
    panel: DataFrame, tables: Mapping[str, DataFrame], *, on_duplicate: str = "keep"
) -> DataFrame:
    """Join the side tables on (Year, Month) or (Year, Week) and fill the periods they lack.

    All of them depend on the calendar only. So the panel is reduced to its distinct periods with their
    row counts, the tables are joined and filled there, with means weighted by those counts, and the panel meets the
    result in one join. The periods are a few hundred per year, written so that their size decides the join.
    """
    periods = materialize(panel.groupBy(*PERIOD).agg(F.count("*").alias("_rows")), "periods")
    for name, table in tables.items():
        side = SIDE_TABLES[name]
        if side.prepare is None:
            values = _resolve_duplicates(table.select(*side.keys, *side.columns), side.keys, on_duplicate)
        else:
            values = side.prepare(table)
        joined = periods.join(values, list(side.keys), "left")
        if side.fill == "zero":
            periods = fill_zero(joined, side.columns)
        else:  # read twice: for the means and for the rows
            periods = fill_mean(materialize(joined, "periods"), side.columns, weight="_rows")
    added = [c for name in tables for c in SIDE_TABLES[name].columns]
    enriched = materialize(periods.select(*PERIOD, *added), "periods")
    return panel.join(enriched, list(PERIOD), "left").select(*panel.columns, *added)


def add_seasons(panel: DataFrame) -> DataFrame:
    return panel.withColumns(season_flags(F.col("Month")))


def usable_side_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The side tables whose columns are complete; others are left out, so one bad table stops nothing."""
    wanted = {
        name: [part.split()[0] for part in ddl.split(", ")] for name, ddl in s.SIDE_TABLES.items() if name in tables
    }
    return {name: tables[name] for name, cols in wanted.items() if set(cols) <= set(tables[name].columns)}


def add_external_features(
    panel: DataFrame,
    holidays: DataFrame | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    *,
    enabled: Mapping[str, bool] | None = None,
    date_col: str = s.WEEK_END,
    region_column: str = s.REGION,
    reference_case: bool = False,
    years: DataFrame | None = None,
) -> DataFrame:
    """Holiday and season columns plus every side table that is present and enabled.

    ``enabled`` switches blocks off by name (``holidays``, ``seasonal`` or a side table). The panel needs
    ``Year``, ``Month`` and ``Week``.
    """
    on = {name: True for name in ("holidays", "seasonal", *SIDE_TABLES)} | dict(enabled or {})
    wanted = {name: table for name, table in usable_side_tables(tables or {}).items() if on[name]}
    enriched = add_side_tables(panel, wanted) if wanted else panel
    if on["seasonal"]:
        enriched = add_seasons(enriched)
    if on["holidays"] and holidays is not None and region_column in panel.columns:
        if years is None:
            years = panel.select(F.year(date_col).alias("Year")).distinct()
        enriched = add_holiday_features(
            enriched,
            holidays,
            date_col=date_col,
            region_column=region_column,
            years=years,
            reference_case=reference_case,
        )
    return enriched


def lifecycle_code(stage: Column) -> Column:
    pairs = [F.lit(v) for kv in LIFECYCLE_CODES.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), stage)


def add_product_attributes(panel: DataFrame, products: DataFrame) -> DataFrame:
    """Join user-supplied product attributes and code the lifecycle stage."""
    joined = panel.join(products, s.PRODUCT, "left")
    if "Product_Lifecycle_Stage" in products.columns:
        joined = joined.withColumn("Lifecycle_Code", lifecycle_code(F.col("Product_Lifecycle_Stage")))
    return joined


def add_store_attributes(panel: DataFrame, stores: DataFrame) -> DataFrame:
    return panel.join(stores, s.STORE, "left")
