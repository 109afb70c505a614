"""From sales to the feature panel."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions import calendar as cal
from shelfcast.functions import pricing
from shelfcast.operators.encoding import Encoders, encode, fit_encoders
from shelfcast.operators.external import add_external_features
from shelfcast.operators.series import series_features
from shelfcast.operators.weekly import weekly_demand
from shelfcast.session import materialize

GAP_COLUMNS = ("DiscountPct", "Effective_Price", "Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct")
# What is known of a week only when it is over.
SAME_WEEK = (
    *GAP_COLUMNS,
    "Discount_Intensity",
    "True_Demand",
    "TrueDemand_Ratio",
    "Bank_Cashback_Intensity",
    "Additional_Funded_Scheme_Intensity",
)


def add_price_features(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {
            "Discount_Intensity": pricing.discount_band(F.col("DiscountPct")),
            "Effective_Price": pricing.effective_price(F.col(s.MRP), F.col("DiscountPct")),
            "TrueDemand_Ratio": pricing.demand_ratio(F.col("True_Demand"), F.col(s.QUANTITY)),
            "Bank_Cashback_Intensity": pricing.offer_band(F.col("Bank_Cashback_Pct")),
            "Additional_Funded_Scheme_Intensity": pricing.offer_band(F.col("Additional_Funded_Scheme_Pct")),
        }
    )


def add_calendar_features(panel: DataFrame, date_col: str = s.WEEK_END) -> DataFrame:
    date = F.col(date_col)
    return panel.withColumns(
        cal.week_parts(date)
        | {"Is_Month_Start": cal.is_month_start(date), "Is_Month_End": cal.is_month_end(date)}
    )


def carry_over_gaps(panel: DataFrame, columns=GAP_COLUMNS) -> DataFrame:
    """Give weeks without sales the last known value of their series, 0 if there is none."""
    earlier = (
        Window.partitionBy(s.PRODUCT, s.STORE, s.REGION)
        .orderBy(s.WEEK_END)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return panel.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(earlier), F.lit(0.0)) for c in columns}
    )


def of_previous_week(panel: DataFrame, columns=SAME_WEEK) -> DataFrame:
    """Give every week the values of the week before it in its series; the first week gets nulls or, outside the gap
    columns, zeros. The parts of the series features serve this window too."""
    series = Window.partitionBy(s.PRODUCT, s.STORE, s.REGION).orderBy(s.WEEK_END)
    lagged = {c: F.lag(c).over(series) for c in columns}
    return panel.withColumns({c: v if c in GAP_COLUMNS else F.coalesce(v, F.lit(0)) for c, v in lagged.items()})


def feature_panel(sales: DataFrame, *, shift: int = 0, on_zero: str = "inf") -> DataFrame:
    """Weekly demand with series, price and calendar features: two shuffles of aggregated rows.

    With ``shift=1`` no feature of a week depends on that week's sales.
    """
    panel = add_price_features(series_features(weekly_demand(sales), shift=shift, on_zero=on_zero))
    return add_calendar_features(of_previous_week(panel) if shift else panel)


def training_frame(
    sales: DataFrame,
    holidays: DataFrame | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    *,
    shift: int = 0,
    reference_case: bool = False,
) -> tuple[DataFrame, Encoders]:
    """The complete, finite feature table and the label codes.

    The panel is written once: the holiday years, the label codes and the joins all read that table.
    """
    panel = carry_over_gaps(feature_panel(sales, shift=shift, on_zero="zero"))
    panel = materialize(panel, "panel")
    encoders = fit_encoders(panel)
    enriched = add_external_features(panel, holidays, tables, reference_case=reference_case)
    return encode(enriched, encoders), encoders
