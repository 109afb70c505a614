"""Future feature rows and forecast reports."""

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions import calendar as cal
from shelfcast.functions.pricing import demand_ratio, discount_band, offer_band
from shelfcast.operators.encoding import Encoders, composite, encode_base
from shelfcast.operators.external import add_external_features

# Assumptions about future weeks.
FUTURE_DISCOUNT = 0.05
FUTURE_PRICE = 100.0
STD_SHARE = 0.15
BULK_WEEKS, MONTH_WEEKS = 9, 4


def week_starts(start: datetime.date, weeks: int) -> list[datetime.date]:
    return [start + datetime.timedelta(weeks=i) for i in range(weeks)]


def future_frame(anchored: DataFrame, *, start: datetime.date, weeks: int, prices: DataFrame | None = None) -> DataFrame:
    """One row per series and future week, with every feature but holidays and codes.

    ``anchored`` holds (region, store, product) and the last known metrics. Lags repeat the last week,
    rolling means the four-week mean. Discount and price are fixed unless ``prices`` gives a
    ``last_discount`` and a ``last_price`` per (store, product).
    """
    if prices is not None:
        anchored = anchored.join(prices, list(s.PAIR), "left")
    last_q, mean_q, demand = F.col("last_week_qty"), F.col("rolling_4_avg"), F.col("last_true_demand")
    discount = F.coalesce("last_discount", F.lit(FUTURE_DISCOUNT)) if prices is not None else F.lit(FUTURE_DISCOUNT)
    price = F.coalesce("last_price", F.lit(FUTURE_PRICE)) if prices is not None else F.lit(FUTURE_PRICE)
    weekly = anchored.withColumn("week_index", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1)))).withColumn(
        "week_start", cal.weeks_after(F.lit(start), F.col("week_index"))
    )
    date = F.col("week_start")
    return weekly.select(
        *s.SERIES,
        "week_index",
        "week_start",
        "last_week_qty",
        *[c.alias(n) for n, c in cal.week_parts(date).items()],
        cal.is_near_month_start(date).alias("Is_Month_Start"),
        cal.is_near_month_end(date).alias("Is_Month_End"),
        *[last_q.alias(f"Lag_{k}_Week") for k in s.LAGS],
        *[mean_q.alias(f"Rolling_Mean_{n}") for n in s.WINDOWS],
        *[(mean_q * F.lit(STD_SHARE)).alias(f"Rolling_Std_{n}") for n in s.WINDOWS],
        mean_q.alias("EWMA_4"),
        *[F.lit(0.0).alias(c) for c in ("MoM_Change", "Trend_4Week", "Quantity_ZScore")],
        demand.alias("True_Demand"),
        demand_ratio(demand, last_q).alias("TrueDemand_Ratio"),
        F.col("last_emi_ratio").alias("Bank_Emi_Flag"),
        F.col("last_cashback_pct").alias("Bank_Cashback_Pct"),
        offer_band(F.col("last_cashback_pct")).alias("Bank_Cashback_Intensity"),
        F.col("last_additional_pct").alias("Additional_Funded_Scheme_Pct"),
        offer_band(F.col("last_additional_pct")).alias("Additional_Funded_Scheme_Intensity"),
        discount.alias("DiscountPct"),
        discount_band(discount).alias("Discount_Intensity"),
        price.alias("Effective_Price"),
    )


def add_future_holidays(frame: DataFrame, holidays: DataFrame, *, start: datetime.date, weeks: int) -> DataFrame:
    """Holiday columns; only holidays in the years of the future weeks count."""
    years = sorted({d.year for d in week_starts(start, weeks)})
    listed = frame.sparkSession.range(1).select(F.explode(F.array(*[F.lit(y) for y in years])).alias("Year"))
    return add_external_features(frame, holidays, date_col="week_start", years=listed)


def _month_codes(enc: Encoders, months: Sequence[int]) -> DataFrame:
    """Per product, the codes of its (month, product) labels; none unless all the months were seen in training."""
    wanted = enc.product.withColumn("Month", F.explode(F.array(*[F.lit(m) for m in months]))).withColumn(
        "Month_Product", composite(F.col("Month"), F.col("ProductID"))
    )
    found = wanted.join(enc.month_product, "Month_Product", "left")
    codes = F.map_from_entries(F.collect_list(F.struct("Month", "Month_Product_ID")))
    return found.groupBy(s.PRODUCT).agg(
        F.when(F.count("Month_Product_ID") == len(months), codes).alias("_month_codes")
    )


def encode_future(frame: DataFrame, enc: Encoders, *, start: datetime.date, weeks: int) -> DataFrame:
    """Add the five codes and ``Status``.

    A series whose region, store or product was not seen in training fails. An unseen (product, store) has
    code 0, and a product has code 0 in all weeks if one of its (month, product) labels is unseen.
    """
    coded = encode_base(frame, enc)
    if enc.product_store is None:
        coded = coded.withColumn("Product_Store_ID", F.lit(0).cast("long"))
    else:
        pair = composite(F.col("ProductID"), F.col("StoreID"))
        coded = coded.withColumn("Product_Store_Combo", pair).join(enc.product_store, "Product_Store_Combo", "left")
    if enc.month_product is None:
        coded = coded.withColumn("Month_Product_ID", F.lit(0).cast("long"))
    else:
        months = sorted({d.month for d in week_starts(start, weeks)})
        coded = coded.join(_month_codes(enc, months), s.PRODUCT, "left").withColumn(
            "Month_Product_ID", F.try_element_at("_month_codes", F.col("Month"))
        )
    unseen = F.array_compact(
        F.array(
            *[
                F.when(F.col(code).isNull(), F.col(label))
                for label, code in zip(s.SERIES, ("RegionID", "StoreID", "ProductID"))
            ]
        )
    )
    return coded.withColumns(
        {
            "Product_Store_ID": F.coalesce("Product_Store_ID", F.lit(0)),
            "Month_Product_ID": F.coalesce("Month_Product_ID", F.lit(0)),
            "Status": F.when(
                F.size(unseen) > 0, F.concat(F.lit("Failed: unseen label "), F.array_join(unseen, ", "))
            ),
        }
    )


def align(frame: DataFrame, features: Sequence[str] = s.FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in its order; absent columns are 0."""
    have = set(frame.columns)
    return frame.select(*keep, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in features])


def naive_predictions(frame: DataFrame) -> DataFrame:
    """The four-week mean as the forecast of every week."""
    return frame.withColumn("prediction", F.greatest(F.col("Rolling_Mean_4"), F.lit(0.0)))


def model_predictions(frame: DataFrame, model, *, features: Sequence[str] = s.FEATURES) -> DataFrame:
    """Predict all series and weeks at once; negative predictions become 0, failed series have none."""
    keep = (*s.SERIES, "week_index", "week_start", "last_week_qty", "Status")
    ready = align(frame, features, keep).fillna(0, subset=[c for c in features])
    scored = model.transform(ready).select(*keep, "prediction")
    return scored.withColumn(
        "prediction", F.when(F.col("Status").isNull(), F.greatest(F.col("prediction"), F.lit(0.0)))
    )


def product_report(predictions: DataFrame, *, start: datetime.date) -> DataFrame:
    """Units per future week of every series, with the week's first and last day as text."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return predictions.select(
        F.col(s.REGION).alias("Region"),
        F.col(s.STORE).alias("Store"),
        F.col(s.PRODUCT).alias("Product"),
        text(F.lit(start)).alias("Forecast_Start_Date"),
        text(F.col("week_start")).alias("Week_Starting"),
        text(F.date_add("week_start", 6)).alias("Week_Ending"),
        F.bround("prediction").cast("long").alias("Forecasted_Units"),
    )


def bulk_report(predictions: DataFrame, *, start: datetime.date) -> DataFrame:
    """30- and 60-day forecast (4 and 9 weeks) and weekly velocity of every series; failed ones are 0."""

    def horizon(weeks: int):
        inside = F.when(F.col("week_index") < weeks, F.col("prediction"))
        return F.coalesce(F.bround(F.sum(inside)), F.lit(0.0)).cast("long")

    status = F.max("Status") if "Status" in predictions.columns else F.lit(None).cast("string")
    return predictions.groupBy(
        F.col(s.REGION).alias("Region"), F.col(s.STORE).alias("Store"), F.col(s.PRODUCT).alias("Product")
    ).agg(
        F.first(F.date_format(F.lit(start), "yyyy-MM-dd")).alias("Forecast_Start_Date"),
        horizon(MONTH_WEEKS).alias("30_Day_Forecast"),
        horizon(BULK_WEEKS).alias("60_Day_Forecast"),
        F.bround(F.max("last_week_qty"), 2).alias("Current_Weekly_Velocity"),
        status.alias("Status"),
    )


def summary_input(bulk: DataFrame) -> DataFrame:
    """Per product of a bulk report: four equal weeks of the 30-day forecast and the current velocity."""
    weekly = F.col("30_Day_Forecast") / F.lit(4.0)
    return bulk.select(
        "Region",
        "Store",
        F.col("Product").alias("product_name"),
        F.array_repeat(weekly, 4).alias("predictions"),
        F.col("Current_Weekly_Velocity").alias("historical_avg"),
    )
