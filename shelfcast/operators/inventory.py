"""Stock figures from a forecast: one row per (region, store, product)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s

SERVICE_FACTOR = 1.65
# Fixed value: deviation assumed as a share of the daily forecast.
FALLBACK_SHARE = 0.15
STOCK_SHARE = 0.8


def units(c: Column) -> Column:
    return F.bround(c).cast("long")


def forecast_totals(forecast: DataFrame, *, horizon_days: int) -> DataFrame:
    """Total, daily and weekly demand of the horizon."""
    summed = forecast.groupBy(*s.SERIES).agg(
        F.sum("prediction").alias("forecast_sum"), F.avg("prediction").alias("weekly_velocity")
    )
    return summed.withColumn("total_demand", units(F.col("forecast_sum"))).withColumn(
        "daily_velocity", F.col("total_demand") / F.lit(float(horizon_days))
    )


def safety_stock(
    forecast_sum: Column, daily_sigma: Column, *, horizon_days: int, lead_time_days: int, service_factor: float
) -> tuple[Column, Column]:
    """Safety stock and the deviation behind it: the larger of the measured and the assumed one."""
    assumed = (
        F.try_divide(forecast_sum, F.lit(float(horizon_days))) * F.lit(FALLBACK_SHARE) if horizon_days else F.lit(0.0)
    )
    sigma = F.greatest(F.coalesce(daily_sigma, F.lit(0.0)), assumed)
    return units(F.lit(service_factor) * sigma * F.sqrt(F.lit(float(lead_time_days)))), sigma


def inventory_plan(
    forecast: DataFrame,
    volatility: DataFrame,
    *,
    horizon_days: int = 30,
    lead_time_days: int = 7,
    growth_pct: float = 15.0,
    service_factor: float = SERVICE_FACTOR,
) -> DataFrame:
    """Demand, safety stock, reorder point, procurement quantity and assumed stock.

    ``forecast`` holds a prediction per series and week, ``volatility`` the daily deviation per (store, product).
    """
    totals = forecast_totals(forecast, horizon_days=horizon_days).join(volatility, list(s.PAIR), "left")
    safety, sigma = safety_stock(
        F.col("forecast_sum"),
        F.col("daily_sigma"),
        horizon_days=horizon_days,
        lead_time_days=lead_time_days,
        service_factor=service_factor,
    )
    stocked = totals.withColumn("safety_stock", safety).withColumn("sigma", sigma)
    reorder = units(F.col("daily_velocity") * F.lit(float(lead_time_days)) + F.col("safety_stock"))
    return stocked.withColumn("reorder_point", reorder).select(
        *s.SERIES,
        "total_demand",
        "daily_velocity",
        "weekly_velocity",
        "sigma",
        "safety_stock",
        "reorder_point",
        units(F.col("total_demand") * F.lit(1.0 + growth_pct / 100.0)).alias("procurement_quantity"),
        (F.col("reorder_point") * F.lit(STOCK_SHARE)).cast("long").alias("estimated_stock"),
    )
