"""Forecast and stock plan of all series in one job."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import weeks_in_horizon
from shelfcast.operators.anchors import daily_volatility, last_known_metrics
from shelfcast.operators.encoding import Encoders
from shelfcast.operators.forecasting import (
    BULK_WEEKS,
    add_future_holidays,
    bulk_report,
    encode_future,
    future_frame,
    model_predictions,
    naive_predictions,
)
from shelfcast.operators.history import as_history
from shelfcast.operators.inventory import inventory_plan
from shelfcast.operators.options import cascade


def forecast(
    sales: DataFrame,
    *,
    start: datetime.date,
    weeks: int,
    model=None,
    encoders: Encoders | None = None,
    holidays: DataFrame | None = None,
    prices: DataFrame | None = None,
) -> DataFrame:
    """A prediction per series and future week; without a model, the four-week mean.

    History after ``start`` is not used. Sales are read once, unless they come as a compact history.
    """
    history = as_history(sales)
    anchored = last_known_metrics(history, cutoff=start, pairs=cascade(history))
    frame = future_frame(anchored, start=start, weeks=weeks, prices=prices)
    if model is None:
        return naive_predictions(frame)
    if holidays is not None:
        frame = add_future_holidays(frame, holidays, start=start, weeks=weeks)
    return model_predictions(encode_future(frame, encoders, start=start, weeks=weeks), model)


def bulk_forecast(sales: DataFrame, *, start: datetime.date, **options) -> DataFrame:
    return bulk_report(forecast(sales, start=start, weeks=BULK_WEEKS, **options), start=start)


def stock_plan(
    sales: DataFrame,
    *,
    start: datetime.date,
    horizon_days: int = 30,
    lead_time_days: int = 7,
    growth_pct: float = 15.0,
    as_of=None,
    **options,
) -> DataFrame:
    """Demand, safety stock, reorder point and procurement quantity of every series.

    Volatility uses the whole history unless ``as_of`` cuts it.
    """
    history = as_history(sales)
    predictions = forecast(history, start=start, weeks=weeks_in_horizon(horizon_days), **options)
    return inventory_plan(
        predictions,
        daily_volatility(history, as_of=as_of),
        horizon_days=horizon_days,
        lead_time_days=lead_time_days,
        growth_pct=growth_pct,
    )


def last_prices(panel: DataFrame) -> DataFrame:
    """Last known price and discount per (store, product), to replace the fixed assumptions."""
    known = panel.where(F.col(s.MRP).isNotNull())
    return known.groupBy(*s.PAIR).agg(
        F.max_by("DiscountPct", s.WEEK_END).alias("last_discount"),
        F.max_by("Effective_Price", s.WEEK_END).alias("last_price"),
    )
