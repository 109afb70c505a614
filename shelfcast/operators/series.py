"""Lag, rolling and trend features of the weekly panel."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schema as s

LONGEST = max(max(s.LAGS), max(s.WINDOWS))
EWMA_SPAN = 4
BLOCK = 1024


def _total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def series_features(panel: DataFrame, *, shift: int = 0, on_zero: str = "inf") -> DataFrame:
    """Add lags, rolling means and deviations, EWMA, change, trend and z-score.

    A series is a (product, store) pair in (region, week) order. A pair has at most one row per region
    and calendar week, however many sales it has. ``shift=0`` lets the windows include the current
    week; ``shift=1`` uses only weeks before it. ``on_zero`` says what a change from 0 to more gives:
    ``inf``, ``null`` or ``zero``.
    """
    if shift not in (0, 1):
        raise ValueError("shift must be 0 or 1")
    if on_zero not in ("inf", "null", "zero"):
        raise ValueError("on_zero must be inf, null or zero")
    kept = panel.columns
    series = Window.partitionBy(s.PRODUCT, s.STORE).orderBy(s.REGION, s.WEEK_END)
    quantity = F.col(s.QUANTITY)

    # One window pass fetches the earlier weeks; everything else is arithmetic on them.
    lagged = panel.select(
        "*",
        (F.row_number().over(series) - 1).alias("_pos"),
        *[F.lag(quantity, k).over(series).cast("double").alias(f"_q{k}") for k in range(1, LONGEST + 1)],
    ).withColumn("_q0", quantity.cast("double"))

    def past(k: int) -> Column:
        return F.col(f"_q{k}")

    def full(n: int, back: int = 0) -> Column:
        return F.col("_pos") >= shift + back + n - 1

    def mean(n: int, back: int = 0) -> Column:
        terms = [past(shift + back + k) for k in range(n)]
        return F.when(full(n, back), _total(terms) / F.lit(float(n))).otherwise(F.lit(0.0))

    means = lagged.select(
        "*",
        *[F.coalesce(quantity_lag(k), F.lit(0)).alias(f"Lag_{k}_Week") for k in s.LAGS],
        *[mean(n).alias(f"Rolling_Mean_{n}") for n in s.WINDOWS],
        mean(4, back=1).alias("_previous_mean"),
    )

    def deviation(n: int) -> Column:
        centre = F.col(f"Rolling_Mean_{n}")
        squares = [(past(shift + k) - centre) * (past(shift + k) - centre) for k in range(n)]
        return F.when(full(n), F.sqrt(_total(squares) / F.lit(float(n - 1)))).otherwise(F.lit(0.0))

    spread = means.select("*", *[deviation(n).alias(f"Rolling_Std_{n}") for n in s.WINDOWS])

    current, base = past(shift), past(shift + 4)
    from_zero = {
        "inf": F.when(current > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)),
        "null": F.when(current == 0, F.lit(0.0)),
        "zero": F.lit(0.0),
    }[on_zero]
    trending = spread.select(
        "*",
        F.when(base.isNull(), F.lit(0.0))
        .when(base == 0, from_zero)
        .otherwise((current - base) / F.nullif(base, F.lit(0.0)))
        .alias("MoM_Change"),
        F.when(F.col("_pos") >= 1, F.col("Rolling_Mean_4") - F.col("_previous_mean"))
        .otherwise(F.lit(0.0))
        .alias("Trend_4Week"),
        F.when(
            full(12) & (F.col("Rolling_Std_12") > 0),
            (current - F.col("Rolling_Mean_12")) / F.nullif(F.col("Rolling_Std_12"), F.lit(0.0)),
        )
        .otherwise(F.lit(0.0))
        .alias("Quantity_ZScore"),
    )
    return add_ewma(trending, shift=shift).select(
        *kept,
        *[f"Lag_{k}_Week" for k in s.LAGS],
        *[f"Rolling_Mean_{n}" for n in s.WINDOWS],
        *[f"Rolling_Std_{n}" for n in s.WINDOWS],
        f"EWMA_{EWMA_SPAN}",
        "MoM_Change",
        "Trend_4Week",
        "Quantity_ZScore",
    )


def quantity_lag(k: int) -> Column:
    return F.col(f"_q{k}").cast("long")


def add_ewma(panel: DataFrame, *, shift: int = 0, span: int = EWMA_SPAN) -> DataFrame:
    """Exponentially weighted mean with the weights of all weeks so far normalised to 1.

    Needs ``_pos``, the row number from 0 in the series. The weighted sum is a running sum of
    ``q / decay^i``, which costs one addition per row. It restarts every 1,024 rows to stay in the range of a
    double; the sum at the end of the block before is carried over, and what is older weighs less than 1e-200.
    """
    decay = F.lit(1.0 - 2.0 / (span + 1.0))
    name = f"EWMA_{span}"
    offset = F.col("_pos") % BLOCK
    blocked = panel.withColumn("_block", F.floor(F.col("_pos") / F.lit(BLOCK)))
    in_block = Window.partitionBy(s.PRODUCT, s.STORE, "_block").orderBy("_pos")
    in_series = Window.partitionBy(s.PRODUCT, s.STORE).orderBy("_block", "_pos")
    local = F.sum(F.col(s.QUANTITY) * F.pow(decay, -offset)).over(
        in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = blocked.withColumn("_local", local * F.pow(decay, offset))
    carry = F.last(F.when(offset == BLOCK - 1, F.col("_local")), ignorenulls=True).over(
        in_series.rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summed.withColumn("_carry", F.coalesce(carry, F.lit(0.0)))
    weights = (F.lit(1.0) - F.pow(decay, F.col("_pos") + 1)) / (F.lit(1.0) - decay)
    value = (F.col("_local") + F.pow(decay, offset + 1) * F.col("_carry")) / weights
    if not shift:
        return carried.withColumn(name, value)
    return carried.withColumn("_ewma", value).withColumn(
        name, F.coalesce(F.lag("_ewma", 1).over(in_series), F.lit(0.0))
    )


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    """The last rows of every (product, store) series, as W10."""
    newest = Window.partitionBy(s.PRODUCT, s.STORE).orderBy(F.desc(s.REGION), F.desc(s.WEEK_END))
    return panel.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
