"""Scores of predictions and the choice of the best model."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1e-5
DIGITS = {"mae": 4, "rmse": 4, "wape": 2, "accuracy": 2, "mape": 2, "smape": 2}
# Names of the scores in a scorecard.
NAMES = {
    "accuracy": "Forecast Accuracy (%)",
    "mae": "MAE (Absolute Error)",
    "rmse": "RMSE (Safety Deviation)",
    "mape": "MAPE (%)",
    "smape": "sMAPE (%)",
}


def regression_metrics(
    scored: DataFrame, *, label: str = "Quantity", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, WAPE, accuracy, MAPE and sMAPE in one pass, one row (per key)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    miss = F.abs(y - p)
    wape = F.try_divide(F.sum(miss), F.sum(y) + F.lit(SMALL)) * 100
    return scored.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg(miss).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        wape.alias("wape"),
        F.greatest(F.lit(0.0), F.lit(100.0) - wape).alias("accuracy"),
        (F.avg(F.abs(F.try_divide(y - p, y + F.lit(SMALL)))) * 100).alias("mape"),
        (F.avg(F.lit(2.0) * miss / (F.abs(y) + F.abs(p) + F.lit(SMALL))) * 100).alias("smape"),
    )


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({c: F.bround(c, d) for c, d in DIGITS.items()})


def best_model(metrics: DataFrame, *, name: str = "model", position: str = "position") -> DataFrame:
    """The row with the lowest MAE; the earlier candidate wins a tie."""
    first = F.struct(F.col("mae"), F.col(position))
    everything = F.struct(*metrics.columns)
    best = metrics.where(F.col("mae").isNotNull() & ~F.isnan("mae")).agg(F.min_by(everything, first).alias("best"))
    return best.select("best.*").where(F.col(name).isNotNull())


def _plain(c: str) -> Column:
    """A number as text, without an exponent if it is large."""
    large = F.rtrim(F.col(c).cast("decimal(38,4)").cast("string"), F.lit("0"))
    large = F.when(large.endswith("."), F.concat(large, F.lit("0"))).otherwise(large)
    return F.when(F.abs(c) >= 1e7, large).otherwise(F.col(c).cast("string"))


def scorecard(metrics: DataFrame, *, algorithm: Column, features: int) -> DataFrame:
    """The scores as (Parameter, Value) rows of text."""
    shown = rounded(metrics).select(
        algorithm.alias("Algorithm"),
        *[
            (F.concat(_plain(c), F.lit("%")) if c == "accuracy" else _plain(c)).alias(n)
            for c, n in NAMES.items()
        ],
        F.lit(str(features)).alias("Features_Used"),
    )
    return shown.unpivot([], shown.columns, "Parameter", "Value")
