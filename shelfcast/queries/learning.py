"""Trained models (M, F3): checked for rows only.

All four candidates are trained, with the counts of ``models.QUICK``; those of the full job are ``models.CANDIDATES``.
"""

import datetime

from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import models
from shelfcast.operators.split import mark_train
from shelfcast.plans.features import training_frame
from shelfcast.plans.planning import bulk_forecast, forecast
from shelfcast.plans.training import train
from shelfcast.queries.planning import BEGIN, HISTORY
from shelfcast.queries.registry import query
from shelfcast.session import materialize
from shelfcast.sources.star_schema import canonical_sales, holiday_calendar


def _predictions(spark, sf, name):
    """Test rows scored by one candidate."""
    frame, _ = training_frame(canonical_sales(spark, sf), holiday_calendar(spark, sf))
    frame = materialize(frame.select(*s.SERIES, s.WEEK_END, s.QUANTITY, *s.FEATURES), "features")
    split = mark_train(frame)
    model = models.QUICK[name].fit(split.where("is_train"), s.FEATURES)
    return model.transform(split.where("NOT is_train")).select(*s.SERIES, s.WEEK_END, s.QUANTITY, "prediction")


@query("M3_boosted_poisson")
def boosted_poisson(spark, sf):
    return _predictions(spark, sf, "Boosted Poisson")


@query("M4_random_forest")
def random_forest(spark, sf):
    return _predictions(spark, sf, "Random Forest")


@query("M5_gradient_boosting")
def gradient_boosting(spark, sf):
    return _predictions(spark, sf, "Gradient Boosting")


@query("M6_boosted_poisson_shallow")
def boosted_poisson_shallow(spark, sf):
    return _predictions(spark, sf, "Boosted Poisson Shallow")


def _train(spark, sf, **options):
    return train(canonical_sales(spark, sf), holiday_calendar(spark, sf), candidates=models.QUICK, **options)


@query("M7_tournament")
def tournament(spark, sf):
    result, _ = _train(spark, sf)
    return result.metrics.withColumn("is_winner", F.col("model") == F.lit(result.winner))


@query("M7_tournament_by_date")
def tournament_by_date(spark, sf):
    """Only earlier weeks as features, and the last weeks as the test."""
    result, _ = _train(spark, sf, shift=1, test_from=datetime.date(2000, 7, 1))
    return result.metrics.withColumn("is_winner", F.col("model") == F.lit(result.winner))


def _trained(spark, sf):
    result, encoders = _train(spark, sf)
    options = {"model": result.model, "encoders": encoders, "holidays": holiday_calendar(spark, sf)}
    return canonical_sales(spark, sf, HISTORY), options


@query("M8_batch_prediction")
def batch_prediction(spark, sf):
    sales, options = _trained(spark, sf)
    return forecast(sales, start=BEGIN, weeks=9, **options)


@query("F3_bulk_report_trained")
def bulk_report_trained(spark, sf):
    sales, options = _trained(spark, sf)
    return bulk_forecast(sales, start=BEGIN, **options)
