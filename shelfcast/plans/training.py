"""Audit an upload, train, and promote the result."""

import datetime
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators.audit import missing_dates, sudden_changes, upload_summary
from shelfcast.operators.cleaning import dedupe, parse_bill_date, require_rows, retraining_window
from shelfcast.operators.encoding import Encoders
from shelfcast.operators.forecasting import align
from shelfcast.operators.models import Tournament, tournament
from shelfcast.operators.split import mark_train, mark_train_by_date
from shelfcast.plans.features import training_frame
from shelfcast.session import materialize
from shelfcast.sources import artifacts
from shelfcast.sources.sales import write_snapshot


@dataclass
class Audit:
    summary: DataFrame
    missing_dates: DataFrame
    sudden_changes: DataFrame


def audit(upload: DataFrame, active: DataFrame | None = None) -> Audit:
    """Summary row and the two detail tables of an upload."""
    s.require_columns(upload)
    cleaned = parse_bill_date(dedupe(upload))
    return Audit(upload_summary(upload, active), missing_dates(cleaned), sudden_changes(cleaned))


def train(
    sales: DataFrame,
    holidays: DataFrame | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    *,
    candidates: Mapping[str, object] | None = None,
    shift: int = 0,
    fraction: float = 0.8,
    test_from: datetime.date | None = None,
    log: Callable[[str], None] = lambda message: None,
    **options,
) -> tuple[Tournament, Encoders]:
    """Build the features, split them and run the tournament.

    The test rows are the last by position, as a share of all, or all weeks from ``test_from``. Other options are the tournament's.
    """
    cleaned = require_rows(parse_bill_date(s.require_columns(sales)))
    frame, encoders = training_frame(cleaned, holidays, tables, shift=shift)
    frame = materialize(align(frame, keep=(*s.SERIES, s.WEEK_END, s.QUANTITY)), "features")
    split = mark_train(frame, fraction) if test_from is None else mark_train_by_date(frame, test_from)
    return tournament(split, candidates=candidates, log=log, **options), encoders


def retrain_and_promote(
    upload: DataFrame,
    root: str,
    holidays: DataFrame | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    *,
    strategy: str = "full",
    when: datetime.datetime | None = None,
    **training,
) -> Tournament:
    """Snapshot the cleaned upload, train on the snapshot, and promote the version once it is complete.

    The version names the snapshot too, so the active data change together with the active model.
    """
    spark = upload.sparkSession
    when = when or datetime.datetime.now()
    version = when.strftime("%Y%m%d_%H%M%S")
    chosen = retraining_window(parse_bill_date(dedupe(s.require_columns(upload))), strategy=strategy)
    snapshot = spark.read.parquet(write_snapshot(chosen, root, when=when))
    result, encoders = train(snapshot, holidays, tables, **training)
    winning = result.metrics.where(F.col("model") == F.lit(result.winner))
    artifacts.stage(root, version, result.model, encoders, winning)
    artifacts.promote(spark, root, version)
    return result


def active_data(spark, root: str) -> DataFrame | None:
    """The sales the active model was trained on."""
    version = artifacts.active_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root.rstrip('/')}/training_uploads/run={version}")
