"""Checks of newly uploaded sales."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import day
from shelfcast.functions.text import clean_double, number_or_zero
from shelfcast.operators.cleaning import with_parsed_date
from shelfcast.operators.digests import SalesDigests


def _quantity(sales: DataFrame) -> Column:
    if sales.schema[s.QUANTITY].dataType.simpleString() == "string":
        return number_or_zero(F.col(s.QUANTITY))
    return F.coalesce(clean_double(F.col(s.QUANTITY)), F.lit(0.0))


def daily_totals(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quantity per day with sales (and per key), at most one row per calendar day."""
    return (
        sales.where(F.col(s.BILL_DATE).isNotNull())
        .groupBy(*keys, day(F.col(s.BILL_DATE)).alias("day"))
        .agg(F.sum(_quantity(sales)).alias(s.QUANTITY))
    )


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Row counts before and after removing repeated rows."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("original_rows"),
        F.count("*").alias("rows_after_dedupe"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("duplicates_removed"),
    )


def date_range(sales: DataFrame) -> DataFrame:
    return sales.agg(F.min(s.BILL_DATE).alias("date_min"), F.max(s.BILL_DATE).alias("date_max"))


def new_rows(upload: DataFrame, active: DataFrame | None, columns: Sequence[str] = s.REQUIRED) -> DataFrame:
    """Distinct uploaded rows that the active sales lack; nulls count as equal.

    Both tables go into one grouping, which combines repeated rows before the shuffle; a row with
    many copies costs as much as any other.
    """
    uploaded = with_parsed_date(upload).select(*columns, F.lit(1).alias("_new"))
    if active is not None:
        uploaded = uploaded.unionByName(with_parsed_date(active).select(*columns, F.lit(0).alias("_new")))
    return uploaded.groupBy(*columns).agg(F.min("_new").alias("_new")).where(F.col("_new") == 1).select(*columns)


def missing_dates(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days without sales between the first and the last day (of each key)."""
    w = Window.partitionBy(*keys).orderBy("day")
    ahead = daily_totals(sales, keys).withColumn("_next", F.lead("day").over(w))
    gaps = ahead.where(F.datediff("_next", "day") > 1)
    missing = F.explode(F.sequence(F.date_add("day", 1), F.date_sub("_next", 1)))
    return gaps.select(*keys, missing.alias("missing_date"))


def daily_changes(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change against the previous day with sales, absolute and relative; no ratio to a zero."""
    w = Window.partitionBy(*keys).orderBy("day")
    before = F.lag(s.QUANTITY).over(w)
    with_previous = daily_totals(sales, keys).withColumn("previous", before)
    change = F.col(s.QUANTITY) - F.col("previous")
    return with_previous.withColumn("change", change).withColumn(
        "pct_change", F.try_divide("change", "previous")
    )


def change_threshold(changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The larger of the 90th percentile of absolute changes, half the mean quantity, and 1."""
    return changes.groupBy(*keys).agg(_threshold().alias("threshold"))


def _threshold(over: Window | None = None) -> Column:
    def windowed(c: Column) -> Column:
        return c.over(over) if over is not None else c

    return F.greatest(
        windowed(F.percentile(F.abs(F.col("change")), F.lit(0.9))),
        windowed(F.avg(s.QUANTITY)) * 0.5,
        F.lit(1.0),
    )


def sudden_changes(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days whose change reaches both the threshold and half of the previous quantity."""
    judged = daily_changes(sales, keys).withColumn("threshold", _threshold(Window.partitionBy(*keys)))
    return judged.where((F.abs("change") >= F.col("threshold")) & (F.abs("pct_change") >= 0.5)).select(
        *keys, *_anomaly()
    )


def _anomaly() -> list[Column]:
    return [
        F.col("day").alias("Date"),
        F.when(F.col("change") > 0, F.lit("Spike")).otherwise(F.lit("Drop")).alias("Type"),
        F.col(s.QUANTITY).cast("long").alias("Quantity"),
        F.coalesce(F.col("previous").cast("long"), F.lit(0)).alias("Previous"),
        F.coalesce(F.col("change").cast("long"), F.lit(0)).alias("Change"),
    ]


def upload_summary(upload: DataFrame, active: DataFrame | None = None, *, digests: SalesDigests | None = None) -> DataFrame:
    """One row: row counts, new rows, duplicates, date range, missing days and sudden changes.

    A single chain of groupings: all columns (which finds the copies), the compared columns together
    with the active sales (which finds the new rows), days, one row. Each combines before its shuffle. With ``digests``
    of the active sales those are not read; distinct rows meet the digests of their months.
    """
    copies = upload.groupBy(*upload.columns).agg(F.count("*").alias("_copies"))
    new = with_parsed_date(copies).select(
        *s.REQUIRED, _quantity(copies).alias("_qty"), F.col("_copies"), F.lit(1).alias("_up"), F.lit(0).alias("_old")
    )
    if active is not None:
        known = with_parsed_date(active).select(
            *[F.col(c).cast(new.schema[c].dataType) for c in s.REQUIRED],
            F.lit(0.0).alias("_qty"),
            F.lit(0).cast("long").alias("_copies"),
            F.lit(0).alias("_up"),
            F.lit(1).alias("_old"),
        )
        new = new.unionByName(known)
    compared = (
        new.groupBy(*s.REQUIRED)
        .agg(
            F.sum("_qty").alias("_qty"),
            F.sum("_copies").alias("_copies"),
            F.sum("_up").alias("_rows"),
            F.max("_old").alias("_old"),
        )
        .where(F.col("_rows") > 0)
    )
    if digests is not None:
        compared = digests.mark(compared.drop("_old"), "_old")
    days = compared.groupBy(day(F.col(s.BILL_DATE)).alias("day")).agg(
        F.sum("_qty").alias(s.QUANTITY),
        F.sum("_copies").alias("_copies"),
        F.sum("_rows").alias("_rows"),
        F.sum(F.when(F.col("_old") == 0, 1).otherwise(0)).alias("_added"),
        F.min(s.BILL_DATE).alias("_first"),
        F.max(s.BILL_DATE).alias("_last"),
    )
    # From here on there is one row per calendar day, and one for unreadable dates. That row must not
    # take part in the comparison of neighbouring days.
    dated = F.col("day").isNotNull()
    w = Window.partitionBy(dated).orderBy("day")
    with_previous = days.withColumn("previous", F.when(dated, F.lag(s.QUANTITY).over(w))).withColumn(
        "_previous_day", F.when(dated, F.lag("day").over(w))
    )
    changed = with_previous.withColumn("change", F.col(s.QUANTITY) - F.col("previous")).withColumn(
        "pct_change", F.try_divide("change", "previous")
    )
    judged = changed.withColumn("threshold", _threshold(Window.partitionBy(dated)))
    sudden = dated & (F.abs("change") >= F.col("threshold")) & (F.abs("pct_change") >= 0.5)
    count_if = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return judged.agg(
        total("_copies").alias("original_rows"),
        total("_rows").alias("rows_after_dedupe"),
        total("_added").alias("rows_added"),
        (total("_copies") - total("_rows")).alias("duplicates_removed"),
        F.min("_first").alias("date_min"),
        F.max("_last").alias("date_max"),
        total(F.datediff("day", "_previous_day") - 1).alias("missing_dates"),
        count_if(sudden).alias("anomalies"),
    )
