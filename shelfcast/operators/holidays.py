"""Holiday features from a calendar table (state_code, holiday_date, holiday_name).

A null state code marks a national holiday. A state's calendar is the national one plus its own
rows; a state without rows of its own has the national calendar only; a null state has none.
"""

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.states import state_code
from shelfcast.session import materialize

NATIONAL = "*"
# Fixed value: distance reported when no holiday lies on that side.
NO_HOLIDAY_DAYS = 365
HOLIDAY_COLUMNS = ("Is_Holiday", "Is_Holiday_Week", "Holiday_Count", "Days_to_Next_Holiday", "Days_since_Last_Holiday")


def calendars(holidays: DataFrame) -> DataFrame:
    """One complete list per state (``calendar``), and the national one under ``*``, a row per date."""
    codes = holidays.agg(F.collect_set("state_code").alias("codes")).select("codes").scalar()
    # The national rows are copied to each of the few codes in the calendar.
    targets = F.when(F.col("state_code").isNull(), F.concat(F.array(F.lit(NATIONAL)), codes)).otherwise(
        F.array("state_code")
    )
    return (
        holidays.where(F.col("holiday_date").isNotNull())
        .select(F.explode(targets).alias("calendar"), "holiday_date", "holiday_name")
        .groupBy("calendar", "holiday_date")
        .agg(F.min("holiday_name").alias("holiday_name"))
    )


def known_codes(holidays: DataFrame) -> Column:
    """The state codes with rows of their own, as a scalar array."""
    return holidays.agg(F.collect_set("state_code").alias("codes")).select("codes").scalar()


def calendar_of(code: Column, codes: Column) -> Column:
    """Name of the calendar that applies to a state code."""
    return F.when(code.isNull(), F.lit(None).cast("string")).when(F.array_contains(codes, code), code).otherwise(
        F.lit(NATIONAL)
    )


def day_features(holidays: DataFrame, years: DataFrame) -> DataFrame:
    """Holiday features of every day of the given years in every calendar.

    At most (states + 1) x 366 rows per year, so weekly rows look their week end up by equality instead
    of comparing each row with each holiday. Only holidays in the given years count.
    """
    listed = calendars(holidays)
    inside = listed.join(years.select("Year"), F.year("holiday_date") == F.col("Year"), "left_semi")
    flagged = inside.select("calendar", F.col("holiday_date").alias("day"), F.lit(1).alias("flag"))
    span = years.agg(
        F.make_date(F.min("Year"), F.lit(1), F.lit(1)).alias("first"),
        F.make_date(F.max("Year"), F.lit(12), F.lit(31)).alias("last"),
    )
    first, last = span.select("first").scalar(), span.select("last").scalar()
    names = listed.select("calendar").distinct()
    spine = names.select("calendar", F.explode(F.sequence(first, last)).alias("day"))
    days = spine.join(flagged, ["calendar", "day"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))

    by_day = Window.partitionBy("calendar").orderBy("day")
    backwards = Window.partitionBy("calendar").orderBy(F.desc("day"))
    holiday = F.when(F.col("flag") == 1, F.col("day"))
    counted = days.select(
        "*",
        F.sum("flag").over(by_day.rowsBetween(-6, 0)).cast("int").alias("Holiday_Count"),
        F.last(holiday, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last(holiday, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
    )
    return counted.select(
        "calendar",
        "day",
        F.col("flag").alias("Is_Holiday"),
        (F.col("Holiday_Count") > 0).cast("int").alias("Is_Holiday_Week"),
        "Holiday_Count",
        F.coalesce(F.datediff("after", "day"), F.lit(NO_HOLIDAY_DAYS)).alias("Days_to_Next_Holiday"),
        F.coalesce(F.datediff("day", "before"), F.lit(NO_HOLIDAY_DAYS)).alias("Days_since_Last_Holiday"),
    )


def add_holiday_features(
    panel: DataFrame,
    holidays: DataFrame,
    *,
    date_col: str = s.WEEK_END,
    region_column: str = s.REGION,
    years: DataFrame | None = None,
    reference_case: bool = False,
) -> DataFrame:
    """Add the five holiday columns and ``Holiday_State_Code``; the row count does not change.

    ``years`` (column ``Year``) limits the calendar; by default it is the years of the panel, which is
    then read once more and so better written first.
    """
    if region_column not in panel.columns:
        raise ValueError(f"the panel has no region column {region_column}")
    if years is None:
        years = panel.select(F.year(date_col).alias("Year")).distinct()
    years = materialize(years.select("Year").distinct().coalesce(1), "years")  # a row per year
    features = materialize(day_features(holidays, years), "holiday-days")
    code = state_code(F.col(region_column), reference_case=reference_case)
    keyed = panel.withColumn("Holiday_State_Code", code).withColumn(
        "_calendar", calendar_of(F.col("Holiday_State_Code"), known_codes(holidays))
    )
    lookup = features.select(
        F.col("calendar").alias("_calendar"), F.col("day").alias("_day"), *HOLIDAY_COLUMNS
    )
    joined = keyed.join(
        lookup, (keyed["_calendar"] == lookup["_calendar"]) & (keyed[date_col] == lookup["_day"]), "left"
    )
    absent = {c: F.lit(0) for c in HOLIDAY_COLUMNS[:3]} | {c: F.lit(NO_HOLIDAY_DAYS) for c in HOLIDAY_COLUMNS[3:]}
    return joined.select(
        *panel.columns,
        "Holiday_State_Code",
        *[F.coalesce(F.col(c), absent[c]).alias(c) for c in HOLIDAY_COLUMNS],
    )


def holiday_lists(
    regions: DataFrame, holidays: DataFrame, years: DataFrame, *, reference_case: bool = False
) -> DataFrame:
    """The dated holiday list of every region for the given years, in date order."""
    code = state_code(F.col(s.REGION), reference_case=reference_case)
    # A list is also asked for a region without a name: it gets the national calendar.
    names = regions.select(s.REGION).distinct().withColumn(
        "calendar", F.coalesce(calendar_of(code, known_codes(holidays)), F.lit(NATIONAL))
    )
    wanted = calendars(holidays).join(years.select("Year"), F.year("holiday_date") == F.col("Year"), "left_semi")
    return (
        names.join(wanted, "calendar")
        .select(s.REGION, F.col("holiday_date").alias("Date"), F.col("holiday_name").alias("Holiday"))
        .orderBy(s.REGION, "Date")
    )


def holidays_in_window(
    regions: DataFrame,
    holidays: DataFrame,
    *,
    start: datetime.date,
    horizon_days: int,
    reference_case: bool = False,
) -> DataFrame:
    """Each region's holidays from the start of the forecast to its last day."""
    end = start + datetime.timedelta(days=horizon_days - 1)
    span = F.sequence(F.lit(start.year), F.lit(end.year))
    years = holidays.sparkSession.range(1).select(F.explode(span).alias("Year"))
    listed = holiday_lists(regions, holidays, years, reference_case=reference_case)
    return listed.where(F.col("Date").between(F.lit(start), F.lit(end)))


def holiday_impact(window: DataFrame, keys: Sequence[str] = (s.REGION,)) -> DataFrame:
    """Number of holidays in the window, and the date and name of the first."""
    return window.groupBy(*keys).agg(
        F.count("*").alias("holidays"),
        F.min("Date").alias("first_date"),
        F.coalesce(F.min_by("Holiday", "Date"), F.lit("Unnamed holiday")).alias("first_holiday"),
    )
