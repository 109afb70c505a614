"""Week, month and season expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of each season.
FESTIVAL_MONTHS = (10, 11, 12)
SUMMER_MONTHS = (3, 4, 5)
MONSOON_MONTHS = (6, 7, 8, 9)


def day(c: Column) -> Column:
    return c.cast("date")


def week_end(c: Column) -> Column:
    """Sunday that closes the Monday-to-Sunday week."""
    return F.date_add(F.trunc(day(c), "week"), 6)


def month_end(c: Column) -> Column:
    return F.last_day(day(c))


def iso_week(c: Column) -> Column:
    return F.weekofyear(c)


def is_month_start(c: Column) -> Column:
    return (F.dayofmonth(c) == 1).cast("int")


def is_month_end(c: Column) -> Column:
    return (c == F.last_day(c)).cast("int")


def is_near_month_start(c: Column) -> Column:
    """The looser rule used for future weeks: day 7 or earlier."""
    return (F.dayofmonth(c) <= 7).cast("int")


def is_near_month_end(c: Column) -> Column:
    """The looser rule used for future weeks: day 25 or later."""
    return (F.dayofmonth(c) >= 25).cast("int")


def cycle(c: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a yearly cycle."""
    angle = F.lit(2.0) * F.pi() * c / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def weeks_after(c: Column, weeks: Column) -> Column:
    return F.date_add(c, weeks * 7)


def years_before(c: Column, years: int) -> Column:
    """Calendar-year subtraction; 29 February becomes 28 February."""
    return c - F.expr(f"interval {int(years)} years")


def week_parts(c: Column) -> dict[str, Column]:
    """Week, month and year columns plus their cyclic forms. The year is the calendar year."""
    week_sin, week_cos = cycle(iso_week(c), 52)
    month_sin, month_cos = cycle(F.month(c), 12)
    return {
        "Week": iso_week(c),
        "Month": F.month(c),
        "Year": F.year(c),
        "Quarter": F.quarter(c),
        "Week_Sin": week_sin,
        "Week_Cos": week_cos,
        "Month_Sin": month_sin,
        "Month_Cos": month_cos,
    }


def season_flags(month: Column) -> dict[str, Column]:
    return {
        "Is_Festival_Season": month.isin(*FESTIVAL_MONTHS).cast("int"),
        "Is_Summer_Season": month.isin(*SUMMER_MONTHS).cast("int"),
        "Is_Monsoon_Season": month.isin(*MONSOON_MONTHS).cast("int"),
    }


def weeks_in_horizon(days: int) -> int:
    return -(-int(days) // 7)
