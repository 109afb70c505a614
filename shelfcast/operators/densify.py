"""Fill the gaps of a dated series without joining it to itself."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    date_col: str,
    *,
    step: str = "weeks",
    zero: Mapping[str, float] | Sequence[str] = (),
) -> DataFrame:
    """Add the missing weeks, days or months between a group's first and last date.

    Every row looks up the date of the next row of its group and emits itself and the empty steps
    up to there. Columns named in ``zero`` are 0 in the added rows, all others are null. The rows must be
    unique per key and date; months are month ends.
    """
    ahead = F.lead(date_col).over(Window.partitionBy(*keys).orderBy(date_col))
    nxt = F.col("_next")
    steps = {
        "days": lambda d: (d, F.date_sub(nxt, 1), "interval 1 day"),
        "weeks": lambda d: (d, F.date_sub(nxt, 7), "interval 7 days"),
        "months": lambda d: (F.trunc(d, "month"), F.add_months(F.trunc(nxt, "month"), -1), "interval 1 month"),
    }
    start, stop, width = steps[step](F.col(date_col))
    values = [c for c in df.columns if c not in (*keys, date_col)]
    slots = df.withColumn("_next", ahead).select(
        *keys, *values, F.posexplode(F.sequence(start, F.coalesce(stop, start), F.expr(width))).alias("_gap", "_slot")
    )
    slot: Column = F.last_day("_slot") if step == "months" else F.col("_slot")

    def value(name: str) -> Column:
        kept = F.when(F.col("_gap") == 0, F.col(name))
        if name in zero:
            kept = kept.otherwise(F.lit(0).cast(df.schema[name].dataType))
        return kept.alias(name)

    return slots.select(*keys, slot.alias(date_col), *[value(c) for c in values])
