"""Last known demand per store and product, and daily volatility."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import day
from shelfcast.functions.text import clean_double
from shelfcast.operators.audit import _quantity
from shelfcast.operators.cleaning import up_to
from shelfcast.operators.weekly import observed_weeks

RECENT_WEEKS = 4
OFFERS = ("Bank_Emi_Flag", "Bank_Cashback_Pct", "Additional_Funded_Scheme_Pct")
ANCHORS = (
    "last_week_qty",
    "rolling_4_avg",
    "last_true_demand",
    "last_emi_ratio",
    "last_cashback_pct",
    "last_additional_pct",
)


def last_known_metrics(sales: DataFrame, *, cutoff=None, pairs: DataFrame | None = None) -> DataFrame:
    """Figures of the last week and the mean of the last four weeks up to the cutoff, for every pair.

    The newest week always has sales, so no gap has to be filled: empty weeks only enlarge the divisor
    of the mean. Pairs of ``pairs`` without history get zeros.
    """
    weekly = observed_weeks(up_to(sales, cutoff), s.PAIR, OFFERS)
    pair = Window.partitionBy(*s.PAIR)
    placed = weekly.withColumn("_newest", F.max(s.WEEK_END).over(pair))
    recent = F.col(s.WEEK_END) > F.date_sub("_newest", 7 * RECENT_WEEKS)
    weeks = F.least(F.lit(RECENT_WEEKS), F.datediff(F.max(s.WEEK_END), F.min(s.WEEK_END)) / 7 + 1)

    def latest(c: str):
        return F.coalesce(F.max_by(c, s.WEEK_END), F.lit(0.0))

    anchors = placed.groupBy(*s.PAIR).agg(
        latest(s.QUANTITY).alias("last_week_qty"),
        (F.sum(F.when(recent, F.col(s.QUANTITY)).otherwise(F.lit(0.0))) / weeks).alias("rolling_4_avg"),
        latest("True_Demand").alias("last_true_demand"),
        latest("Bank_Emi_Flag").alias("last_emi_ratio"),
        latest("Bank_Cashback_Pct").alias("last_cashback_pct"),
        latest("Additional_Funded_Scheme_Pct").alias("last_additional_pct"),
    )
    if pairs is None:
        return anchors
    return pairs.join(anchors, list(s.PAIR), "left").fillna(0.0, subset=list(ANCHORS))


def daily_volatility(sales: DataFrame, *, days: int = 180, as_of=None) -> DataFrame:
    """Population deviation of daily quantity over the last days of every pair, empty days as 0.

    The empty days are counted, not generated: their part of the variance follows from the mean. Rows are
    combined per pair and time before they meet the pair's newest time, and the meeting is a plain join,
    so that adaptive execution can split a pair with very many rows.
    """
    dated = up_to(sales, as_of).dropna(subset=[*s.PAIR, s.BILL_DATE])
    moments = dated.groupBy(*s.PAIR, s.BILL_DATE).agg(F.sum(_quantity(sales)).alias("_q"))
    newest = dated.groupBy(*s.PAIR).agg(F.max(s.BILL_DATE).alias("_newest"))
    start = F.col("_newest") - F.expr(f"interval {int(days)} days")
    recent = moments.join(newest, list(s.PAIR)).where(F.col(s.BILL_DATE) >= start)
    daily = recent.groupBy(*s.PAIR, day(F.col(s.BILL_DATE)).alias("_day")).agg(F.sum("_q").alias("_q"))
    moved = daily.groupBy(*s.PAIR).agg(
        F.count("*").alias("_seen"),
        F.sum("_q").alias("_total"),
        F.var_pop("_q").alias("_var"),
        (F.datediff(F.max("_day"), F.min("_day")) + 1).alias("_days"),
    )
    mean = F.col("_total") / F.col("_days")
    offset = F.col("_total") / F.col("_seen") - mean
    squares = (
        F.col("_seen") * (F.col("_var") + offset * offset) + (F.col("_days") - F.col("_seen")) * mean * mean
    )
    sigma = F.when(F.col("_days") > 1, F.sqrt(squares / F.col("_days"))).otherwise(F.lit(0.0))
    return moved.select(*s.PAIR, sigma.alias("daily_sigma"))


def mean_sale(sales: DataFrame) -> DataFrame:
    """Mean quantity of a bill line per pair, 0 if there is none."""
    return sales.groupBy(*s.PAIR).agg(F.coalesce(F.avg(clean_double(F.col(s.QUANTITY))), F.lit(0.0)).alias("mean_quantity"))
