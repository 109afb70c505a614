"""Train and test split of the weekly panel."""

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.session import materialize


def _key() -> Column:
    return F.struct(*s.SERIES, s.WEEK_END)


def split_boundary(panel: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Key of the first test row when the panel is in (region, store, product, week) order, as one row.

    Rows are counted per series; the counts are then summed region by region, store by store in a
    region, and product by product in a store. The series is gap-free, so the week follows from the count.
    """
    counted = panel.groupBy(*s.SERIES).agg(F.count("*").alias("n"), F.min(s.WEEK_END).alias("first_week"))
    series = materialize(counted, "series")  # read three times below
    region, store, product = s.SERIES

    def before(n: str, order: str, *within: str) -> Column:
        w = Window.partitionBy(*within).orderBy(order) if within else Window.orderBy(order)
        return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    in_store = series.select("*", before("n", product, region, store).alias("_p"))
    stores = (
        series.groupBy(region, store)
        .agg(F.sum("n").alias("n"))
        .select("*", before("n", store, region).alias("_s"))
    )
    regions = (
        series.groupBy(region)
        .agg(F.sum("n").alias("n"))
        .select("*", before("n", region).alias("_r"))
        .select(
            "*",
            F.floor(
                F.sum("n").over(Window.orderBy(region).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                * F.lit(fraction)
            ).alias("_cut"),
        )
    )
    placed = (
        in_store.join(stores.drop("n"), [region, store])
        .join(regions.drop("n"), [region])
        .withColumn("_start", F.col("_r") + F.col("_s") + F.col("_p"))
    )
    hit = placed.where((F.col("_start") <= F.col("_cut")) & (F.col("_cut") < F.col("_start") + F.col("n")))
    week = F.date_add("first_week", ((F.col("_cut") - F.col("_start")) * 7).cast("int"))
    return hit.select(*s.SERIES, week.alias(s.WEEK_END))


def mark_train(panel: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Add ``is_train``: the first rows by position. The last entities, not the last weeks, are the test.

    Each row is compared with the boundary key, so the panel itself is neither sorted nor joined.
    """
    boundary = split_boundary(panel, fraction).select(_key()).scalar()
    return panel.withColumn("is_train", _key() < boundary)


def mark_train_by_date(panel: DataFrame, cutoff: datetime.date) -> DataFrame:
    """Add ``is_train``: weeks that end before the cutoff."""
    return panel.withColumn("is_train", F.col(s.WEEK_END) < F.lit(cutoff))
