"""A feature panel that grows by whole weeks, without computing earlier weeks again."""

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import week_end
from shelfcast.functions.pricing import whole_units
from shelfcast.operators.densify import fill_gaps
from shelfcast.operators.series import EWMA_SPAN, LONGEST, series_features
from shelfcast.operators.weekly import MEANS, SUMS, observed_weeks
from shelfcast.session import materialize
from shelfcast.sources.files import append_entry, last_entry

EWMA = f"EWMA_{EWMA_SPAN}"
ORDER = (s.REGION, s.WEEK_END)


def _weights(n):
    """Sum of the weights of the exponential mean over n weeks."""
    decay = 1.0 - 2.0 / (EWMA_SPAN + 1.0)
    return (F.lit(1.0) - F.pow(F.lit(decay), n)) / F.lit(1.0 - decay), F.pow(F.lit(decay), n)


class PanelStore:
    """Weekly demand with its series features under a folder, and the state that the next weeks need.

    The state of a (store, product) pair is its last weeks (as many as the longest window, and the exponential mean before
    them), and the last week of each of its regions, so an append costs as much as its own weeks and one state row per series and window week, whatever the history.
    Weeks are closed once appended: sales of closed weeks are refused. A pair sold in several regions is one series in the
    order of its regions; if new weeks come before old ones in it, the pair is computed again from its stored weeks.
    """

    def __init__(self, spark: SparkSession, path: str, *, on_zero: str = "zero"):
        self.spark, self.path, self.on_zero = spark, path.rstrip("/"), on_zero

    def closed(self) -> tuple[int, datetime.date | None]:
        """Number of appends so far, and the last closed week."""
        number, text = last_entry(self.spark, f"{self.path}/log")
        return number, None if text is None else datetime.date.fromisoformat(text)

    def append(self, sales: DataFrame, through: datetime.date) -> int:
        """Add the weeks up to ``through`` (a week's last day); fails if sales lie in closed weeks or another writer was first."""
        number, closed = self.closed()
        if closed is not None and through <= closed:
            raise ValueError(f"weeks up to {closed} are closed")
        week = week_end(F.col(s.BILL_DATE))
        inside = sales.where(week <= F.lit(through))
        if closed is not None and not inside.where(week <= F.lit(closed)).isEmpty():
            raise ValueError(f"sales of weeks up to {closed} come too late")
        folder = f"{self.path}/append={number + 1:06d}"
        state = self._state(number)
        fresh = materialize(self._dense(observed_weeks(inside), state), "fresh")
        touched = fresh.groupBy(*s.PAIR).agg(F.min(F.struct(*ORDER)).alias("_from"))
        known = state.groupBy(*s.PAIR).agg(F.max(F.struct(*ORDER)).alias("_to"))
        pairs = materialize(touched.join(known, list(s.PAIR), "left").select(*s.PAIR, F.coalesce(F.col("_from") < F.col("_to"), F.lit(False)).alias("again")), "pairs")
        again = pairs.where("again").select(*s.PAIR)
        later = pairs.where("NOT again").select(*s.PAIR)

        before = state.join(later, list(s.PAIR), "left_semi")
        rows = fresh.join(later, list(s.PAIR), "left_semi")
        added = self._extended(before, rows)
        if number and not again.isEmpty():
            stored = self.read().select(*fresh.columns).join(again, list(s.PAIR), "left_semi")
            whole = stored.unionByName(fresh.join(again, list(s.PAIR), "left_semi"))
            added = added.unionByName(self._placed(series_features(whole, on_zero=self.on_zero)))
        added.write.mode("overwrite").parquet(f"{folder}/rows")
        again.write.mode("overwrite").parquet(f"{folder}/replaced")
        written = self.spark.read.schema(added.schema).parquet(f"{folder}/rows")
        columns = state.columns
        kept = state.join(again, list(s.PAIR), "left_anti").unionByName(written.select(*columns))
        newest = Window.partitionBy(*s.PAIR).orderBy(F.desc("pos"))
        ends = F.row_number().over(Window.partitionBy(*s.PAIR, s.REGION).orderBy(F.desc("pos")))
        kept = kept.withColumns({"_rank": F.row_number().over(newest), "_end": ends})
        kept = kept.where((F.col("_rank") <= LONGEST + 1) | (F.col("_end") == 1)).drop("_rank", "_end")
        kept.write.mode("overwrite").parquet(f"{folder}/state")
        if not append_entry(self.spark, f"{self.path}/log", number + 1, through.isoformat()):
            raise RuntimeError(f"another writer closed weeks after {closed}")
        return number + 1

    def read(self, since: datetime.date | None = None) -> DataFrame:
        """The whole panel, or the weeks from ``since``: rows of all appends but those of pairs that a later one computed again."""
        number, _ = self.closed()
        rows = None
        for k in range(number, 0, -1):
            own = self.spark.read.parquet(f"{self.path}/append={k:06d}/rows").drop("pos")
            own = own if since is None else own.where(F.col(s.WEEK_END) >= F.lit(since))
            replaced = [f"{self.path}/append={j:06d}/replaced" for j in range(k + 1, number + 1)]
            if replaced:
                own = own.join(self.spark.read.schema(own.select(*s.PAIR).schema).parquet(*replaced).distinct(), list(s.PAIR), "left_anti")
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def _state(self, number: int) -> DataFrame:
        schema = f"{s.REGION} string, {s.STORE} string, {s.PRODUCT} string, {s.WEEK_END} date, {s.QUANTITY} long, pos long, {EWMA} double"
        if not number:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/append={number:06d}/state")

    def _dense(self, observed: DataFrame, state: DataFrame) -> DataFrame:
        """New weeks without gaps, also between a series' last week and its first new one."""
        last = state.groupBy(*s.SERIES).agg(F.max(s.WEEK_END).alias(s.WEEK_END)).join(observed.select(*s.SERIES).distinct(), list(s.SERIES), "left_semi")
        anchored = observed.withColumn("_new", F.lit(True)).unionByName(last.withColumn("_old", F.lit(True)), allowMissingColumns=True)
        dense = fill_gaps(anchored, [*s.PAIR, s.REGION], s.WEEK_END, step="weeks", zero=SUMS).where("_old IS NULL")
        return dense.select(*s.SERIES, s.WEEK_END, whole_units(F.col(s.QUANTITY)).alias(s.QUANTITY), "True_Demand", *MEANS)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*s.PAIR).orderBy(*ORDER)).cast("long"))

    def _extended(self, state: DataFrame, fresh: DataFrame) -> DataFrame:
        """Features of the new rows behind the state's.

        The windows see the state's weeks as rows. The exponential mean does so too; what is older comes from the mean at
        the row before them: mean * sum of weights is the weighted sum there, which fades by the weight of each row since.
        """
        newest = Window.partitionBy(*s.PAIR).orderBy(F.desc("pos"))
        ranked = state.withColumn("_rank", F.row_number().over(newest))
        older = ranked.where(F.col("_rank") == LONGEST + 1).select(*s.PAIR, F.col("pos").alias("_n"), F.col(EWMA).alias("_mean"))
        recent = ranked.where(F.col("_rank") <= LONGEST).select(*s.SERIES, s.WEEK_END, s.QUANTITY, F.lit(True).alias("_state"))
        rows = fresh.withColumn("_state", F.lit(False)).unionByName(recent, allowMissingColumns=True)
        own = self._placed(series_features(rows, on_zero=self.on_zero)).join(older, list(s.PAIR), "left")
        n = F.coalesce("_n", F.lit(0))
        weight, fade = _weights(F.col("pos"))
        behind, _ = _weights(n)
        total, _ = _weights(F.col("pos") + n)
        mean = (F.col(EWMA) * weight + fade * F.coalesce("_mean", F.lit(0.0)) * behind) / total
        return own.where("NOT _state").withColumns({EWMA: mean, "pos": F.col("pos") + n}).drop("_state", "_n", "_mean")


def grow(spark: SparkSession, path: str, sales: DataFrame, closings: Sequence[datetime.date], **options) -> PanelStore:
    """A store to which the weeks up to each of ``closings`` were appended one after another."""
    store = PanelStore(spark, path, **options)
    week = week_end(F.col(s.BILL_DATE))
    for through in closings:
        _, closed = store.closed()
        store.append(sales if closed is None else sales.where(week > F.lit(closed)), through)
    return store
