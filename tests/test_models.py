"""Tournament, saved versions and the retraining job."""

import datetime
import math
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import models
from shelfcast.plans.planning import bulk_forecast
from shelfcast.plans.training import active_data, audit, retrain_and_promote, train
from shelfcast.session import shared_dir
from shelfcast.sources import artifacts

SMALL = {
    "Boosted Poisson": models.PoissonBoosting(rounds=3, learning_rate=0.3, max_depth=3, bins=16),
    "Random Forest": models.Forest(trees=2, max_depth=3, bins=16),
}


class Broken:
    def fit(self, train, features):
        raise RuntimeError("no luck")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for day in range(0, 500, 3):
        when = datetime.datetime(2023, 1, 1) + datetime.timedelta(days=day)
        for store in ("A", "B"):
            for product in ("p", "q"):
                out.append(("Karnataka", store, product, when.isoformat(sep=" "), float(rng.randint(1, 9))))
    return out


@pytest.fixture
def calendar(spark):
    return spark.createDataFrame([(None, datetime.date(2023, 1, 26), "Republic Day")], s.HOLIDAY_SCHEMA)


def test_boosted_poisson_learns_a_rate(spark):
    rng = random.Random(1)
    data = [(float(x), 2 if x < 5 else 20) for x in (rng.randint(0, 9) for _ in range(600))]
    frame = spark.createDataFrame(data, "x double, Quantity long")
    model = models.PoissonBoosting(rounds=40, learning_rate=0.3, max_depth=2).fit(frame, ["x"])
    got = {r.x: r.prediction for r in model.transform(spark.createDataFrame([(1.0,), (8.0,)], "x double")).collect()}
    assert got[1.0] == pytest.approx(2, rel=0.1) and got[8.0] == pytest.approx(20, rel=0.1)


def test_tournament_survives_a_failing_candidate(make_sales, rows, calendar):
    log = []
    result, _ = train(make_sales(rows), calendar, candidates={"Broken": Broken()} | SMALL, log=log.append)
    scores = {r.model: r.mae for r in result.metrics.collect()}
    assert set(scores) == set(SMALL) and result.failures == {"Broken": "no luck"}
    assert result.winner == min(scores, key=scores.get)
    assert all(math.isfinite(v) for v in scores.values())
    assert any("Broken failed" in line for line in log)


def test_tournament_without_a_model_fails(make_sales, rows):
    with pytest.raises(RuntimeError):
        train(make_sales(rows), candidates={"Broken": Broken()})


def test_bad_input_fails_before_training(spark, make_sales):
    with pytest.raises(ValueError, match="MRP"):
        train(make_sales([("R", "S", "P", "2024-01-01", 1.0)]).drop("MRP"))
    with pytest.raises(ValueError, match="readable bill date"):
        train(make_sales([("R", "S", "P", None, 1.0)]))


def test_retrain_promote_load_predict(spark, make_sales, rows, calendar, tmp_path):
    root, sales = str(tmp_path / "models"), make_sales(rows)
    assert artifacts.load(spark, root) is None
    one = {"Boosted Poisson": SMALL["Boosted Poisson"]}
    result = retrain_and_promote(
        sales.unionAll(sales.limit(5)),
        root,
        calendar,
        strategy="rolling",
        when=datetime.datetime(2024, 6, 1, 12),
        candidates=one,
    )
    saved = artifacts.load(spark, root)
    assert saved.version == "20240601_120000" and saved.metrics.first().model == result.winner
    assert active_data(spark, root).count() == sales.count()

    start = datetime.date(2024, 5, 1)
    fresh = bulk_forecast(sales, start=start, model=saved.model, encoders=saved.encoders, holidays=calendar)
    again = bulk_forecast(sales, start=start, model=result.model, encoders=saved.encoders, holidays=calendar)
    assert sorted(map(tuple, fresh.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert fresh.where(F.col("60_Day_Forecast") <= 0).count() == 0 and fresh.where("Status IS NOT NULL").count() == 0

    # A version that lacks a part is not promoted and leaves the active one alone.
    artifacts.stage(root, "broken", saved.model, type(saved.encoders)(*list(saved.encoders.tables().values())[:3]), saved.metrics)
    with pytest.raises(RuntimeError, match="product_store, month_product"):
        artifacts.promote(spark, root, "broken")
    assert artifacts.active_version(spark, root) == "20240601_120000"
    # Older versions without combination codes can still be loaded.
    assert artifacts.load(spark, root, "broken").encoders.product_store is None
    artifacts.stage(root, "next", saved.model, saved.encoders, saved.metrics)
    artifacts.promote(spark, root, "next")
    assert artifacts.active_version(spark, root) == "next"


def test_audit_job(make_sales, rows):
    report = audit(make_sales(rows + rows[:7]), make_sales(rows[:100]))
    row = report.summary.first()
    assert (row.duplicates_removed, row.rows_added) == (7, len(rows) - 100)
    assert report.missing_dates.count() == row.missing_dates
    assert report.sudden_changes.count() == row.anomalies


def test_tournament_side_by_side_is_that_one_by_one(spark, make_sales, rows, calendar):
    """Same scores and winner; a candidate that takes too long is cancelled and leaves the others alone."""

    class Slow:
        def fit(self, train, features):
            train.sparkSession.range(4).repartition(4).mapInArrow(lambda b: time.sleep(60) or b, "id long").count()

    scores = []
    for side_by_side in (4, 1):
        result, _ = train(make_sales(rows), calendar, candidates=SMALL | {"Broken": Broken()}, side_by_side=side_by_side)
        scores.append((result.winner, sorted(map(tuple, result.metrics.collect()))))
    assert scores[0] == scores[1]
    started = time.time()
    result, _ = train(make_sales(rows), calendar, candidates={"Slow": Slow()} | SMALL, time_limit=25.0)
    assert result.failures == {"Slow": "took more than 25.0 seconds"} and time.time() - started < 55
    assert set(r.model for r in result.metrics.collect()) == set(SMALL)


def test_boosting_leaves_no_tables(spark):
    frame = spark.range(60).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3 + 1).cast("double").alias(s.QUANTITY))
    folder = files_of(spark)
    models.PoissonBoosting(rounds=4, max_depth=2).fit(frame, ["x"])
    assert files_of(spark) == folder


def files_of(spark):
    root = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "shelfcast"
    return sorted(p.name for p in root.glob("boosting-*"))
