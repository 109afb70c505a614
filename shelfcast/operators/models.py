"""Candidate regressors and their comparison."""

import concurrent.futures
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import trees
from shelfcast.operators.forecasting import align
from shelfcast.operators.metrics import regression_metrics
from shelfcast.operators.trees import Ensemble, Growth
from shelfcast.session import drop_table, read_table, write_table

LABEL = s.QUANTITY
SEED = 42
# Share of the training rows that decides when boosting stops.
VALIDATION_SHARE = 0.1


@dataclass(frozen=True)
class PoissonBoosting:
    """Boosted trees for counts with a log link; the defaults are the full job's."""

    rounds: int = 1500
    learning_rate: float = 0.01
    max_depth: int = 8
    rows: float = 0.8
    columns: float = 0.8
    min_weight: float = 1.0
    l1: float = 0.1
    l2: float = 1.0
    least_gain: float = 0.1
    max_step: float = 0.7
    patience: int = 50
    bins: int = 64

    def fit(self, train: DataFrame, features: Sequence[str]) -> Ensemble:
        growth = Growth(
            max_depth=self.max_depth, rows=self.rows, columns=self.columns, min_weight=self.min_weight,
            l1=self.l1, l2=self.l2, least_gain=self.least_gain, max_step=self.max_step,
        )
        return trees.boost(
            train, features, LABEL, trees.PoissonLoss(self.max_step), growth, rounds=self.rounds, learning_rate=self.learning_rate,
            patience=self.patience, valid_share=VALIDATION_SHARE, bins=self.bins, seed=SEED,
        )


@dataclass(frozen=True)
class Forest:
    """Trees on bootstrap draws, a root of the features for each node; notes have the out-of-bag score.

    A tree has at most ``max_leaves`` leaves, those of the best splits, so that its size does not grow with the rows.
    """

    trees: int = 500
    max_depth: int = 20
    max_leaves: int = 512
    min_rows: int = 2
    min_split_rows: int = 5
    bins: int = 64

    def fit(self, train: DataFrame, features: Sequence[str]) -> Ensemble:
        growth = Growth(
            max_depth=self.max_depth, max_leaves=self.max_leaves, min_rows=self.min_rows, min_split_rows=self.min_split_rows,
            bootstrap=True, node_columns=max(1, int(len(features) ** 0.5)),
        )
        return trees.forest(train, features, LABEL, growth, trees=self.trees, bins=self.bins, seed=SEED)


@dataclass(frozen=True)
class Boosting:
    """Boosted trees for the squared error, with a bound of leaves; stops after ``patience`` trees without gain."""

    rounds: int = 1000
    learning_rate: float = 0.05
    max_depth: int = 10
    max_leaves: int = 63
    min_rows: int = 20
    l2: float = 0.1
    patience: int = 10
    tolerance: float = 1e-7
    bins: int = 64

    def fit(self, train: DataFrame, features: Sequence[str]) -> Ensemble:
        growth = Growth(max_depth=self.max_depth, max_leaves=self.max_leaves, min_rows=self.min_rows, l2=self.l2)
        return trees.boost(
            train, features, LABEL, trees.SquaredLoss(), growth, rounds=self.rounds, learning_rate=self.learning_rate,
            patience=self.patience, valid_share=VALIDATION_SHARE, tolerance=self.tolerance, bins=self.bins, seed=SEED,
        )


CANDIDATES: dict[str, object] = {
    "Boosted Poisson": PoissonBoosting(),
    "Random Forest": Forest(),
    "Gradient Boosting": Boosting(),
    "Boosted Poisson Shallow": PoissonBoosting(
        rounds=1200, learning_rate=0.02, max_depth=7, rows=0.85, columns=0.85, l1=0.0, least_gain=0.0
    ),
}

#: All four candidates with fewer trees, larger steps and coarser bins.
QUICK: dict[str, object] = {
    "Boosted Poisson": PoissonBoosting(rounds=12, learning_rate=0.3, max_depth=6, patience=4, bins=32),
    "Random Forest": Forest(trees=12, max_depth=12, max_leaves=128, bins=32),
    "Gradient Boosting": Boosting(rounds=12, learning_rate=0.3, max_depth=7, max_leaves=31, patience=4, bins=32),
    "Boosted Poisson Shallow": PoissonBoosting(
        rounds=12, learning_rate=0.4, max_depth=5, rows=0.85, columns=0.85, l1=0.0, least_gain=0.0, patience=4, bins=32
    ),
}


@dataclass
class Tournament:
    winner: str
    model: object
    metrics: DataFrame  # one row per candidate that could be fitted
    failures: dict[str, str]


def tournament(
    frame: DataFrame,
    *,
    candidates: Mapping[str, object] | None = None,
    features: Sequence[str] = tuple(s.FEATURES),
    log: Callable[[str], None] = lambda message: None,
    side_by_side: int = 4,
    time_limit: float | None = None,
) -> Tournament:
    """Fit every candidate on the training rows and keep the one with the lowest MAE on the others.

    ``frame`` has the features, the label and ``is_train``. Candidates are fitted ``side_by_side`` at once, each in a
    scheduler pool of its own name (shares are fair if the session's ``spark.scheduler.mode`` is FAIR). One that fails,
    or takes more than ``time_limit`` seconds, is reported and its jobs are cancelled; the others go on. If all fail
    there is no result. The winner does not depend on which candidate ends first.
    """
    spark = frame.sparkSession
    aligned = align(frame, features, (LABEL, "is_train"))
    path = write_table(aligned, "training-frame")
    frame = read_table(spark, path, aligned.schema)
    sizes = {row["is_train"]: row["count"] for row in frame.groupBy("is_train").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        raise ValueError("the split leaves no weeks to train on or none to test on")
    log(f"{sizes[True]} weeks to train on, {sizes[False]} to test on")
    train, test = frame.where("is_train"), frame.where("NOT is_train")
    named = list((candidates or CANDIDATES).items())

    def run(name: str, candidate):
        tag = f"candidate-{threading.get_ident()}"
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        spark.sparkContext.addJobTag(tag)
        late = threading.Timer(time_limit, spark.sparkContext.cancelJobsWithTag, [tag]) if time_limit else None
        try:
            if late:
                late.start()
            model = candidate.fit(train, list(features))
            return model, regression_metrics(model.transform(test).select(LABEL, "prediction")).first().asDict()
        except Exception as error:
            if late and late.finished.is_set():
                raise TimeoutError(f"took more than {time_limit} seconds") from error
            raise
        finally:
            if late:
                late.cancel()
            spark.sparkContext.removeJobTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    fitted: dict[str, object] = {}
    rows, failures = [], {}
    with concurrent.futures.ThreadPoolExecutor(max(1, side_by_side)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(run), name, candidate) for name, candidate in named]
        for position, ((name, _), done) in enumerate(zip(named, waiting)):
            try:
                fitted[name], score = done.result()
            except Exception as error:  # one failing candidate must not stop the others
                failures[name] = (str(error).splitlines() or [type(error).__name__])[0]
                log(f"Model {name} failed: {failures[name]}")
                continue
            rows.append({"position": position, "model": name} | score)
            log(f"{name}: accuracy {score['accuracy']:.2f} % | MAE {score['mae']:.4f}")
    drop_table(spark, path)
    if not fitted:
        raise RuntimeError(f"All candidate models failed: {failures}")
    # At most one row per candidate.
    winner = min(rows, key=lambda r: (r["mae"], r["position"]))["model"]
    return Tournament(winner, fitted[winner], _metric_rows(frame, rows), failures)


def _metric_rows(frame: DataFrame, rows: list[dict]) -> DataFrame:
    schema = (
        "position int, model string, rows long, mae double, rmse double, wape double, "
        "accuracy double, mape double, smape double"
    )
    return frame.sparkSession.createDataFrame(rows, schema)
