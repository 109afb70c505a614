"""Trees grown on Spark against trees grown by plain loops over the same rows."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import trees
from shelfcast.operators.trees import Ensemble, Growth, PoissonLoss, SquaredLoss

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    """Few values per feature, so that bins lose nothing; nulls, and a third of all rows equal."""
    rng = random.Random(7)
    rows = []
    for _ in range(500):
        a, b, c = rng.randint(0, 9), rng.choice((None, 0.5, 1.5, 2.5)), rng.randint(0, 30)
        rows.append((float(a), b, c, float(rng.randint(0, 4) + (9 if a > 5 else 0) + (c if b == 1.5 else 0))))
    rows += [(3.0, 0.5, 7, 2.0)] * 250
    return spark.createDataFrame(rows, "a double, b double, c int, y double").cache()


def table(frame):
    rows = [tuple(float("inf") if v is None else float(v) for v in r) for r in frame.collect()]
    return np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])


def greedy(x, g, h, growth):
    """Predicted value of every row by the tree whose best split by gain is always next."""
    leaves, values = 1, np.zeros(len(x))
    order = 0

    def best(rows):
        found = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min(len(left), len(right)) < growth.min_rows or min(h[left].sum(), h[right].sum()) < growth.min_weight:
                    continue
                gain = sum(growth.score(g[p].sum(), h[p].sum()) for p in (left, right)) - growth.score(g[rows].sum(), h[rows].sum())
                if gain / 2 > growth.least_gain + 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left, right)
        return found

    rows = np.arange(len(x))
    values[rows] = growth.value(g.sum(), h.sum())
    queue = []

    def push(rows, depth):
        nonlocal order
        if depth < growth.max_depth and len(rows) >= growth.min_split_rows and (found := best(rows)):
            heapq.heappush(queue, (-found[0], order, depth, found))
            order += 1

    push(rows, 0)
    while queue and (not growth.max_leaves or leaves < growth.max_leaves):
        _, _, depth, (_, left, right) = heapq.heappop(queue)
        leaves += 1
        for part in (left, right):
            values[part] = growth.value(g[part].sum(), h[part].sum())
            push(part, depth + 1)
    return values


GROWTHS = [
    Growth(max_depth=3),
    Growth(max_depth=4, min_rows=20, l2=0.5),
    Growth(max_depth=6, max_leaves=7, min_rows=5, l1=1.0, least_gain=0.2),
    Growth(max_depth=5, min_weight=40.0, min_split_rows=60, max_step=0.7),
]


@pytest.mark.parametrize("growth", GROWTHS)
@pytest.mark.parametrize("loss", [SquaredLoss(), PoissonLoss()])
def test_tree_is_the_greedy_one(frame, growth, loss):
    x, y = table(frame)
    trainer, start = trees.prepare(frame, FEATURES, "y", loss, bins=64, valid_share=0.0)
    try:
        (tree,), _ = trainer.grow(growth, [1])
    finally:
        trainer.close()
    g, h = loss.gradients(np.full(len(y), start), y)
    got = tree.value[tree.leaves_of(x, tree.threshold)]
    assert got == pytest.approx(greedy(x, g, h, growth), abs=1e-4)


def arrays(model):
    return [(t.feature.tolist(), t.threshold.tolist(), t.value.tolist()) for t in model.trees]


def test_same_trees_whatever_the_partitions(frame):
    growth = Growth(max_depth=4, rows=0.7, columns=0.67, min_weight=1.0)
    fitted = [
        trees.boost(part, FEATURES, "y", PoissonLoss(), growth, rounds=12, learning_rate=0.3, patience=3, valid_share=0.2)
        for part in (frame.coalesce(1), frame.repartition(7), frame.orderBy(F.rand(3)))
    ]
    assert arrays(fitted[0]) == arrays(fitted[1]) == arrays(fitted[2]) and len(fitted[0].trees) > 3


def test_boosting_equals_one_tree_after_another(frame):
    growth, loss = Growth(max_depth=3, min_rows=5), PoissonLoss()
    model = trees.boost(frame, FEATURES, "y", loss, growth, rounds=12, learning_rate=0.2, patience=99, valid_share=0.0)
    x, y = table(frame)
    margin = np.full(len(y), np.log(y.mean()))
    for _ in range(12):
        margin += 0.2 * greedy(x, *loss.gradients(margin, y), growth)
    got = {tuple(r[:3]): r.prediction for r in model.transform(frame.select(*FEATURES)).collect()}
    expected = {tuple(r[:3]): m for r, m in zip(frame.collect(), np.exp(margin))}
    assert all(got[k] == pytest.approx(v, rel=1e-3) for k, v in expected.items())


def test_early_stopping_keeps_the_best(frame):
    noisy = frame.withColumn("y", F.col("y") + F.pmod(F.xxhash64("a", "b", "c", "y"), F.lit(9)))
    model = trees.boost(noisy, FEATURES, "y", SquaredLoss(), Growth(max_depth=6), rounds=60, learning_rate=0.8, patience=3, valid_share=0.3)
    losses = model.notes["losses"]
    assert model.notes["kept"] == len(model.trees) == losses.index(min(losses)) and len(losses) == len(model.trees) + 4 < 61


def test_out_of_bag_error_equals_brute_force(frame):
    growth = Growth(max_depth=5, min_rows=2, min_split_rows=5, bootstrap=True, node_columns=1)
    model = trees.forest(frame, FEATURES, "y", growth, trees=9, side_by_side=4, seed=5)
    counted = frame.groupBy(*FEATURES, "y").agg(F.count("*").alias("w"))
    hashed = counted.select(F.xxhash64(*FEATURES, "y").alias("row"), *FEATURES, "y", "w").collect()
    x = np.array([[float("inf") if r[c] is None else float(r[c]) for c in FEATURES] for r in hashed])
    misses, rows, values = 0.0, 0, []
    for i, r in enumerate(hashed):
        row, w = np.array([r.row]), np.array([float(r.w)])
        out = [t for k, t in enumerate(model.trees) if trees.poisson(w, row, 6 + k)[0] == 0]
        if out:
            mean = np.mean([9 * t.value[t.leaves_of(x[i : i + 1], t.threshold)][0] for t in out])
            misses, rows = misses + r.w * (r.y - mean) ** 2, rows + r.w
            values += [r.y] * r.w
    assert model.notes["oob_rows"] == rows and model.notes["oob_mse"] == pytest.approx(misses / rows)
    assert model.notes["oob_score"] == pytest.approx(1 - misses / rows / np.var(values))


def test_draws():
    rows = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    u = trees.uniform(rows, 3)
    assert abs(u.mean() - 0.5) < 0.005 and 0 <= u.min() and u.max() < 1
    assert abs(np.corrcoef(u, trees.uniform(rows, 4))[0, 1]) < 0.01
    for mean in (1.0, 5.0, 500.0):
        drawn = trees.poisson(np.full(len(rows), mean), rows, 9)
        assert drawn.mean() == pytest.approx(mean, rel=0.02) and drawn.var() == pytest.approx(mean, rel=0.03)


def test_expression_and_saved_trees_predict_the_same(spark, frame, tmp_path):
    model = trees.boost(frame, FEATURES, "y", PoissonLoss(), Growth(max_depth=4), rounds=6, learning_rate=0.3, patience=9, valid_share=0.1)
    model.save(spark, str(tmp_path / "m"))
    again = Ensemble.load(spark, str(tmp_path / "m"))
    assert again.nodes(spark).count() == sum(len(t.feature) for t in model.trees)
    odd = spark.createDataFrame([(float("nan"), None, None), (1e300, -1e300, 5), (None, 2.5, 3)], "a double, b double, c int")
    for rows in (frame.select(*FEATURES), odd):
        both = again.transform(rows.withColumn("prediction", F.lit("old"))).withColumn("expression", model.column()).collect()
        assert all(r.prediction == pytest.approx(r.expression, rel=1e-12) for r in both) and both
    many = Ensemble(FEATURES, 0.0, False, model.trees * 200)
    plan = frame.select(many.column().alias("p"))._jdf.queryExecution().analyzed().toString()
    few = frame.select(Ensemble(FEATURES, 0.0, False, model.trees[:1]).column().alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == few.count("aggregate(")


def test_no_rows_and_constant_rows(spark, frame):
    empty = trees.boost(frame.limit(0), FEATURES, "y", PoissonLoss(), Growth(), rounds=3, learning_rate=0.1, patience=1, valid_share=0.1)
    assert empty.transform(frame.limit(2)).count() == 2
    one = frame.limit(40).withColumn("y", F.lit(4.0))
    flat = trees.boost(one, FEATURES, "y", SquaredLoss(), Growth(), rounds=3, learning_rate=0.1, patience=2, valid_share=0.1)
    assert {round(r.prediction, 9) for r in flat.transform(one).collect()} == {4.0}
