"""Tree ensembles grown on Spark, and trees as rows of a table.

Rows are written once as bins (a byte per feature) with their label, hash and count. To grow a level, every task adds up
histograms of gradients for the open nodes; one shuffle brings those of a node and feature together, and its best split
comes back as one row. The driver holds trees and splits, whose number depends on parameters alone. All draws come from
the row's hash and the tree's number, and gradients are whole multiples of a unit, so that sums are exact: the same rows
give the same trees, whatever the partitions, the order or a task's repetition.
"""

import heapq
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfcast.operators.forecasting import align
from shelfcast.session import drop_table, read_table, write_table

#: Histograms that one job makes at most: nodes times features.
HISTOGRAMS = 8192
#: Trees whose values are added to the written margins in passing, until the margins are written again.
PENDING = 10
VALIDATION = 0
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value double"


def uniform(row: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) from a row's hash and a seed (the SplitMix64 finalizer)."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def poisson(mean: np.ndarray, row: np.ndarray, seed: int) -> np.ndarray:
    """How often each of ``mean`` equal rows together is drawn with replacement, by the row's hash."""
    u = uniform(row, seed)
    small = mean <= 64
    out = np.zeros(len(mean))
    term = np.exp(-np.where(small, mean, 0.0))
    below, k = term.copy(), 0
    while (more := small & (u >= below) & (k < 200)).any():
        k += 1
        term = term * mean / k
        below = below + term
        out[more] = k
    if not small.all():
        normal = np.sqrt(-2 * np.log(np.maximum(u, 1e-300))) * np.cos(2 * np.pi * uniform(row, seed + 2**32))
        out = np.where(small, out, np.maximum(np.rint(mean + np.sqrt(mean) * normal), 0))
    return out


@dataclass
class Tree:
    """Arrays over the nodes: feature (-1 at a leaf), bin and threshold (values up to it go left), children, value."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves_of(self, bins: np.ndarray, limits: np.ndarray | None = None) -> np.ndarray:
        """The node where each row ends; rows are bins, or values if ``limits`` (the thresholds) are given."""
        limits = self.bin if limits is None else limits
        node, rows = np.zeros(len(bins), dtype=np.int32), np.arange(len(bins))
        while (inner := self.feature[node] >= 0).any():
            rows_in = rows[inner]
            at = node[rows_in]
            down = bins[rows_in, self.feature[at]] <= limits[at]
            node[rows_in] = np.where(down, self.left[at], self.right[at])
        return node


@dataclass(frozen=True)
class Growth:
    """How trees are grown. ``columns``: share of the features for a tree, or ``node_columns`` of them for each node."""

    max_depth: int = 6
    max_leaves: int = 0
    min_rows: int = 1
    min_split_rows: int = 2
    min_weight: float = 0.0
    l2: float = 0.0
    l1: float = 0.0
    least_gain: float = 0.0
    max_step: float = math.inf
    rows: float = 1.0
    bootstrap: bool = False
    columns: float = 1.0
    node_columns: int = 0

    def score(self, g, h):
        """Twice what a node takes off the loss."""
        return np.maximum(np.abs(g) - self.l1, 0) ** 2 / np.maximum(h + self.l2, 1e-12)

    def value(self, g, h):
        step = -np.sign(g) * np.maximum(np.abs(g) - self.l1, 0) / np.maximum(h + self.l2, 1e-12)
        return np.clip(step, -self.max_step, self.max_step)

    def drawn(self, w: np.ndarray, row: np.ndarray, seed: int) -> np.ndarray:
        if self.bootstrap:
            return poisson(w, row, seed)
        return w if self.rows >= 1 else np.floor(w * self.rows + uniform(row, seed))


@dataclass(frozen=True)
class SquaredLoss:
    log_link = False

    def gradients(self, margin, y):
        return margin - y, np.ones_like(y)

    def loss(self, margin, y):
        return (margin - y) ** 2

    def start(self, mean: float) -> float:
        return mean


@dataclass(frozen=True)
class PoissonLoss:
    """Deviance of counts with a log link; the second derivative is widened by the largest step, as steps are bounded by it."""

    max_step: float = 0.7
    log_link = True

    def gradients(self, margin, y):
        mean = np.exp(margin)
        return mean - y, mean * math.exp(self.max_step)

    def loss(self, margin, y):
        return np.exp(margin) - y * margin

    def start(self, mean: float) -> float:
        return math.log(max(mean, 1e-6))


def fit_edges(frame: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cut points of every feature from one pass: all values if they are few, else quantiles. A bin is (edge before, edge]."""
    shares = [k / bins for k in range(1, bins)]
    row = frame.agg(*[F.percentile_approx(c, shares, 20 * bins).alias(c) for c in features]).first()
    return [np.unique(np.asarray(row[c] if row[c] is not None else [], dtype=float)) for c in features]


def bin_rows(frame: DataFrame, features: Sequence[str], label: str, edges: Sequence[np.ndarray]) -> DataFrame:
    """``bins`` (binary), ``y``, ``row`` (hash) and ``w`` for every distinct row of features and label; w counts equal ones.

    Null and NaN are in the last bin, so they go right at every split.
    """
    counted = align(frame, features, (label,)).groupBy(*features, label).agg(F.count("*").alias("w"))
    values = counted.select(
        F.col(label).cast("double").alias("y"), F.xxhash64(*features, label).alias("row"), F.col("w").cast("double"), *[F.col(c).cast("double") for c in features]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]]
            cells = np.column_stack([np.searchsorted(e, c.astype(float)) for e, c in zip(edges, columns)]).astype(np.uint8)
            rows = pa.array([r.tobytes() for r in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[:3]], names=["bins", "y", "row", "w"])

    return values.mapInArrow(cut, "bins binary, y double, row long, w double")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


@dataclass
class Open:
    """A node that may be split."""

    tree: int
    node: int
    depth: int
    features: np.ndarray


@dataclass
class Grown:
    """A tree while it grows: nodes as lists, and the best split of each."""

    rows: list[list] = field(default_factory=lambda: [[-1, 0, 0.0, -1, -1, 0.0]])
    gains: dict[int, float] = field(default_factory=dict)
    depths: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, threshold: float, left: float, right: float, gain: float) -> None:
        at = len(self.rows)
        self.rows[node][:5] = [feature, cut, threshold, at, at + 1]
        self.rows += [[-1, 0, 0.0, -1, -1, left], [-1, 0, 0.0, -1, -1, right]]
        self.depths += [self.depths[node] + 1] * 2
        self.gains[node] = gain

    def within(self, leaves: int) -> set[int]:
        """Nodes split when the split of largest gain is always next, until there are so many leaves."""
        queue, chosen = [(-self.gains[0], 0)] if 0 in self.gains else [], set()
        while queue and len(chosen) < leaves - 1:
            _, node = heapq.heappop(queue)
            chosen.add(node)
            for child in self.rows[node][3:5]:
                if child in self.gains:
                    heapq.heappush(queue, (-self.gains[child], child))
        return chosen

    def tree(self, leaves: int = 0) -> Tree:
        chosen = self.within(leaves) if leaves else set(self.gains)
        columns = [np.array(c) for c in zip(*self.rows)]
        whole = Tree(columns[0].astype(np.int32), columns[1].astype(np.int32), columns[2].astype(float), columns[3].astype(np.int32), columns[4].astype(np.int32), columns[5].astype(float))
        whole.feature[[n for n in range(len(self.rows)) if n not in chosen]] = -1
        return whole


class Trainer:
    """Rows as bins with their margins, and the jobs over them."""

    def __init__(self, spark: SparkSession, base: DataFrame, edges, loss, start: float, valid_share: float, unit: float):
        self.spark, self.edges, self.loss, self.valid_share, self.unit = spark, edges, loss, valid_share, unit
        self.schema = StructType([*base.schema.fields, StructField("margin", DoubleType())])
        self.path, self.pending = write_table(base.withColumn("margin", F.lit(float(start))), "boosting"), []

    def table(self) -> DataFrame:
        return read_table(self.spark, self.path, self.schema)

    def add(self, tree: Tree) -> None:
        self.pending.append(tree)
        if len(self.pending) == PENDING:
            self.write_margins()

    def write_margins(self) -> None:
        width, pending, names = len(self.edges), self.pending, self.schema.names

        def added(batches):
            for batch in batches:
                margin = margins(batch, matrix(batch.column(0), width), pending)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], names=names)

        newer = write_table(self.table().mapInArrow(added, self.schema), "boosting")
        drop_table(self.spark, self.path)
        self.path, self.pending = newer, []

    def close(self) -> None:
        drop_table(self.spark, self.path)

    def splits(self, growth: Growth, grown: list[Grown], seeds: list[int], opened: list[Open]) -> tuple[list[tuple | None], float | None]:
        """Best split of every open node, and the mean loss of the validation rows before these trees."""
        found: list[tuple | None] = [None] * len(opened)
        loss = None
        per_job = max(1, HISTOGRAMS // max(1, len(opened[0].features)))
        for at in range(0, len(opened), per_job):
            part = opened[at : at + per_job]
            for slot, *best in self._job(growth, grown, seeds, part):
                if slot < 0:
                    loss = best[1] / best[2] if best[2] else None
                    continue
                now = found[at + slot]
                if now is None or (best[1], -best[0]) > (now[1], -now[0]):
                    found[at + slot] = tuple(best)
        return found, loss

    def _job(self, growth: Growth, grown: list[Grown], seeds: list[int], part: list[Open]) -> list[tuple]:
        width, loss, pending, share, unit = len(self.edges), self.loss, self.pending, self.valid_share, self.unit
        cells = max(len(e) for e in self.edges) + 1
        wanted = sorted({o.tree for o in part})
        trees = {t: grown[t].tree() for t in wanted}
        slots = {t: np.full(len(grown[t].rows), -1) for t in wanted}
        for slot, o in enumerate(part):
            slots[o.tree][o.node] = slot
        features = np.array([o.features for o in part])

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((features.shape[1], 3, len(part) * cells))
            lost, counted = 0.0, 0.0
            for batch in batches:
                bins = matrix(batch.column(0), width)
                y, row, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                margin = margins(batch, bins, pending)
                valid = np.floor(w * share + uniform(row, VALIDATION)) if share else np.zeros(len(w))
                lost, counted = lost + float(np.rint(valid * loss.loss(margin, y) * unit).sum()), counted + float(valid.sum())
                g, h = loss.gradients(margin, y)
                for t in wanted:
                    taken = growth.drawn(w - valid, row, seeds[t])
                    slot = slots[t][trees[t].leaves_of(bins)]
                    keep = np.flatnonzero((slot >= 0) & (taken > 0))
                    at, n = slot[keep], taken[keep]
                    weights = np.rint(g[keep] * n * unit), np.rint(h[keep] * n * unit), n
                    own = bins[keep]
                    for k in range(features.shape[1]):
                        cell = at * cells + own[np.arange(len(keep)), features[at, k]]
                        for m in range(3):
                            total[k, m] += np.bincount(cell, weights[m], minlength=len(part) * cells)
            split = total.reshape(features.shape[1], 3, len(part), cells).transpose(2, 0, 1, 3)
            some = np.flatnonzero(split[:, 0, 2].sum(axis=1))
            blobs = [m.tobytes() for s in some for m in split[s]]
            yield pa.RecordBatch.from_pydict(
                {
                    "slot": [-1, *np.repeat(some, features.shape[1]).tolist()],
                    "feature": [-1, *features[some].ravel().tolist()],
                    "sums": [np.array([lost / unit, counted]).tobytes(), *blobs],
                },
                schema=schema,
            )

        schema = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for s, f, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    one = np.frombuffer(blob)
                    sums[s, f] = sums[s, f] + one if (s, f) in sums else one
            out = []
            for (s, f), v in sums.items():
                if s < 0:
                    out.append((s, f, float(v[0]), float(v[1]), 0, 0.0, 0.0, 0.0, 0.0))
                    continue
                g, h, n = v.reshape(3, cells) / np.array([[unit], [unit], [1.0]])
                gl, hl, nl = g.cumsum()[:-1], h.cumsum()[:-1], n.cumsum()[:-1]
                gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
                gain = (growth.score(gl, hl) + growth.score(gr, hr) - growth.score(g.sum(), h.sum())) / 2
                ok = (np.minimum(nl, nr) >= growth.min_rows) & (np.minimum(hl, hr) >= growth.min_weight) & (gain > growth.least_gain + 1e-12)
                if n.sum() < growth.min_split_rows or not ok.any():
                    out.append((s, f, -1.0, 0.0, -1, g.sum(), h.sum(), 0.0, 0.0))
                    continue
                cut = int(np.where(ok, gain, -np.inf).argmax())
                out.append((s, f, float(gain[cut]), float(n.sum()), cut, float(gl[cut]), float(hl[cut]), float(gr[cut]), float(hr[cut])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        names = ["slot", "feature", "gain", "rows", "cut", "gl", "hl", "gr", "hr"]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.float64()] * 4]
        made = self.table().mapInArrow(histograms, "slot int, feature int, sums binary").repartition(F.col("slot"), F.col("feature"))
        back = made.mapInArrow(best, "slot int, feature int, gain double, rows double, cut int, gl double, hl double, gr double, hr double")
        return [tuple(r) for r in back.collect()]

    def grow(self, growth: Growth, seeds: list[int], start_values: bool = True) -> tuple[list[Tree], float | None]:
        """Trees grown side by side, level by level, each on its own draw of rows; and the validation loss before them."""
        width, grown = len(self.edges), [Grown() for _ in seeds]

        def features_of(tree: int, node: int) -> np.ndarray:
            many = growth.node_columns or max(1, round(growth.columns * width))
            if many >= width:
                return np.arange(width)
            rng = np.random.default_rng([seeds[tree], node if growth.node_columns else 0])
            return np.sort(rng.choice(width, many, replace=False))

        opened, loss = [Open(t, 0, 0, features_of(t, 0)) for t in range(len(seeds))], None
        while opened:
            found, seen = self.splits(growth, grown, seeds, opened)
            loss = seen if opened[0].depth == 0 else loss
            after = []
            for o, best in zip(opened, found):
                own = grown[o.tree]
                if best is None:
                    continue
                feature, gain, _, cut, gl, hl, gr, hr = best
                if cut < 0:
                    if o.node == 0:
                        own.rows[0][5] = float(growth.value(gl, hl))
                    continue
                if o.node == 0:
                    own.rows[0][5] = float(growth.value(gl + gr, hl + hr))
                own.split(o.node, feature, cut, float(self.edges[feature][cut]), float(growth.value(gl, hl)), float(growth.value(gr, hr)), gain)
                if o.depth + 1 < growth.max_depth:
                    after += [(o.tree, child) for child in own.rows[o.node][3:5]]
            if growth.max_leaves:
                # A split that so many better ones precede now is preceded by as many when the tree is whole.
                chosen = [g.within(growth.max_leaves) for g in grown]
                parents = [{c: n for n in g.gains for c in g.rows[n][3:5]} for g in grown]
                after = [(t, n) for t, n in after if parents[t][n] in chosen[t]]
            opened = [Open(t, n, grown[t].depths[n], features_of(t, n)) for t, n in after]
        return [g.tree(growth.max_leaves) for g in grown], loss


def margins(batch: pa.RecordBatch, bins: np.ndarray, pending: Sequence[Tree]) -> np.ndarray:
    margin = batch.column(4).to_numpy(zero_copy_only=False).copy()
    for tree in pending:
        margin += tree.value[tree.leaves_of(bins)]
    return margin


@dataclass
class Ensemble:
    """Trees with a start, a link and the names of their features: ``start`` + the sum of the trees' values."""

    features: list[str]
    start: float
    log_link: bool
    trees: list[Tree]
    notes: dict = field(default_factory=dict)

    def transform(self, frame: DataFrame) -> DataFrame:
        """``frame`` with a ``prediction``: its features leave for Python as Arrow batches, all trees walked at once for a batch."""
        own = [c for c in frame.columns if c != "prediction"]
        schema = StructType([*frame.select(*own).schema.fields, StructField("prediction", DoubleType())])
        places, trees, start, log_link = [own.index(c) for c in self.features], self.trees, self.start, self.log_link

        def score(batches):
            for batch in batches:
                values = np.column_stack([batch.column(p).cast(pa.float64()).to_numpy(zero_copy_only=False) for p in places])
                total = np.full(len(values), start)
                for tree in trees:
                    total += tree.value[tree.leaves_of(values, tree.threshold)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.exp(total) if log_link else total)], schema=arrow(batch))

        def arrow(batch):
            return batch.schema.append(pa.field("prediction", pa.float64()))

        return frame.select(*own).mapInArrow(score, schema)

    def column(self) -> Column:
        """The prediction as one Spark expression: flat arrays of nodes, one literal whatever the number of trees.

        Slower for many trees than ``transform``, but free of Python.
        """
        offsets = np.cumsum([0, *[len(t.feature) for t in self.trees]]).tolist()
        flat = {"f": [], "t": [], "l": [], "r": [], "v": [], "roots": offsets[:-1]}
        for at, tree in zip(offsets, self.trees):
            flat["f"] += tree.feature.tolist()
            flat["t"] += tree.threshold.tolist()
            flat["l"] += (tree.left + at).tolist()
            flat["r"] += (tree.right + at).tolist()
            flat["v"] += tree.value.tolist()
        deepest = max((depth_of(t) for t in self.trees), default=0)
        schema = "f array<int>, t array<double>, l array<int>, r array<int>, v array<double>, roots array<int>"
        nodes = F.from_json(F.lit(json.dumps(flat)), schema)
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features])

        def step(node, _):
            feature = F.get(nodes["f"], node)
            left = F.get(values, feature) <= F.get(nodes["t"], node)
            return F.when(feature < 0, node).when(left, F.get(nodes["l"], node)).otherwise(F.get(nodes["r"], node))

        steps = F.sequence(F.lit(1), F.lit(max(deepest, 1)))
        total = F.aggregate(nodes["roots"], F.lit(float(self.start)), lambda sum_, root: sum_ + F.get(nodes["v"], F.aggregate(steps, root, step)))
        return F.exp(total) if self.log_link else total

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as rows, one per node."""
        columns = {
            "tree": np.concatenate([np.full(len(t.feature), i, np.int32) for i, t in enumerate(self.trees)] or [np.zeros(0, np.int32)]),
            "node": np.concatenate([np.arange(len(t.feature), dtype=np.int32) for t in self.trees] or [np.zeros(0, np.int32)]),
        }
        for name, kind in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float)):
            columns[name] = np.concatenate([getattr(t, name) for t in self.trees] or [np.zeros(0)]).astype(kind)
        return spark.createDataFrame(pa.table(columns), NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        head = {"features": self.features, "start": self.start, "log_link": self.log_link, "notes": self.notes, "trees": len(self.trees)}
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/ensemble")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ensemble":
        head = json.loads(spark.read.text(f"{path}/ensemble").first()[0])
        rows = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").orderBy("tree", "node").toArrow()
        tree = rows.column("tree").to_numpy()
        bounds = np.searchsorted(tree, np.arange(head["trees"] + 1))
        column = {n: rows.column(n).to_numpy() for n in ("feature", "threshold", "left", "right", "value")}
        trees = [
            Tree(column["feature"][a:b], np.zeros(b - a, np.int32), column["threshold"][a:b], column["left"][a:b], column["right"][a:b], column["value"][a:b])
            for a, b in zip(bounds[:-1], bounds[1:])
        ]
        return cls(head["features"], head["start"], head["log_link"], trees, head["notes"])


def depth_of(tree: Tree) -> int:
    depth, level = 0, np.array([0])
    while len(level := level[tree.feature[level] >= 0]):
        level = np.concatenate([tree.left[level], tree.right[level]])
        depth += 1
    return depth


def prepare(frame: DataFrame, features: Sequence[str], label: str, loss, *, bins: int, valid_share: float) -> tuple[Trainer, float]:
    """Bins and the start; the unit of gradients is such that all sums stay exact."""
    frame = align(frame, features, (label,))
    edges = fit_edges(frame, features, bins)
    base = bin_rows(frame, features, label, edges)
    n, total, most = frame.agg(F.count("*"), F.sum(F.col(label).cast("double")), F.sum(F.abs(F.col(label).cast("double")))).first()
    start = loss.start((total or 0.0) / n if n else 0.0)
    unit = 2.0 ** min(20, math.floor(48 - math.log2((most or 0.0) + (n or 0) + 1)))
    return Trainer(frame.sparkSession, base, edges, loss, start, valid_share, unit), start


def boost(
    frame: DataFrame, features: Sequence[str], label: str, loss, growth: Growth,
    *, rounds: int, learning_rate: float, patience: int, valid_share: float, tolerance: float = 0.0, bins: int = 64, seed: int = 42,
) -> Ensemble:
    """Trees one after another, each on the gradients that those before it leave.

    The loss of the validation rows comes with the first job of the next tree. Boosting stops when it has not
    improved by ``tolerance`` for ``patience`` trees, and keeps the trees up to the best.
    """
    trainer, start = prepare(frame, features, label, loss, bins=bins, valid_share=valid_share)
    trees: list[Tree] = []
    losses: list[float | None] = []
    best, kept = math.inf, 0
    try:
        for number in range(rounds + 1):
            if number == rounds:  # only to see the loss of the last tree
                _, seen = trainer.splits(Growth(max_depth=1), [Grown()], [seed], [Open(0, 0, 0, np.arange(1))]) if trees and valid_share else ([], None)
            else:
                (tree,), seen = trainer.grow(growth, [seed + 1 + number])
            losses.append(seen)
            if seen is None:
                kept = len(trees)
            elif seen < best - tolerance:
                best, kept = seen, len(trees)
            elif len(trees) - kept >= patience:
                break
            if number < rounds:
                tree.value = tree.value * learning_rate
                trees.append(tree)
                trainer.add(tree)
    finally:
        trainer.close()
    return Ensemble(list(features), start, loss.log_link, trees[:kept], {"rounds": len(trees), "kept": kept, "losses": losses})


def forest(
    frame: DataFrame, features: Sequence[str], label: str, growth: Growth, *, trees: int, side_by_side: int = 25, bins: int = 64, seed: int = 42
) -> Ensemble:
    """Trees on bootstrap draws, and how well rows are predicted by the trees that did not draw them (``oob_*`` notes).

    A tree's draw is a function of the row's hash and the tree's number, so the rows out of its bag are found again without
    having been kept. Equal rows share a draw: they are out of the bag together, and none is predicted by a copy of itself.
    """
    trainer, _ = prepare(frame, features, label, SquaredLoss(), bins=bins, valid_share=0.0)
    seeds = [seed + 1 + t for t in range(trees)]
    try:
        zero = trainer.table().withColumn("margin", F.lit(0.0))
        newer = write_table(zero, "boosting")
        drop_table(trainer.spark, trainer.path)
        trainer.path = newer
        grown: list[Tree] = []
        for at in range(0, trees, side_by_side):
            grown += trainer.grow(growth, seeds[at : at + side_by_side])[0]
        notes = out_of_bag(trainer.table(), growth, grown, seeds, len(features))
    finally:
        trainer.close()
    for tree in grown:
        tree.value = tree.value / max(trees, 1)
    return Ensemble(list(features), 0.0, False, grown, notes)


def out_of_bag(table: DataFrame, growth: Growth, grown: list[Tree], seeds: list[int], width: int) -> dict:
    """Rows with a tree that did not draw them, their mean squared error, and the share of variance that is explained."""

    def errors(batches):
        sums = np.zeros(4)
        for batch in batches:
            bins = matrix(batch.column(0), width)
            y, row, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            total, out = np.zeros(len(y)), np.zeros(len(y))
            for tree, seed in zip(grown, seeds):
                free = growth.drawn(w, row, seed) == 0
                total[free] += tree.value[tree.leaves_of(bins[free])]
                out += free
            seen = out > 0
            miss = y[seen] - total[seen] / out[seen]
            n = w[seen]
            sums += [n.sum(), (n * miss * miss).sum(), (n * y[seen]).sum(), (n * y[seen] ** 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums], names=["n", "miss", "y", "yy"])

    row = table.mapInArrow(errors, "n double, miss double, y double, yy double").agg(*[F.sum(c) for c in ("n", "miss", "y", "yy")]).first()
    n, miss, y, yy = (v or 0.0 for v in row)
    spread = yy - y * y / n if n else 0.0
    return {"oob_rows": n, "oob_mse": miss / n if n else None, "oob_score": 1 - miss / spread if spread > 0 else None}
