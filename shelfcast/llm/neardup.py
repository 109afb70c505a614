"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Unit vectors with cosine >= c lie within sqrt(2 - 2c) of each other. Vectors of a label are dealt to cells around
well-spread centers, and cells to blocks of bounded size; two cells meet only if their covering radii bridge
the distance of their centers. Inside a pair of blocks, two cover trees (nested levels, each with half the radius
of the one above) are descended together, level by level: a pair of nodes goes on if the distance of its centers less both
covering radii is within the threshold. What is left at the leaves is compared exactly.

Equal vectors are one class and enter once. Only counts and a spanning forest of the links leave a task, never all pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.graph import components
from shelfcast.session import materialize

#: Vectors of a cell on average, and of a block at most (by salts; about); vectors from which a label's centers are chosen.
CELL, BLOCK, SAMPLE, CENTERS = 1024, 2048, 1024, 256
RADII = (1.0, 0.5, 0.25, 0.125)
#: Room for rounding in bounds.
SLACK = 1e-9


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_centers(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k centers, each the farthest from those before: nested nets of falling radius."""
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < k and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return np.array(chosen)


def cover_tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: center of each node, covering radius of each node, node of each vector. A level refines the one above."""
    levels, node = [], np.zeros(len(x), np.int64)
    for r in RADII:
        own, centers, below = np.full(len(x), -1), [], np.argsort(node, kind="stable")
        for part in np.split(below, np.flatnonzero(np.diff(node[below])) + 1):
            left = part
            while len(left):
                near = np.linalg.norm(x[left] - x[left[0]], axis=1) <= r
                own[left[near]] = len(centers)
                centers.append(left[0])
                left = left[~near]
        node, c = own, x[np.array(centers, np.int64)]
        radius = np.zeros(len(c))
        np.maximum.at(radius, node, np.linalg.norm(x - c[node], axis=1))
        levels.append((c, radius, node))
    return levels


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Matrix of the pairs with at least this cosine, by descending both trees together."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    a, b, alive = cover_tree(x), cover_tree(y) if y is not x else None, None
    b = b or a
    for (ca, ra, na), (cb, rb, nb), up in zip(a, b, [None, *zip(a, b)]):
        distance = np.sqrt(np.maximum(0.0, 2 - 2 * (ca @ cb.T)))
        open_ = distance - ra[:, None] - rb[None, :] <= reach + 1e-7
        if alive is not None:
            pa_, pb = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
            pa_[na], pb[nb] = up[0][2], up[1][2]
            open_ &= alive[pa_][:, pb]
        alive = open_
    out = np.zeros((len(x), len(y)), bool)
    rows = np.flatnonzero(alive.any(axis=1)[na])
    step = max(1, 4_000_000 // max(1, len(y)))
    for i in range(0, len(rows), step):
        at = rows[i : i + step]
        out[at] = alive[na[at]][:, nb] & (x[at] @ y.T >= cosine)
    return out


def _sound(v: Column) -> Column:
    """No null, NaN or infinite component, and not all zero."""
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return v.isNotNull() & good & F.exists(v, lambda e: e != 0)


def _centers_of(table: pa.Table) -> pa.Table:
    t = table.sort_by("rep")
    x = unit(t.column("v").to_pylist())
    k = min(CENTERS, max(1, -(-t.column("n")[0].as_py() // CELL)))
    c = x[spread_centers(x, k)]
    return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "centers": pa.array([c.tobytes()], pa.binary())})


def _cells_of(left: pa.Table, right: pa.Table) -> pa.Table:
    """Nearest center and distance to it, for the vectors of one salt."""
    x = unit(left.column("v").to_pylist()) if left.num_rows else np.zeros((0, 1))
    if not left.num_rows:
        cell, far = np.zeros(0, np.int32), np.zeros(0)
    else:
        c = np.frombuffer(right.column("centers")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        cell = (x @ c.T).argmax(axis=1).astype(np.int32)
        far = np.linalg.norm(x - c[cell], axis=1)
    names = ["label", "dim", "rep", "m", "v"]
    return pa.table([*(left.column(n) for n in names), pa.array(cell), pa.array(far)], [*names, "cell", "far"])


def _near_cells(cosine: float):
    def pairs(left: pa.Table) -> pa.Table:
        """Pairs of a label's cells (at most CENTERS) whose covering radii bridge the distance of their centers."""
        t = left.sort_by("cell")
        c = np.frombuffer(t.column("centers")[0].as_py(), np.float64)
        c = c.reshape(-1, t.column("dim")[0].as_py())[t.column("cell").to_numpy()]
        r, blocks, cell = t.column("radius").to_numpy(), t.column("blocks").to_pylist(), t.column("cell").to_pylist()
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T))) - r[:, None] - r[None, :]
        i, j = np.nonzero(np.triu(gap <= math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7))
        out = [(cell[a], cell[b], blocks[a], blocks[b]) for a, b in zip(i.tolist(), j.tolist())]
        label, dim = t.column("label")[0].as_py(), t.column("dim")[0].as_py()
        cols = list(zip(*out))
        return pa.table(
            [pa.array([label] * len(out), pa.int64()), pa.array([dim] * len(out), pa.int32()), *(pa.array(x, pa.int32()) for x in cols)], ["label", "dim", "c1", "c2", "n1", "n2"]
        )

    return pairs


def _compared(cosine: float):
    def pair(t: pa.Table) -> pa.Table:
        """Links in one pair of blocks: per vector its count, and the smallest id that it is connected to here."""
        side, m, rep = t.column("side").to_numpy(), t.column("m").to_numpy(), t.column("rep").to_numpy()
        x = unit(t.column("v").to_pylist())
        if (side == 2).all():  # a block with itself
            hit = linked(x, x, cosine)
            np.fill_diagonal(hit, False)
            hit |= hit.T
            counts, low = hit @ m, rep.copy()
            ids_a = ids_b = rep
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            hit = linked(x[a], x[b], cosine) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
            counts, low = np.zeros(len(rep), np.int64), rep.copy()
            counts[a], counts[b] = hit @ m[b], hit.T @ m[a]
            ids_a, ids_b = a, b
        i, j = np.nonzero(hit)
        if side[0] != 2 or not (side == 2).all():
            i, j = ids_a[i], ids_b[j]
        while len(i):
            before = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (before == low).all():
                break
        on = counts > 0
        return pa.table([pa.array(rep[on]), pa.array(counts[on].astype(np.int64)), pa.array(low[on])], ["rep", "n", "low"])

    return pair


def near_duplicates(
    rows: DataFrame, *, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept (id = component).

    Rows link if their labels are equal and not null, their vectors equally long, and the cosine in double precision
    is at least ``cosine``. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    as do rows with a null id (kept is null then). Repeated ids are separate rows. An empty table gives no rows.

    Rows of a label meet in pairs of blocks of about ``BLOCK`` classes, unless their cells are too far apart.
    """
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    base = base.withColumn("ok", _sound(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    key = [F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.col("v")).alias("v")]
    grouped = base.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = materialize(grouped.withColumn("dim", F.size("v")), "vectors")
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("rep"), "rep")
    sample = classes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).join(counts, ["label", "dim"])
    centers = materialize(
        sample.select("label", "dim", "rep", "v", "n").groupBy("label", "dim").applyInArrow(_centers_of, "label long, dim int, centers binary"), "centers"
    )
    salts = F.ceil(F.col("n") / (4 * CELL)).cast("int")
    dealt = classes.join(counts, ["label", "dim"]).withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    copies = centers.join(counts, ["label", "dim"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    vector = classes.schema["v"].dataType.simpleString()
    cells = materialize(
        dealt.select("label", "dim", "salt", "rep", "m", "v")
        .groupBy("label", "dim", "salt")
        .cogroup(copies.select("label", "dim", "salt", "centers").groupBy("label", "dim", "salt"))
        .applyInArrow(_cells_of, f"label long, dim int, rep long, m long, v {vector}, cell int, far double"),
        "cells",
    )
    stats = cells.groupBy("label", "dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    stats = stats.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    near = stats.join(centers, ["label", "dim"]).groupBy("label", "dim").applyInArrow(_near_cells(cosine), "label long, dim int, c1 int, c2 int, n1 int, n2 int")
    near = materialize(near, "cell-pairs")
    blocked = cells.join(stats.drop("radius"), ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    one, two = F.col("cell") == F.col("c1"), F.col("cell") == F.col("c2")
    at = blocked.join(near, (blocked["label"] == near["label"]) & (blocked["dim"] == near["dim"]) & (one | two)).select(
        blocked["label"], blocked["dim"], "cell", "block", "rep", "m", "v", "c1", "c2", "n1", "n2"
    )
    side_one = F.transform(F.sequence(F.lit(0), F.col("n2") - 1), lambda o: F.struct(F.col("block").alias("b1"), o.alias("b2"), F.lit(0).alias("side")))
    side_two = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda o: F.struct(o.alias("b1"), F.col("block").alias("b2"), F.lit(1).alias("side")))
    within = F.transform(
        F.sequence(F.lit(0), F.col("n1") - 1),
        lambda o: F.struct(
            F.least(o, F.col("block")).alias("b1"),
            F.greatest(o, F.col("block")).alias("b2"),
            F.when(o == F.col("block"), 2).when(F.col("block") < o, 0).otherwise(1).alias("side"),
        ),
    )
    meets = F.when(F.col("c1") == F.col("c2"), within).when(one, side_one).otherwise(side_two)
    spread = at.withColumn("p", F.explode(meets)).select("label", "dim", "c1", "c2", "p.b1", "p.b2", "p.side", "rep", "m", "v")
    found = materialize(
        spread.groupBy("label", "dim", "c1", "c2", "b1", "b2").applyInArrow(_compared(cosine), "rep long, n long, low long"), "vector-links"
    )
    totals = found.groupBy("rep").agg(F.sum("n").alias("others"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    result = (
        classes.join(totals, "rep", "left")
        .join(reached, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("l"),
            F.col("v").alias("w"),
            (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    keyed = base.select("vec_id", *key)
    out = keyed.join(result, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
