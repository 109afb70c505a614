"""Whitening of embeddings by shifted CholeskyQR.

The rows to fit on are made distinct and centred. A pass multiplies the centred rows by the inverse of all factors so
far (a triangular solve per Arrow batch) and adds up their Gram matrix; its Cholesky factor, shifted where the matrix
is not safely positive, is composed with the factors before it. Passes end when the rows are orthonormal. The singular
value decomposition of the composed factor then has the components and their variances, without ever squaring the
condition of the rows. What leaves a task is one matrix of dimension x dimension, whatever its rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from shelfcast.session import drop_table, read_table, write_table

#: Entries become floor(SCALE * entry) + OFFSET; beyond 2^61 they are held there.
SCALE, OFFSET = 64, 1_000_000
HELD = float(2**61)
#: A row is orthonormal to the others once no entry of a pass's Gram matrix is further from the identity.
SETTLED = 1e-10
#: Singular values under this share of the largest are those of rounding: their directions are no components.
RANK = 1e-14
EPS = float(np.finfo(float).eps)


def usable(vector: Column) -> Column:
    """False for null vectors and for vectors with null or non-finite entries."""
    entry_ok = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False))
    return vector.isNotNull() & F.forall(vector, lambda e: entry_ok(e.cast("double")))


def quantise(vector: Column) -> Column:
    """The whole numbers that stand for a vector's entries."""
    held = lambda e: F.greatest(F.lit(-HELD), F.least(F.lit(HELD), e.cast("double") * F.lit(float(SCALE))))
    return F.transform(vector, lambda e: F.floor(held(e)) + F.lit(OFFSET))


def widened(vector: Column, dim: int) -> Column:
    """A vector continued to ``dim`` entries by what stands for 0."""
    return F.concat(vector, F.array_repeat(F.lit(OFFSET).cast("bigint"), F.greatest(F.lit(dim) - F.size(vector), F.lit(0))))


@dataclass(frozen=True)
class Whitening:
    """``whole`` + ``rest`` / ``n`` is the mean of each dimension, exactly; ``axes`` has a component in each row."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float
    passes: int

    @property
    def dim(self) -> int:
        return len(self.whole)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest.astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum)^2 for every row, exactly; null where it is no long."""
        apart = x - self.whole
        most = int(np.abs(apart).max(initial=0)) * self.n + self.n
        if most * most * max(self.dim, 1) < 2**63:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((apart.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.variances)[:, None]).T


def matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their list column as a matrix of whole numbers."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches):
    """Rows and exact sums of a task: halves of the entries are added apart, so that none overflows."""
    n, total = 0, None
    for _, x in matrices(batches):
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        part = high.astype(object) * 2**32 + low.astype(object)
        n, total = n + len(x), part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_pydict(
            {"at": list(range(len(total))), "n": [n] * len(total), "total": [Decimal(int(v)) for v in total]},
            schema=pa.schema([("at", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]),
        )


def _total(rows: DataFrame, work) -> np.ndarray | None:
    """``work`` gives a matrix for each batch; their sum over all rows, added row by row of the matrix."""

    def add(batches):
        total = None
        for _, x in matrices(batches):
            part = work(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"at": [i for i in range(total.shape[0]) for _ in range(total.shape[1])],
                 "to": list(range(total.shape[1])) * total.shape[0], "v": total.ravel()},
                schema=pa.schema([("at", pa.int32()), ("to", pa.int32()), ("v", pa.float64())]),
            )

    summed = rows.mapInArrow(add, "at int, to int, v double").groupBy("at", "to").agg(F.sum("v").alias("v")).toArrow()
    if not summed.num_rows:
        return None
    at, to, v = (summed.column(c).to_numpy() for c in ("at", "to", "v"))
    out = np.zeros((at.max() + 1, to.max() + 1))
    out[at, to] = v
    return out


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor in turn, by forward substitution over the columns."""
    for r in factors:
        out = np.empty_like(rows)
        for k in range(r.shape[0]):
            out[:, k] = (rows[:, k] - out[:, :k] @ r[:k, k]) / r[k, k]
        rows = out
    return rows


def orthogonalised(rows: DataFrame, base: "Whitening") -> tuple[np.ndarray, int]:
    """A matrix T with T'T = C'C for the centred rows C, and the number of passes.

    The first factor is shifted by 11 (n d + d (d + 1)) eps times the trace (at most a tenth of it), which is enough for
    any rows; later ones only if their Gram matrix is not positive. Directions that stay null end with the passes' last Gram.
    """
    factors: list[np.ndarray] = []
    dim = base.dim
    composed = np.eye(dim)
    for number in range(1, 64):
        gram = _total(rows, lambda x: (q := solved(base.centred(x), factors)).T @ q)
        gram = (gram + gram.T) / 2
        weights, axes = np.linalg.eigh(gram)
        tail = np.sqrt(np.maximum(weights, 0))[:, None] * (axes.T @ composed)
        norms = np.linalg.norm(tail, axis=1)
        null = norms <= RANK * dim * norms.max(initial=0)
        if number > 1 and (null | (np.abs(weights - 1) <= SETTLED)).all() or not norms.any():
            return tail, number
        shift = min(11.0 * (base.n * dim + dim * (dim + 1)) * EPS, 0.1) * np.trace(gram)
        if number > 1 and weights[0] > 4 * dim * EPS * weights[-1]:
            shift = 0.0
        factors = [*factors, np.linalg.cholesky(gram + shift * np.eye(dim)).T]
        composed = factors[-1] @ composed
    return tail, number


def fit(vectors: DataFrame, vector_col: str = "x", components: int = 16) -> Whitening | None:
    """Whitening of the distinct vectors (arrays of longs); None if there are none or they have no entries.

    Shorter vectors count as continued by zeros. Equal vectors count once: copies are combined in each task before the
    shuffle. Directions without variance are no components, so there may be fewer than asked, down to none for one
    vector. Rows are written once and read by each of some four passes and by the last, which measures the identity error.
    """
    spark = vectors.sparkSession
    dim = vectors.agg(F.max(F.size(vector_col))).first()[0]
    if not dim:
        return None
    distinct = vectors.select(widened(F.col(vector_col), dim).alias("x")).distinct()
    path = write_table(distinct, "whitening")
    rows = read_table(spark, path, distinct.schema)
    sums = rows.mapInArrow(_sums, "at int, n long, total decimal(38,0)").groupBy("at").agg(F.sum("n"), F.sum("total")).collect()
    n, totals = int(sums[0][1]), [int(total) for _, _, total in sorted(tuple(r) for r in sums)]
    whole, rest = np.array([t // n for t in totals], dtype=np.int64), np.array([t % n for t in totals], dtype=np.int64)
    base = Whitening(n, whole, rest, np.zeros((0, dim)), np.zeros(0), 0.0, 0.0, 0)
    factor, passes = orthogonalised(rows, base)
    _, values, axes = np.linalg.svd(factor)
    variances = values**2 / n
    taken = min(components, int((values > RANK * dim * values.max(initial=0)).sum()))
    found = Whitening(n, whole, rest, axes[:taken], variances[:taken], float(variances.sum()), 0.0, passes)
    if taken:
        mean = _total(rows, lambda x: found.whitened(x).sum(axis=0, keepdims=True))[0] / n
        gram = _total(rows, lambda x: (w := found.whitened(x) - mean).T @ w) / n
        found = Whitening(n, whole, rest, found.axes, found.variances, found.total, float(np.abs(gram - np.eye(taken)).max()), passes)
    drop_table(spark, path)
    return found


def whiten(rows: DataFrame, model: Whitening, vector_col: str = "x") -> DataFrame:
    """Rows with ``deviation`` long and ``whitened`` array<double> (one value per component); columns of these names are replaced."""
    kept = [c for c in rows.columns if c not in ("deviation", "whitened", vector_col)]
    wide = rows.select(widened(F.col(vector_col), model.dim).alias(vector_col), *[F.col(f"`{c}`") for c in kept])
    added = [StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    schema = StructType([*wide.schema.fields, *added])

    def apply(batches):
        for batch, x in matrices(batches):
            values = model.whitened(x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * values.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
            deviations = pa.array(model.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, deviations, lists], names=[*batch.schema.names, "deviation", "whitened"])

    return wide.mapInArrow(apply, schema)


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries get no rows. Repeated rows and null ids are rows like
    others. No usable vector, or no variance at all, gives no rows; other columns of the input are not read.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col)).alias("x"))
    model = fit(vectors, "x", components)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], ROWS)
    explained = F.array(*[F.lit(float(v / model.total)) for v in model.variances])
    return (
        whiten(vectors, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
        .select(
            "vec_id",
            (F.col("_at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("_at")).alias("explained"),
            F.lit(model.identity_error).alias("identity_error"),
        )
    )
