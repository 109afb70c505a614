"""Quality of documents: random-indexing word vectors, pooled, and a small network with calibrated probabilities.

Every token has a sparse random index vector, drawn from a hash. The vector of a word (one of ``SLOTS`` hashed slots) is
the sum of the index vectors of its neighbours in the training sample. A document is the mean of its tokens'
word vectors, index vectors and shapes, with its length and variety. A network of two layers scores it; a
temperature chosen on rows left out of the training makes its probabilities honest.

The sample is bounded (``SAMPLE_ROWS``); all documents are scored whole, in one pass without a shuffle.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import bounded_sample
from shelfcast.session import materialize

#: Labelled documents for training, at most (about; chosen by a hash of the id).
SAMPLE_ROWS = 12_000
SLOTS, DIM, NONZERO, WINDOW, HIDDEN = 1 << 13, 64, 4, 2, 32
EPOCHS, BATCH, RATE, DECAY = 40, 128, 3e-3, 1e-4
#: Values of tokens that are kept in a task, and values pooled in one pass (26 and 8 MB, whatever the width of a token's row).
CACHE_VALUES, PASS_VALUES = 6_400_000, 1 << 21
#: Tasks over the bounded sample; each sends one sum of SLOTS x DIM.
SAMPLE_TASKS = 16

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_INPUTS = 2 * DIM + 2


SHAPES = ("<upper>", "<title>", "<lower>", "<digits>", "<signs>")


def shape(token: str) -> int:
    """Place in ``SHAPES``."""
    if token.isalpha():
        return 0 if token.isupper() and len(token) > 1 else 1 if token[0].isupper() else 2
    return 3 if token.isdigit() else 4


def index_vectors(tokens: list[str]) -> np.ndarray:
    """``NONZERO`` places of +1 or -1 per token, from its hash."""
    written = [t.encode("utf-8", "surrogatepass") for t in tokens]
    bits = np.fromiter(map(zlib.crc32, written), np.uint64, len(tokens)) | np.fromiter(map(zlib.adler32, written), np.uint64, len(tokens)) << np.uint64(32)
    v, row = np.zeros((len(tokens), DIM), np.float32), np.arange(len(tokens))
    for _ in range(NONZERO):
        bits = bits * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
        v[row, (bits >> np.uint64(40) & np.uint64(DIM - 1)).astype(np.int64)] += np.where(bits >> np.uint64(60) & np.uint64(1), 1.0, -1.0).astype(np.float32)
    return v


def slots(tokens: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) % SLOTS for t in tokens), np.int64, len(tokens))


class Tokens:
    """Numbers for tokens and a row of values for each, made side by side for the tokens of a pass that are met first."""

    def __init__(self, width: int, values):
        self.index, self.values, self.rows = {}, values, np.zeros((1024, width), np.float32)

    def ids(self, tokens: list[str]) -> np.ndarray:
        new = list(set(tokens).difference(self.index))
        if new:
            at, end = len(self.index), len(self.index) + len(new)
            if end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(end - len(self.rows), len(self.rows) // 2), self.rows.shape[1]), np.float32)])
            self.rows[at:end] = self.values(new)
            self.index.update(zip(new, range(at, end)))
        return np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))

    @property
    def most(self) -> int:
        """Tokens of a pass."""
        return max(1, PASS_VALUES // self.rows.shape[1])

    def trim(self) -> None:
        """Forgets tokens and their rows beyond the bound."""
        if len(self.index) * self.rows.shape[1] > CACHE_VALUES:
            self.index.clear()
            self.rows = np.zeros((1024, self.rows.shape[1]), np.float32)


_OF_SHAPES = index_vectors(list(SHAPES))


def _direct(tokens: list[str]) -> np.ndarray:
    return index_vectors([t.lower() for t in tokens]) + _OF_SHAPES[np.fromiter(map(shape, tokens), np.int64, len(tokens))]


def _contexts(batches):
    """Sums of the neighbours' index vectors per slot, over one task's texts."""
    sums, tokens = np.zeros((SLOTS, DIM), np.float32), Tokens(DIM + 1, lambda new: np.column_stack([_direct(new), slots(new)]))
    for batch in batches:
        for text in batch.column(0).to_pylist():
            ids = tokens.ids(TOKEN.findall(text or ""))
            own, at = tokens.rows[ids, :DIM], tokens.rows[ids, DIM].astype(np.int64)
            near = np.zeros_like(own)
            for d in range(1, WINDOW + 1):
                near[d:] += own[:-d]
                near[:-d] += own[d:]
            np.add.at(sums, at, near)
            tokens.trim()
    yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([r.tobytes() for r in sums], pa.binary())], ["slot", "v"])


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v, np.float32) for v in table.column("v").to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
    return pa.table({"slot": table.column("slot")[:1], "v": pa.array([total.tobytes()], pa.binary())})


def pooled(texts: list, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Means of the tokens' rows, and length and variety, per text; zeros for a text without tokens.

    What is held at a time is bounded by the values of a pass, not by the texts of a batch."""
    means, extra, held = np.zeros((len(texts), tokens.rows.shape[1]), np.float32), np.zeros((len(texts), 2), np.float32), []

    def flush():
        if held:
            flat = tokens.ids([t for _, found in held for t in found])
            lengths = np.array([len(found) for _, found in held])
            at = np.cumsum(lengths) - lengths
            means[[i for i, _ in held]] = np.add.reduceat(tokens.rows[flat], at, axis=0) / lengths[:, None]
            held.clear()
            tokens.trim()

    total = 0
    for i, text in enumerate(texts):
        found = TOKEN.findall(text or "")
        if not found:
            continue
        extra[i] = np.log1p(len(found)) / 10, len(set(found)) / len(found)
        # A long text goes through in pieces, which are added up.
        if len(found) > tokens.most:
            added = np.zeros(means.shape[1])
            for p in range(0, len(found), tokens.most):
                ids = tokens.ids(found[p : p + tokens.most])  # may replace tokens.rows by a longer array
                added += tokens.rows[ids].sum(axis=0, dtype=np.float64)
                tokens.trim()
            means[i] = added / len(found)
            continue
        if total + len(found) > tokens.most:
            flush()
            total = 0
        held.append((i, found))
        total += len(found)
    flush()
    return means, extra


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Product by rows: a row's values do not depend on the rows beside it."""
    return np.matmul(x[:, None, :], w)[:, 0]


@dataclass
class Network:
    words: np.ndarray | None  # SLOTS x DIM word vectors
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0

    def __post_init__(self):
        self.first = None if self.words is None or self.w1 is None else _times(self.words, self.w1[:DIM])

    def projected(self, tokens: list[str]) -> np.ndarray:
        """The tokens' shares of the first layer: pooling and the first layer are both linear, so they can change places."""
        return self.first[slots(tokens)] + _times(_direct(tokens), self.w1[DIM : 2 * DIM])

    def probability(self, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
        h = np.maximum(first + extra @ self.w1[2 * DIM :] + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -40, 40)))


def _trained(x: np.ndarray, y: np.ndarray) -> tuple:
    """Weights of the two layers on standardised inputs, by Adam; the standardisation is folded into the first layer."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - mean) / sd
    rng = np.random.default_rng(7)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // BATCH)):
            a = z[rows]
            u = a @ p[0] + p[1]
            h = np.maximum(u, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (u > 0)
            grads = [a.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    w1 = p[0] / sd[:, None]
    return w1, p[1] - mean @ w1, p[2], float(p[3][0])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that were not trained on."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col="doc_id", text_col="text", label_col="quality") -> Network:
    """A network from the labelled documents for which ``learn`` (over the id) holds.

    Labels that are null or not 0 or 1, and ids with labels that disagree, are left out. With fewer than 20 rows of
    either class there is no network: every score is 0.5. What reaches the driver is bounded: one vector per slot and one
    per row of the sample.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    chosen = bounded_sample(one.where((F.col("_y") == F.col("_z")) & learn).select(id_col, "_y"), id_col, SAMPLE_ROWS)
    sample = materialize(docs.select(id_col, text_col).join(chosen, id_col).repartition(SAMPLE_TASKS), "quality-sample")
    words = np.zeros((SLOTS, DIM), np.float32)
    sums = sample.select(text_col).repartition(SAMPLE_TASKS).mapInArrow(_contexts, "slot int, v binary").groupBy("slot").applyInArrow(_added, "slot int, v binary")
    for r in sums.toLocalIterator():
        words[r["slot"]] = np.frombuffer(r["v"], np.float32)
    words /= np.linalg.norm(words, axis=1, keepdims=True) + 1e-6

    def vectors(batches):
        tokens = Tokens(2 * DIM, lambda new: np.concatenate([words[slots(new)], _direct(new)], axis=1))
        for batch in batches:
            x = np.concatenate(pooled(batch.column(1).to_pylist(), tokens), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = sample.select(F.col(id_col).cast("long"), text_col, "_y").mapInArrow(vectors, "id long, y int, x binary").toPandas().sort_values(["id", "x"])
    x = np.array([np.frombuffer(b, np.float32) for b in got["x"]], np.float64).reshape(len(got), _INPUTS)
    y = got["y"].to_numpy(float)
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        return Network(None)
    out = np.arange(len(y)) % 5 == 0
    w1, b1, w2, b2 = _trained(x[~out], y[~out])
    temperature = _temperature(np.maximum(x[out] @ w1 + b1, 0) @ w2 + b2, y[out])
    return Network(words, w1.astype(np.float32), b1, w2, b2, temperature)


def score(network: Network, docs: DataFrame, *, text_col="text", out="score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1 for every row; a column named ``out`` is replaced.

    Null and empty texts are scored as texts without tokens. Repeated rows and null ids are rows like others.
    """
    keep = docs.drop(out)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens(HIDDEN, network.projected)
        for texts in batches:
            yield pd.Series(network.probability(*pooled(texts.tolist(), tokens)))

    value = F.lit(0.5) if network.words is None else probability(F.col(text_col))
    return keep.withColumn(out, value)
