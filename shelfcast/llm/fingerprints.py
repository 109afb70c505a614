"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of each of its prefixes, modulo two primes of 31 bits. Any
span's hash follows from two entries, so spans compare in constant time and longest common extensions are found by
binary search. A spliced text (the front of one document and the front of another) needs no new array: its
prefix hashes are sums of the parents' entries.

A fingerprint is a line of hexadecimal digits: length, hash of the whole text, hashes of its leading and trailing
spans of geometric lengths, and the ``SKETCH`` smallest mixed hashes of its spans of ``SPAN`` code points.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_220_703_125)
SPAN, SKETCH = 24, 48
#: Lengths of leading and trailing spans: three to each doubling.
LENGTHS = np.unique(np.floor(2.0 ** (np.arange(0, 3 * 40) / 3)).astype(np.int64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the bases and of their inverses, grown as longer texts come."""

    def __init__(self):
        self.size = 0
        self.grow(1024)

    def grow(self, n: int) -> None:
        if n <= self.size:
            return
        size = 1 << int(n).bit_length()

        def run(base, p):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                step = np.uint64(pow(base, have, p))
                out[have : 2 * have] = out[:have] * step % np.uint64(p)
                have *= 2
            return out

        self.up = [run(b, p) for b, p in zip(BASES, PRIMES)]
        self.down = [run(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]
        self.size = size


POWERS = Powers()


class Prefixes:
    """Prefix arrays of one text: ``span(i, j)`` hashes code points i..j-1, for whole arrays of i and j at once."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        POWERS.grow(self.n + 2)
        self.rows = []
        for up, p in zip(POWERS.up, PRIMES):
            row = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * up[: self.n] % np.uint64(p), out=row[1:])
            row %= np.uint64(p)
            self.rows.append(row)
        self._spans = None

    def at(self, k: int, i):
        return self.rows[k][i]

    def span(self, i, j):
        i, j = np.asarray(i), np.asarray(j)
        out = []
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            out.append((self.at(k, j) + p - self.at(k, i)) * POWERS.down[k][i] % p)
        return out[0] << np.uint64(31) | out[1]

    def spans(self) -> np.ndarray:
        """Mixed hashes of all spans of ``SPAN`` code points, of 32 bits."""
        if self._spans is None:
            p, row = np.uint64(PRIMES[0]), self.rows[0]
            m = self.n - SPAN + 1
            self._spans = mixed((row[SPAN:] + p - row[:m]) * POWERS.down[0][:m] % p) if m > 0 else np.zeros(0, np.uint32)
        return self._spans

    def parts(self) -> list[np.ndarray]:
        return [self.spans()]


class Spliced(Prefixes):
    """The first ``k`` code points of one text and the first ``m`` of another, from their arrays alone."""

    def __init__(self, first: Prefixes, k: int, second: Prefixes, m: int):
        self.first, self.second, self.k, self.m, self.n = first, second, k, m, k + m

    def at(self, k: int, i):
        i = np.asarray(i)
        p = np.uint64(PRIMES[k])
        front = self.first.rows[k][np.minimum(i, self.k)]
        return (front + self.second.rows[k][np.maximum(i - self.k, 0)] * POWERS.up[k][self.k]) % p

    def parts(self) -> list[np.ndarray]:
        crossing = np.arange(max(0, self.k - SPAN + 1), max(0, min(self.k, self.n - SPAN + 1)))
        p = np.uint64(PRIMES[0])
        over = (self.at(0, crossing + SPAN) + p - self.at(0, crossing)) * POWERS.down[0][crossing] % p
        return [self.first.spans()[: max(0, self.k - SPAN + 1)], mixed(over), self.second.spans()[: max(0, self.m - SPAN + 1)]]


def mixed(values: np.ndarray) -> np.ndarray:
    return (values * _MIX >> np.uint64(32)).astype(np.uint32)


def smallest(parts: list[np.ndarray]) -> np.ndarray:
    """The ``SKETCH`` smallest distinct values. Most are cut off by a threshold first; all are taken if that was too low."""
    n = sum(map(len, parts))
    if n > 16 * SKETCH:
        most = np.uint32(min(2**32 - 1, 2**32 * 8 * SKETCH // n))
        few = np.unique(np.concatenate([x[x < most] for x in parts]))
        if len(few) >= SKETCH:
            return few[:SKETCH]
    return np.unique(np.concatenate(parts))[:SKETCH]


def fingerprint(x: Prefixes) -> str:
    lengths = LENGTHS[LENGTHS <= x.n]
    whole = int(x.span(0, x.n))
    front = mixed(x.span(np.zeros_like(lengths), lengths))
    back = mixed(x.span(x.n - lengths, np.full_like(lengths, x.n)))
    sketch = smallest(x.parts()) if x.n >= SPAN else mixed(np.array([whole], np.uint64))
    return f"{x.n:x}.{whole:016x}." + ".".join(a.astype(">u4").tobytes().hex() for a in (front, back, sketch))


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension of ``a`` from i and ``b`` from j, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def parse(print_: str) -> tuple:
    n, whole, *rest = print_.split(".")
    return int(n, 16), whole, *(np.frombuffer(bytes.fromhex(x), ">u4") for x in rest)


def _agreed(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the shortest spans agree, by binary search: if a span agrees, so do the shorter ones."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[mid - 1] == b[mid - 1]:
            low = mid
        else:
            high = mid - 1
    return int(LENGTHS[low - 1]) if low else 0


def likeness(a: tuple, b: tuple) -> float:
    """Likeness of two parsed fingerprints: 1 for equal texts; else the larger of the share that agrees from both
    ends and the resemblance of the sketches (share of common spans among all, estimated from the smallest)."""
    if a[:2] == b[:2]:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    ends = min(_agreed(a[2], b[2]) + _agreed(a[3], b[3]), min(a[0], b[0])) / max(a[0], b[0])
    union = np.union1d(a[4], b[4])[:SKETCH]
    both = np.intersect1d(np.intersect1d(a[4], b[4], assume_unique=True), union, assume_unique=True)
    return float(max(min(ends, 1.0), len(both) / len(union)))


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("prefix_next", T.LongType()),
    ]
)
_ARROW = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in _OUT])
_NULL_ID = -(2**63)


def _compared(batches):
    """Rows of one id range in ascending order, the first row of the next range last (halo): each with its successor."""
    held = None  # (id, text, arrays, fingerprint, parsed)
    for batch in batches:
        rows = []
        for doc_id, text, halo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "halo"))):
            if held is not None and held[-1]:
                break  # more rows with the id of the first halo row
            x = Prefixes(text)
            own = fingerprint(x)
            here = (doc_id, text, x, own, parse(own), halo)
            if held is not None:
                rows.append(_row(held, here))
            held = here
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _row(a, b):
    doc_id, text, x, own, parsed, _ = a
    half = x.n // 2
    y = b[2]
    edited = Spliced(x, x.n - half, y, min(half, y.n))
    print_ = fingerprint(edited) if half else own
    written = text[: x.n - half] + b[1][:half]
    return {
        "doc_id": doc_id,
        "n_chars": x.n,
        "edited_sha256": hashlib.sha256(written.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": own,
        "edited_fingerprint": print_,
        "near_edited": likeness(parsed, parse(print_)),
        "near_next": likeness(parsed, b[4]),
        "prefix_next": common_extension(x, 0, y, 0) if x.n and y.n and text[0] == b[1][0] else 0,
    }


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next document's.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points replaced by the first as many (or all)
    of the next document by ascending id; after the last comes the first. Also prefix_next: the code points that
    the text and the next one have in common at their start.

    The texts move once, to ``ranges`` id ranges of near-equal row counts (default: the session's shuffle
    partitions), whose bounds are quantiles of the id; the first row of each range goes to the range before it as well.
    Null text is empty. Ids are whole numbers; null ids come first; rows with equal ids follow the order of their
    texts; a single row is its own successor; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(_NULL_ID))
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("c")).first()["c"] or []
    bounds = np.unique(np.array(cuts if parts > 1 else [], dtype=np.int64))

    @F.pandas_udf(T.IntegerType())
    def range_of(k):
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype("int32"))

    firsts = {r["r"]: r["k"] for r in rows.select(range_of(key).alias("r"), key.alias("k")).groupBy("r").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def targets(k):
        at = np.searchsorted(bounds, k.to_numpy(), side="right")
        return pd.Series([[own, before[v]] if v in before else [own] for own, v in zip(at.tolist(), k.tolist())])

    dealt = rows.select("doc_id", "text", F.posexplode(targets(key)).alias("pos", "part")).withColumn("halo", F.col("pos") > 0)
    return (
        dealt.repartitionById(max(len(bounds) + 1, 1), F.col("part"))
        .sortWithinPartitions("halo", "doc_id", "text")
        .select("doc_id", "text", "halo")
        .mapInArrow(_compared, _OUT)
    )
