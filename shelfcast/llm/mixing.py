"""Mix sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1: its weight times a straight line from ``start`` to
``end``. The schedule's integral is the source's weight, which fixes its target of words; the inverse of the
integral turns the place of a document among its source's taken words into a training position. Sorting by
position puts the documents of all sources in training order.

Nothing but sums crosses partitions: places come from sums per (source, bucket of the order key) plus a window
inside one bucket, so that a source with a third of all rows is spread over ``BUCKETS`` windows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the order key in a source: the first three digits of a hexadecimal hash.
BUCKETS = 4096


def order_key(id_col: str, seed: str) -> Column:
    """A hash of the id that fixes the order of a source's documents; equal for equal ids."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def source_targets(
    sized: DataFrame, source_col: str, size_col: str, weights: Sequence[int], share: float, cap: float
) -> DataFrame:
    """Per source (``_null``, ``_source``): source_rank, source_size and target.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn. The targets are the one set of
    values with ``target = min(cap * source_size, level * weight)`` whose sum is ``share`` of all sizes: sources
    are taken by rising ``cap * size / weight``, and the level is that of the first source which it leaves under
    its cap. One row per source is all that the unpartitioned windows see.
    """
    totals = sized.groupBy(F.col(source_col).isNull().alias("_null"), F.coalesce(source_col, F.lit("")).alias("_source")).agg(
        F.sum(size_col).alias("source_size")
    )
    everything = Window.partitionBy()
    by_name, by_ratio = Window.orderBy("_null", "_source"), Window.orderBy("_ratio", "source_rank")
    ranked = (
        totals.withColumn("source_rank", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") - 1) % len(weights) + 1))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_k", F.row_number().over(by_ratio))
        .withColumn(
            "_before", F.lit(float(cap)) * (F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))
        )
        .withColumn("_left", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_left"))
    )
    under = F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.struct("_k", "_level"))
    level = F.min(under).over(everything)["_level"]
    return ranked.withColumn("_final", level).select(
        "_null",
        "_source",
        "source_rank",
        "source_size",
        F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_weight")), F.col("_cap")).alias("target"),
    )


def mix(
    sized: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    weights: Sequence[int] = (3, 1, 2),
    schedule: Sequence[tuple[float, float]] = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5)),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    ordered: bool = True,
) -> DataFrame:
    """All columns of ``sized`` with the decision for each row, in training order of its first copy.

    With ``ordered=False`` the rows stay as they lie, for a caller that orders them by itself: a sort moves all columns.

    ``sized`` has a non-null whole number of words in ``size_col``. Added: source_size, target, copies (whole times
    that the document is taken), taken (copies * size), first_position and last_position (0..1; null if not taken).
    Input columns of these names or beginning with ``_`` are replaced.

    A source is taken ``floor(target / source_size)`` times whole; the rest of the target goes to its first documents
    by order key, those whose middle word lies within it. Taken words are within one document of the target.
    Rows of size 0 take no words: they follow the same rule and may be copied or not, with taken = 0.
    A null id or source is a value like others (source: last rank); repeated rows are separate documents; an empty
    table gives no rows. Reruns give the same rows, whatever the partitioning.
    """
    added = {"source_size", "target", "copies", "taken", "first_position", "last_position"}
    keep = [c for c in sized.columns if c not in added and not c.startswith("_")]
    rows = sized.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(source_col).isNull().alias("_null"),
        F.coalesce(source_col, F.lit("")).alias("_source"),
        order_key(id_col, seed).alias("_key"),
    ).withColumn("_bucket", F.substring("_key", 1, 3))
    targets = source_targets(sized, source_col, size_col, weights, share, cap).withColumn(
        "_curve", F.element_at(F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in schedule]), (F.col("source_rank") - 1) % len(schedule) + 1)
    )
    sums = rows.groupBy("_null", "_source", "_bucket").agg(F.sum(size_col).alias("_sum"))
    above = Window.partitionBy("_null", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(above), F.lit(0)))
        .join(targets, ["_null", "_source"])
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
        .drop("_sum", "source_rank")
    )
    inside = Window.partitionBy("_null", "_source", "_bucket").orderBy("_key", F.col(id_col), F.col(size_col))
    placed = (
        rows.withColumn("_inner", F.sum(size_col).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size_col))
        .join(offsets, ["_null", "_source", "_bucket"])
        .withColumn("_middle", F.col("_offset") + F.col("_inner") + F.col(size_col) / F.lit(2.0))
        .withColumn("copies", (F.col("_whole") + F.when(F.col("_middle") <= F.col("_rest"), 1).otherwise(0)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col(size_col))
    )

    def position(copy: Column) -> Column:
        """Training time at which the schedule has asked for the words before this copy's middle."""
        a, b = F.col("_curve")[0], F.col("_curve")[1]
        asked = F.least((copy * F.col("source_size") + F.col("_middle")) / F.col("target"), F.lit(1.0)) * (a + b) / F.lit(2.0)
        return F.when((copy >= 0) & (F.col("target") > 0), F.lit(2.0) * asked / (a + F.sqrt(a * a + F.lit(2.0) * (b - a) * asked)))

    first = position(F.when(F.col("copies") > 0, F.lit(0)))
    mixed = placed.select(
        *[F.col(f"`{c}`") for c in keep],
        "source_size",
        "target",
        "copies",
        "taken",
        first.alias("first_position"),
        position(F.col("copies") - 1).alias("last_position"),
    )
    return mixed.orderBy("first_position", id_col, size_col) if ordered else mixed


def training_rows(mixed: DataFrame, columns: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """One row per taken copy with ``columns``, range-sorted by position; ``mixed`` need not be ordered."""
    at = F.when(F.col("copies") == 1, F.array("first_position")).otherwise(F.array("first_position", "last_position"))
    return (
        mixed.where(F.col("copies") > 0)
        .withColumn("_position", F.explode(at))
        .orderBy(F.col("_position").asc_nulls_first(), id_col)
        .select(*[F.col(f"`{c}`") for c in columns])
    )


#: The rows of mix() over documents with its default parameters.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS n, coalesce(source, '') AS s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
t AS (SELECT n, s, sum(size)::BIGINT AS source_size FROM d GROUP BY n, s),
r AS (SELECT *, row_number() OVER (ORDER BY n, s) AS rk FROM t),
w AS (SELECT *, [3, 1, 2][((rk - 1) % 3 + 1)::INT] AS wt, 2.0::DOUBLE * source_size AS cap FROM r),
q AS (SELECT *, row_number() OVER (ORDER BY cap / wt, rk) AS i,
    1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
    2.0::DOUBLE * (sum(source_size) OVER (ORDER BY cap / wt, rk ROWS UNBOUNDED PRECEDING) - source_size)::DOUBLE AS before_,
    (sum(wt) OVER (ORDER BY cap / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS left_ FROM w),
l AS (SELECT *, (total - before_) / left_ AS lev FROM q),
f AS (SELECT *, (SELECT min_by(lev, i) FROM l WHERE lev * wt < cap) AS level FROM l),
g AS (SELECT *, coalesce(least(cap, level * wt), cap) AS target,
    [0.5, 1.0, 1.5][((rk - 1) % 3 + 1)::INT]::DOUBLE AS a, [1.5, 1.0, 0.5][((rk - 1) % 3 + 1)::INT]::DOUBLE AS b FROM f),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
p AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.whole, h.a, h.b,
    (sum(size) OVER (PARTITION BY d.n, d.s ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::DOUBLE + size / 2.0::DOUBLE AS middle
  FROM d JOIN h ON d.n = h.n AND d.s = h.s),
c AS (SELECT *, (whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM p),
y AS (SELECT *, least(middle / target, 1.0::DOUBLE) * (a + b) / 2.0::DOUBLE AS y1,
    least(((copies - 1) * source_size + middle) / target, 1.0::DOUBLE) * (a + b) / 2.0::DOUBLE AS y2 FROM c)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken,
  CASE WHEN copies > 0 AND target > 0 THEN 2.0::DOUBLE * y1 / (a + sqrt(a * a + 2.0::DOUBLE * (b - a) * y1)) END AS first_position,
  CASE WHEN copies > 0 AND target > 0 THEN 2.0::DOUBLE * y2 / (a + sqrt(a * a + 2.0::DOUBLE * (b - a) * y2)) END AS last_position
FROM y
"""
