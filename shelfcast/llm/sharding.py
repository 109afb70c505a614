"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to ``BITS`` bits; the curve index of the cell orders the rows, and the order is cut
into runs. Neighbours on the curve are neighbours in every dimension, so a run covers a compact box and the
minima and maxima of its file prune reads on any of the dimensions.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize

#: Bits of a quantised dimension; three dimensions give 32,768 cells.
BITS = 5
#: Bits of the checksum by which the texts of one cell are split, and parts of the rows of one text: either may be any number.
TEXT_BITS, ID_PARTS = 12, 1024
#: What is summed along the curve: rows, bytes, and texts of one row.
MEASURES = ("_rows", "_bytes", "_lone")
#: Rows with equal values here have equal texts.
TEXT = ["_key", "_crc", "_size"]


def with_hilbert_index(df: DataFrame, dims: Sequence[str], out: str, bits: int = BITS) -> DataFrame:
    """``df`` with the index along the Hilbert curve of the cell in ``dims``, whole numbers of ``bits`` bits each.

    The published transform of axes to a transposed index (Skilling 2004): undo the excess rotations from the
    highest bit down, Gray-encode, interleave the bits. Each step is a column that the next one reads. The result is
    never null, so that a join on it adds no test of it below the steps, which would compute each one many times.
    """
    n = len(dims)
    cell = ", ".join(f"CAST(`{d}` AS BIGINT)" for d in dims)
    steps = ", ".join(f"named_struct('q', {1 << b}L, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    levels = ", ".join(f"{1 << b}L" for b in range(bits - 1, 0, -1))
    places = ", ".join(f"named_struct('b', {b}, 'i', {i})" for b in range(bits - 1, -1, -1) for i in range(n))
    return (
        df.withColumn(
            "_turned",
            F.expr(
                f"""aggregate(array({steps}), array({cell}), (a, s) -> IF((a[s.i] & s.q) != 0,
                transform(a, (v, k) -> IF(k = 0, v ^ (s.q - 1), v)),
                transform(a, (v, k) -> IF(k = 0 OR k = s.i, v ^ ((a[0] ^ a[s.i]) & (s.q - 1)), v))))"""
            ),
        )
        .withColumn("_gray", F.expr("transform(_turned, (v, k) -> aggregate(slice(_turned, 1, k + 1), 0L, (x, y) -> x ^ y))"))
        .withColumn("_flip", F.expr(f"aggregate(array({levels}), 0L, (t, q) -> IF((_gray[{n - 1}] & q) != 0, t ^ (q - 1), t))"))
        .withColumn(out, F.expr(f"coalesce(aggregate(array({places}), 0L, (h, p) -> h * 2 + (shiftright(_gray[p.i] ^ _flip, p.b) & 1)), 0L)"))
        .drop("_turned", "_gray", "_flip")
    )


def _quantised_names(rows: DataFrame, name: str, out: str) -> DataFrame:
    """Per distinct value of a text column, null last, its rank scaled to ``BITS`` bits: ranges of values stay ranges."""
    values = rows.groupBy(F.col(name).isNull().alias(f"{out}_null"), F.coalesce(name, F.lit("")).alias(f"{out}_value")).agg(F.count("*").alias("_n"))
    order = Window.orderBy(f"{out}_null", f"{out}_value")
    rank, count = F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy())
    return values.select(f"{out}_null", f"{out}_value", F.floor(rank * (1 << BITS) / count).cast("long").alias(out))


def _along_curve(texts: DataFrame) -> DataFrame:
    """``texts`` with the sums of ``MEASURES`` over all texts before each (``<measure>_at``) and over all (``<measure>_all``).

    Texts follow cell, checksum and key; sums of parts of cells carry the order across tasks.
    """
    before = lambda window, m: F.coalesce(F.sum(m).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = texts.groupBy("_curve", "_part").agg(*[F.sum(m).alias(m) for m in MEASURES])
    cells = parts.groupBy("_curve").agg(*[F.sum(m).alias(m) for m in MEASURES])
    cells = cells.select(
        "_curve",
        *[before(Window.orderBy("_curve"), m).alias(f"{m}_cell") for m in MEASURES],
        *[F.sum(m).over(Window.partitionBy()).alias(f"{m}_all") for m in MEASURES],
    )
    in_cell = Window.partitionBy("_curve").orderBy("_part")
    parts = parts.select("_curve", "_part", *[before(in_cell, m).alias(f"{m}_part") for m in MEASURES]).join(cells, "_curve")
    in_part = Window.partitionBy("_curve", "_part").orderBy("_crc", "_key", "_size")
    inner = texts.select("*", *[before(in_part, m).alias(f"{m}_in") for m in MEASURES])
    at = [(F.col(f"{m}_cell") + F.col(f"{m}_part") + F.col(f"{m}_in")).alias(f"{m}_at") for m in MEASURES]
    return inner.join(parts, ["_curve", "_part"]).select(*texts.columns, *at, *[f"{m}_all" for m in MEASURES])


def _off_boundaries(texts: DataFrame, n_shards: int) -> DataFrame:
    """Where a boundary between shards of equal counts cuts a text's rows, texts of one row behind them go before them.

    As many go ahead, in their order, as rows lay before the boundary, so the rows begin at it. If the shard behind has
    fewer of them, or the text fills more than a shard, its rows stay cut. ``_rows_at`` becomes the new place.
    """
    last = F.expr(f"((_rows_at + _rows - 1) * {n_shards}) div _rows_all")
    texts = texts.withColumn("_shard", last).withColumn("_cut", F.col("_shard") > F.expr(f"(_rows_at * {n_shards}) div _rows_all"))
    cut = lambda c: F.max(F.when(F.col("_cut"), F.col(c)))
    moves = (
        texts.groupBy("_shard")
        .agg(F.sum("_lone").alias("_spare"), cut("_rows_at").alias("_from"), cut("_lone_at").alias("_lone_from"), F.max("_rows_all").alias("_all"))
        .withColumn("_need", F.expr(f"(_shard * _all + {n_shards - 1}) div {n_shards} - _from"))
        .where(F.expr(f"_need <= _spare AND _need * {n_shards} <= _all"))
        .select("_shard", "_from", "_lone_from", "_need")
    )
    rank = F.col("_lone_at") - F.col("_lone_from")
    place = (
        F.when(F.col("_need").isNull(), F.col("_rows_at"))
        .when(F.col("_cut"), F.col("_from") + F.col("_need"))
        .when((F.col("_lone") == 1) & (rank < F.col("_need")), F.col("_from") + rank)
        .otherwise(F.col("_rows_at") + F.col("_need") - F.least(F.col("_need"), rank))
    )
    # at most one row per shard is broadcast
    return texts.join(F.broadcast(moves), "_shard", "left").withColumn("_rows_at", place).drop("_shard", "_cut", "_from", "_lone_from", "_need")


def shard(
    docs: DataFrame,
    *,
    n_shards: int = 8,
    law: str = "rows",
    id_col: str = "doc_id",
    text_col: str = "text",
    names: Sequence[str] = ("lang", "source"),
) -> DataFrame:
    """Every row with its shard and its place there, by a Hilbert curve through text size and the columns ``names``.

    Returned: the id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard (0 to ``n_shards`` - 1), slot (0, 1,
    ... in each shard), grown_shard (null: these laws cut anew when shards are added), curve (the index), and the names.
    ``law`` is "rows" (counts at most one apart) or "bytes" (a row goes where the middle of its bytes lies, so sizes
    differ by a row's size at most).

    Rows of equal texts form a group: all take the cell of the one with the smallest id (null first) and follow each other, by a
    hash of the id. Under "rows" a group that a boundary would cut moves behind it; it is cut only if it is larger
    than a shard or the next shard has too few texts of one row to fill the gap. Under "bytes" a boundary may cut it. Texts
    are told apart by two checksums and their size. A group and a cell of any size are ordered in independent parts.
    A null or empty text has size 1 and checksum 0, and both are one group; null names come last; null ids are values;
    repeated rows are separate rows; an empty table gives none. Other columns of the input are not read.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = [f"_d{i}" for i in range(len(names))]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
        F.xxhash64(text).alias("_key"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(ID_PARTS)).alias("_split"),
        *[F.col(c).alias(d) for c, d in zip(names, given)],
    )
    rows = materialize(rows, "shard-rows")  # the texts are read once
    splits = rows.groupBy(*TEXT, "_split").agg(F.count("*").alias("_n"), F.min(F.struct("_id", *given)).alias("_first"))
    splits = materialize(splits, "shard-splits")
    texts = splits.groupBy(*TEXT).agg(F.sum("_n").alias("_rows"), F.min("_first").alias("_first"))
    texts = texts.select(
        *TEXT,
        "_rows",
        (F.col("_rows") * F.col("_size")).alias("_bytes"),
        (F.col("_rows") == 1).cast("long").alias("_lone"),
        F.shiftright("_crc", 32 - TEXT_BITS).alias("_part"),
        F.least(F.floor(F.log2(F.col("_size").cast("double"))), F.lit((1 << BITS) - 1)).cast("long").alias("_qs"),
        *[F.col("_first")[d].alias(d) for d in given],
    )
    texts = materialize(texts, "shard-texts")
    placed = texts
    for i, d in enumerate(given):
        placed = placed.join(
            _quantised_names(texts, d, f"_q{i}"),
            (F.col(d).isNull() == F.col(f"_q{i}_null")) & (F.coalesce(d, F.lit("")) == F.col(f"_q{i}_value")),
        ).drop(f"_q{i}_null", f"_q{i}_value", d)
    dims = ["_qs", *[f"_q{i}" for i in range(len(names))]]
    cells = with_hilbert_index(placed.select(*dims).distinct(), dims, "_curve")
    placed = materialize(_along_curve(placed.join(cells, dims).drop(*dims)), "shard-places")
    if law == "rows":
        placed = _off_boundaries(placed, n_shards)
    in_text = Window.partitionBy(*TEXT).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_split_at", F.coalesce(F.sum("_n").over(in_text), F.lit(0))).drop("_n", "_first")
    splits = splits.join(placed.select(*TEXT, "_curve", "_rows_at", "_rows_all", "_bytes_at", "_bytes_all"), TEXT)
    in_split = Window.partitionBy(*TEXT, "_split").orderBy("_id", *given)
    rows = rows.withColumn("_rank", F.row_number().over(in_split) - 1).join(splits, [*TEXT, "_split"])
    rows = rows.withColumn("_nth", F.col("_split_at") + F.col("_rank")).withColumn("_at", F.col("_rows_at") + F.col("_nth"))
    if law == "rows":
        rows = rows.withColumn("shard", F.expr(f"CAST((_at * {n_shards}) div _rows_all AS INT)"))
        rows = rows.withColumn("_start", F.expr(f"(shard * _rows_all + {n_shards - 1}) div {n_shards}"))
    else:
        middle = f"((2 * (_bytes_at + _nth * _size) + _size) * {n_shards}) div (2 * _bytes_all)"
        rows = rows.withColumn("shard", F.expr(f"CAST({middle} AS INT)"))
        rows = rows.join(F.broadcast(rows.groupBy("shard").agg(F.min("_at").alias("_start"))), "shard")  # one row per shard
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit(law).alias("law"),
        "shard",
        (F.col("_at") - F.col("_start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_curve").alias("curve"),
        *[F.col(d).alias(c) for c, d in zip(names, given)],
    )


def write_shards(placed: DataFrame, rows: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``rows`` (unique ids) as one folder per shard, each in curve order, for readers that prune by file statistics."""
    at = placed.select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = rows.join(at, rows[id_col].eqNullSafe(F.col("_id")))
    joined.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_id", "_slot").write.partitionBy("_shard").parquet(path)
