"""Quality rules with thresholds from mergeable quantile sketches per language and source.

A sketch is the count of documents per bucket of a rate. Buckets are whole numbers up to 2^BITS, then 2^BITS to each
doubling, so a quantile is right within a share of 2^-BITS, sketches merge by adding counts, and the result depends on
no order or partitioning. A language's sketch is the sum of those of its sources; it stands behind each of them with the
weight of ``PRIOR`` documents, so that a source of few documents is judged mostly by its language.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize

# Fixed values of the base rules.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
WINDOW = 3

#: Finer part of a bucket: quantiles are right within 1/128.
BITS = 7
#: Documents that a language's sketch counts for in each of its sources.
PRIOR = 50
#: A rate is refused beyond the upper quartile by more than REACH times the distance of the quartiles, or of this
#: least distance where they are closer. Rates are in millionths, but word length in thousandths of a character.
REACH = 3
RATES = {"symbols": 15_000, "lines": 120_000, "repeats": 120_000, "length": 700}
#: Rates that are also refused when they are too low.
TWO_SIDED = ("length",)

CONTINUATIONS = bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text holds twice or more."""
    if len(words) < WINDOW + 1:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for window in windows:
        (twice if window in seen else seen).add(window)
    total, free = 0, 0  # words before ``free`` are counted
    for at, window in enumerate(windows):
        if window in twice:
            total += at + WINDOW - max(at, free)
            free = at + WINDOW
    return total


def measures(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of MEASURES."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = len(text.translate(None, SPACES + CONTINUATIONS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words), len(lines)


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and the counts of every whole text (null: none), one text at a time; rows and nulls stay as they are."""
    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    kept = rows.schema.fields[1:]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{m} long" for m in MEASURES])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [measures(t.as_py() or b"") for t in batch.column(0)]
            columns = [pa.array([c[k] for c in counted], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*batch.schema.names[1:], *MEASURES])

    return rows.mapInArrow(apply, schema)


def rates() -> dict[str, Column]:
    """Whole-number rates; 0 where there is nothing to divide by."""

    def share(a: str, b: str, unit: int) -> Column:
        return F.expr(f"coalesce({a} * {unit}L div nullif({b}, 0L), 0L)")

    return {
        "symbols": share("n_symbols", "word_chars", 1_000_000),
        "lines": share("n_dup_lines", "n_lines", 1_000_000),
        "repeats": share("n_repeat_words", "n_words", 1_000_000),
        "length": share("word_chars", "n_words", 1_000),
    }


def bucket(value: Column) -> Column:
    """Bucket of a whole number that is not negative."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(BITS + 1), F.lit(0))
    return (shift * F.lit(1 << BITS) + F.call_function("shiftright", value, shift)).cast("int")


def bucket_top(number: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.greatest(F.floor(number / F.lit(1 << BITS)) - F.lit(1), F.lit(0)).cast("int")
    above = (number - shift * F.lit(1 << BITS) + F.lit(1)).cast("long")
    return F.call_function("shiftleft", above, shift) - F.lit(1)


def sketches(measured: DataFrame) -> DataFrame:
    """``lang_key``, ``source_key``, ``rate``, ``bucket`` and the number of documents ``n``: partial counts leave each task.

    Only documents that the base rules keep count. Keys tell a null from an empty value.
    """
    each = F.array(*[F.struct(F.lit(name).alias("rate"), bucket(c).alias("bucket")) for name, c in rates().items()])
    return (
        measured.where(~base_failed())
        .select(key("lang").alias("lang_key"), key("source").alias("source_key"), F.inline(each))
        .groupBy("lang_key", "source_key", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Sketches of wider groups: the sums of their parts' counts."""
    return parts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def key(name: str) -> Column:
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def thresholds(parts: DataFrame) -> DataFrame:
    """Per lang_key and source_key, the lowest and highest value allowed of each rate, as ``<rate>_low`` and ``<rate>_high``.

    Bucket weights are n * N + PRIOR * m, with n documents of the source and m of the N of its language: whole numbers,
    so quartiles are exact. A source meets every bucket of its language once; documents play no part any more.
    """
    whole = merge(parts, "lang_key").withColumn("total", F.sum("n").over(Window.partitionBy("lang_key", "rate")).cast("decimal(38,0)"))
    sources = parts.select("lang_key", "source_key").distinct()
    weighted = (
        whole.withColumnRenamed("n", "m")
        .join(sources, "lang_key")
        .join(parts, ["lang_key", "source_key", "rate", "bucket"], "left")
        .withColumn("weight", (F.coalesce("n", F.lit(0)).cast("decimal(19,0)") * F.col("total").cast("decimal(18,0)") + F.col("m") * F.lit(PRIOR)).cast("decimal(38,0)"))
    )
    group = Window.partitionBy("lang_key", "source_key", "rate")
    below = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = weighted.withColumn("upto", F.sum("weight").over(below)).withColumn("all", F.sum("weight").over(group))

    def quartile(k: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bucket")))

    ends = placed.groupBy("lang_key", "source_key", "rate").agg(
        bucket_top(quartile(1)).alias("q1"), bucket_top(quartile(3)).alias("q3")
    )
    least = F.create_map(*[F.lit(v) for pair in RATES.items() for v in pair])
    reach = F.lit(REACH) * F.greatest(F.col("q3") - F.col("q1"), least[F.col("rate")])
    limits = ends.withColumn("low", F.col("q1") - reach).withColumn("high", F.col("q3") + reach)
    picked = [F.max(F.when(F.col("rate") == name, F.col(end))).alias(f"{name}_{end}") for name in RATES for end in ("low", "high")]
    return limits.groupBy("lang_key", "source_key").agg(*picked)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept: every rate within the limits of the document's language and source.

    The limits have one row per language and source, so the join adds no rows; a large source is split by adaptive execution.
    """
    rated = measured.select("*", key("lang").alias("lang_key"), key("source").alias("source_key"), *[c.alias(f"{n}_rate") for n, c in rates().items()])
    inside = F.lit(True)
    for name in RATES:
        inside = inside & (F.col(f"{name}_rate") <= F.col(f"{name}_high"))
        if name in TWO_SIDED:
            inside = inside & (F.col(f"{name}_rate") >= F.col(f"{name}_low"))
    return (
        rated.join(limits, ["lang_key", "source_key"], "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .drop("lang_key", "source_key")
    )


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept.

    A null or empty text has no words and fails the base rules; a null language or source is a group of its own;
    repeated rows count as often as they occur; no rows give no rows. Other columns of the input are not read.
    """
    measured = materialize(measure(docs), "rules")
    limits = materialize(thresholds(sketches(measured)), "limits")
    judged = judge(measured, limits)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rows of apply_rules() over documents.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS l, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
t AS (SELECT rid, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM t WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, word, b, c) > 1),
n AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, l, s, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN n ON w.rid = n.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(n_symbols * 1000000 // nullif(word_chars, 0), 0) AS symbols, coalesce(n_dup_lines * 1000000 // nullif(n_lines, 0), 0) AS lines,
    coalesce(n_repeat_words * 1000000 // nullif(n_words, 0), 0) AS repeats, coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS length FROM m),
v AS (SELECT l, s, rate, value, greatest(length(bin(value)) - 8, 0) AS e FROM (
    UNPIVOT (SELECT l, s, symbols, lines, repeats, length FROM f WHERE NOT base_failed) ON symbols, lines, repeats, length INTO NAME rate VALUE value)),
k AS (SELECT l, s, rate, e * 128 + (value >> e) AS b, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT l, rate, b, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY l, rate) AS total FROM k GROUP BY l, rate, b),
x AS (SELECT g.l, q.s, g.rate, g.b, coalesce(k.n, 0)::HUGEINT * g.total + g.m * 50 AS weight
    FROM g JOIN (SELECT DISTINCT l, s FROM k) q ON g.l = q.l LEFT JOIN k ON k.l = g.l AND k.s = q.s AND k.rate = g.rate AND k.b = g.b),
y AS (SELECT *, sum(weight) OVER (PARTITION BY l, s, rate ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY l, s, rate) AS whole FROM x),
z AS (SELECT l, s, rate, min(b) FILTER (upto * 4 >= whole) AS b1, min(b) FILTER (upto * 4 >= whole * 3) AS b3 FROM y GROUP BY l, s, rate),
a AS (SELECT l, s, rate, greatest(b1 // 128 - 1, 0) AS e1, greatest(b3 // 128 - 1, 0) AS e3, b1, b3 FROM z),
h AS (SELECT l, s, rate, ((b1 - e1 * 128 + 1) << e1) - 1 AS q1, ((b3 - e3 * 128 + 1) << e3) - 1 AS q3 FROM a),
c AS (SELECT l, s, rate, q1 - 3 * greatest(q3 - q1, least_) AS low, q3 + 3 * greatest(q3 - q1, least_) AS high FROM (
    SELECT *, CASE rate WHEN 'symbols' THEN 15000 WHEN 'length' THEN 700 ELSE 120000 END AS least_ FROM h)),
p AS (SELECT l, s, max(high) FILTER (rate = 'symbols') AS a, max(high) FILTER (rate = 'lines') AS b, max(high) FILTER (rate = 'repeats') AS c,
    max(high) FILTER (rate = 'length') AS d, max(low) FILTER (rate = 'length') AS e FROM c GROUP BY l, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= a AND lines <= b AND repeats <= c AND length <= d AND length >= e, false) AS kept
FROM f LEFT JOIN p ON f.l = p.l AND f.s = p.s
"""
