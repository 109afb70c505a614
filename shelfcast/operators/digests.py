"""Digests of the active sales, kept so that an upload is compared without reading them.

A generation of sales leaves, for each month of bills, the 128-bit digests of its distinct rows and a Bloom filter whose words
are rows: a digest picks one word of 64 bits and four bits in it, so that probing is an equality join and a bit mask. An upload
reads the words of its own months; only rows that a word does not rule out meet the digests of those months. What is in
neither is new for certain, what is in the digests is known (two rows with one digest are taken for equal).
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators.cleaning import with_parsed_date
from shelfcast.session import materialize
from shelfcast.sources.files import append_entry, last_entry

#: Bits of the filter for a digest; some 2 of 100 rows that are not in the sales pass it.
BITS = 10
NO_MONTH = "none"
WORDS = "month string, word long, bits long, generation int"
DIGESTS = "digest binary, generation int, month string"
SIZES = "month string, words long, generation int"


def row_digest(columns: Sequence[str]) -> Column:
    """Digest of a row's values, as the sales schema types them; nulls are equal to nulls, and -0.0 to 0.0."""
    types = {f.name: f.dataType for f in s.SALES_SCHEMA}
    parts = []
    for c in columns:
        value = F.col(c).try_cast(types[c])
        text = (value + F.lit(0.0) if types[c].simpleString() == "double" else value).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts)))


def keyed(sales: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sales with their ``digest`` and the ``month`` of their bills."""
    dated = with_parsed_date(sales)
    month = F.coalesce(F.date_format(F.col(s.BILL_DATE), "yyyyMM"), F.lit(NO_MONTH))
    return dated.withColumns({"digest": row_digest(columns), "month": month})


def _mask() -> Column:
    """Four bits of a word, by 6 bits of the digest's hash each."""
    hashed = F.xxhash64("digest")
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(63)).cast("int")) for at in (0, 6, 12, 18)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def _word() -> Column:
    return F.pmod(F.xxhash64(F.lit("word"), "digest"), F.col("words"))


class SalesDigests:
    """The digests under a folder. Months of sales are folders of their own, so that a reader opens those it needs."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str] = s.REQUIRED):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), tuple(columns)

    def generations(self) -> int:
        return last_entry(self.spark, f"{self.path}/generations")[0]

    def append(self, sales: DataFrame) -> int:
        """Add sales as one generation; it counts once all its files are there. Fails if another writer was first."""
        number = self.generations() + 1
        rows = keyed(sales, self.columns).select("month", "digest").distinct().hint("rebalance", "month")
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/digests/generation={number}")
        written = self._read("digests", DIGESTS, [number])
        sizes = written.groupBy("month").agg(F.count("*").alias("n"))
        power = F.ceil(F.log2(F.col("n") * BITS / F.lit(64.0)))
        sizes = sizes.select("month", F.pow(F.lit(2.0), F.greatest(power, F.lit(2))).cast("long").alias("words"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes/generation={number}")
        words = written.join(self._read("sizes", SIZES, [number]).drop("generation"), "month").groupBy("month", _word().alias("word"))
        words = words.agg(F.bit_or(_mask()).alias("bits")).hint("rebalance", "month")
        words.write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/words/generation={number}")
        if not append_entry(self.spark, f"{self.path}/generations", number, str(number)):
            raise RuntimeError(f"another writer added generation {number}")
        return number

    def _read(self, table: str, schema: str, generations: Sequence[int], months: Sequence[str] | None = None) -> DataFrame:
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/generation={g}" for g in generations])
        return rows if months is None else rows.where(F.col("month").isin(*months))

    def suspects(self, digested: DataFrame, months: Sequence[str], generations: Sequence[int]) -> DataFrame:
        """``generation``, ``month``, ``digest`` of rows that the filters do not rule out."""
        sizes = self._read("sizes", SIZES, generations).where(F.col("month").isin(*months))
        probed = digested.join(sizes, "month").select("generation", "month", "digest", _word().alias("word"), _mask().alias("mask"))
        words = self._read("words", WORDS, generations, months)
        return probed.join(words, ["generation", "month", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("generation", "month", "digest")

    def mark(self, rows: DataFrame, flag: str) -> DataFrame:
        """Distinct rows with 1 in ``flag`` where the sales have them, else 0. The months of the rows are at most a few hundred values."""
        generations = range(1, self.generations() + 1)
        probe = keyed(rows, self.columns)
        if not generations:
            return rows.withColumn(flag, F.lit(0))
        probe = materialize(probe, "probe")
        months = [r.month for r in probe.select("month").distinct().collect()]
        if not months:
            return rows.withColumn(flag, F.lit(0))
        suspects = self.suspects(probe.select("month", "digest"), months, generations)
        known = self._read("digests", DIGESTS, generations, months).join(suspects, ["generation", "month", "digest"], "left_semi")
        known = known.select("month", "digest").distinct().withColumn(flag, F.lit(1))
        return probe.join(known, ["month", "digest"], "left").withColumn(flag, F.coalesce(flag, F.lit(0))).select(*rows.columns, flag)

    def new_rows(self, upload: DataFrame) -> DataFrame:
        """Distinct uploaded rows that the sales lack."""
        distinct = with_parsed_date(upload).select(*self.columns).distinct()
        return self.mark(distinct, "_known").where("_known = 0").select(*self.columns)
